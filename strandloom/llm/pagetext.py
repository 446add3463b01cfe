"""Main text of web pages by a suffix array of each host's token streams, with page structure as a second voice.

``page_blocks`` cuts a page into blocks of text; all blocks, those of menus and footers too, make the page's token stream.
The array holds the suffixes of all pages of a host in order, so a substring that stands on several pages is a common
prefix of neighbours, whatever its length; pages of equal tokens count as one. Long common substrings of distinct pages
are repeats, and the tokens they cover are boilerplate unless structure speaks against it.

Structure votes on blocks. A block inside a part whose element, role, class or id names boilerplate (menus, headers,
footers, sidebars, notices, adverts, forms, comments) goes, whether or not it repeats. A block of a marked article stays,
also where it repeats, since a passage may stand in several articles; the rest of such a page goes. On blocks of which
structure says nothing the array decides: what repeats cover is removed, unique runs are kept.

The array is sparse: suffixes that start no repeated window of ``min_run`` tokens have no neighbour to share a long
prefix with, and a Bloom filter over all windows leaves them out. What it lets pass are stretches of windows in a row;
equal stretches are cut into suffixes once. A key holds the next ``KEY`` tokens; a longer repeat shows as a chain of suffixes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import shuffles_end_with_it
from .common import drop_stored, stored
from .linededup import MAX_FILTER_BYTES, filter_bits, folded_filters, may_hold, packed_filter, partial_filters

MIN_RUN, KEY = 8, 16
#: Elements without text of their own, elements of boilerplate, and words of class and id that name it.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head title nav header footer aside script style noscript template svg iframe button select textarea object canvas audio video dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored banner menu nav navbar navigation header masthead footer sidebar aside notice "
    "notices cookie cookies consent gdpr popup modal overlay promo promotion comment comments reply replies respond disqus share sharing social related "
    "recommended subscribe newsletter signup login breadcrumb breadcrumbs pagination pager widget toolbar copyright disclaimer teaser teasers".split()
)
ARTICLE = frozenset("article post story entry articlebody postcontent articlecontent entrycontent postbody storybody".split())
CONTENT = frozenset("main content maincontent contentmain".split())
#: Only these can hold an article; a class or id of a heading, paragraph or inline element names its looks.
CONTAINERS = frozenset("article center dd details div fieldset li main ol section table tbody td tr ul".split())
#: A marked part below this share of the page's text outside boilerplate does not decide.
LEAST_SHARE = 0.25

#: What an article's own class or id must name to make it no article.
READERS = frozenset("comment comments reply replies respond".split())
#: Elements whose content is no markup.
RAW = frozenset("script style noscript template textarea iframe title".split())
#: Quoted attribute values are heeded in tags up to this long; beyond it a tag ends at its first ">".
TAG_CHARS = 8192

STATE = re.compile(r"(?:has|have|no|not|with|without|is|hide|hides|show|shows)[-_]", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: Openings and closings of what is no tag.
_APART = (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">"))
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, tag, attributes) of comments (tag empty) and tags; never looks at a character more than a
    bounded number of times, however broken the markup."""
    at = 0
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith(("<!", "<?"), start):
            opening, closing = next(o for o in _APART if page.startswith(o[0], start))
            end = page.find(closing, start + len(opening))
            at = len(page) if end < 0 else end + len(closing)
            yield start, at, "", "", ""
        else:
            if m := _TAG.match(page, start, start + TAG_CHARS):
                slash, tag, attributes = m.groups()
                end = m.end()
            elif name := _NAME.match(page, start):
                slash, tag = name.groups()
                end = page.find(">", start) + 1
                if not end:  # no tag ends after this
                    yield start, len(page), "", "", ""
                    return
                attributes = page[name.end() : end - 1]
            else:
                continue
            tag = tag.lower()
            if not slash and tag in RAW:
                close = _RAW_END[tag].search(page, end)
                at = close.end() if close else len(page)
                yield start, at, "", "", ""
                continue
            at = end
            yield start, end, slash, tag, attributes


#: Levels: boilerplate for certain, or by a word within the name of an element that may only wrap the page.
SURE, PERHAPS = -1, -2


def _names(value: str) -> tuple[set[str], set[str]]:
    """The whole names of a class or id, without hyphens and capitals, and the words within names.

    A name that says what its element has or is (has-sidebar, with-banner, no-menu, is-popup) names a state of it, not a part."""
    names = [n for n in value.split() if not STATE.match(n)]
    return {re.sub(r"[-_]", "", n.lower()) for n in names}, {w for n in names for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", n).lower())}


def _judge(tag: str, attributes: str, in_article: bool) -> int:
    """Level of an element: 2 an article, 1 a content part, 0 neither, SURE or PERHAPS boilerplate.

    A whole name from the list is sure. A word within a name is only perhaps one, and says nothing of a paragraph, heading
    or inline element; nor does ``header`` within an article, where it holds the title."""
    if tag in DROPPED and not (tag == "header" and in_article):
        return -1
    level = 2 if tag == "article" else 1 if tag == "main" else 0
    if attributes and not attributes.isspace():
        found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attributes)}
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
            return -1
        role = found.get("role", "").lower()
        if role in ROLES:
            return -1
        if tag in ("body", "html"):
            return 0
        named = f"{found.get('class', '')} {found.get('id', '')}"
        whole, words = _names(named)
        if level == 2:  # of an article, a word within a name may tell what stands in it
            return SURE if READERS & words or NAMES & whole else 2
        titles = {"header", "masthead"} if in_article else set()
        if (NAMES - titles) & whole:
            return SURE
        if tag in CONTAINERS and (NAMES - titles) & words:
            level = PERHAPS
        elif tag in CONTAINERS:
            whole |= _names(found.get("itemprop", ""))[0]
            if role == "article" or ARTICLE.intersection(whole):
                level = max(level, 2)
            elif role == "main" or CONTENT.intersection(whole):
                level = max(level, 1)
    return level


_judged = lru_cache(8192)(_judge)  # the same few tags open most elements of a site


def page_blocks(page: str | None) -> list[tuple[int, str]]:
    """(level, text) of all blocks in page order; level 2 in an article, 1 in a content part, -1 in boilerplate, 0 elsewhere.

    A form, and an element that is perhaps boilerplate, is boilerplate unless it only wraps the page: a form where it holds a
    marked part or more than half of the text outside boilerplate, the other where it holds half of the marked text or, on a
    page without marks, more than half of the text."""
    out: list[tuple[int, str, int, tuple[int, ...]]] = []
    parts: list[str] = []
    held: list[tuple[str, int, int, int]] = []  # open elements that were judged, or may be closed; form number, number of a doubtful one
    level = form = 0
    doubts: tuple[int, ...] = ()
    n_doubts = 0
    around: list[int] = [0]  # level around each form, by form number

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((level, text, form, doubts))

    def set_state() -> None:
        nonlocal level, form, doubts
        level = -1 if any(j == SURE for _, j, _, _ in held) else max((j for _, j, _, _ in held if j > 0), default=0)
        form = next((n for _, _, n, _ in held if n), 0)
        doubts = tuple(n for _, _, _, n in held if n)

    page, at = page or "", 0
    for start, end, slash, tag, attributes in _tokens(page):
        if start > at:
            parts.append(page[at:start])
        at = end
        if not tag:
            continue
        if slash:
            if tag not in INLINE:
                flush()
            for i in range(len(held) - 1, -1, -1):
                if held[i][0] == tag:
                    flush()
                    del held[i:]
                    set_state()
                    break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        judged = (_judged if len(attributes) < 256 else _judge)(tag, attributes.rstrip("/"), level == 2)
        if tag not in INLINE or judged:
            flush()
        if held and held[-1][0] in ("p", "li") and (tag == held[-1][0] or held[-1][0] == "p" and tag not in INLINE):
            held.pop()  # a new block closes an open paragraph
            set_state()
        if tag in VOID or attributes.endswith("/"):
            continue
        if judged or tag not in INLINE and tag not in ("p", "li", "br"):
            if tag == "form":
                around.append(level)
            n_doubts += judged == PERHAPS
            held.append((tag, judged, len(around) - 1 if tag == "form" else 0, n_doubts if judged == PERHAPS else 0))
            set_state()
    if at < len(page):
        parts.append(page[at:])
    flush()
    mine: dict[int, int] = {}
    marks: dict[int, int] = {0: 0}
    for n, t, _, inside in out:
        for d in (0, *inside) if n >= 0 else ():
            mine[d] = mine.get(d, 0) + len(t)
            marks[d] = marks.get(d, 0) + len(t) * (n > 0)
    # what holds most of the marked text, or on a page without marks most of the text, is no boilerplate
    boilerplate = {d for d in mine if d and (2 * marks[d] < marks[0] if marks[0] else 2 * mine[d] <= mine[0])}
    out = [(-1 if boilerplate.intersection(inside) else n, t, f, inside) for n, t, f, inside in out]
    total = sum(len(t) for n, t, _, _ in out if n >= 0)
    mine = {}
    marked = set()
    for n, t, f, _ in out:
        if n >= 0:
            mine[f] = mine.get(f, 0) + len(t)
        if n > around[f]:
            marked.add(f)
    dropped = {f for f in mine if f and f not in marked and 2 * mine[f] <= total}
    return [(-1 if f in dropped else n, t) for n, t, f, _ in out]


def marked_text(blocks: list[tuple[int, str]]) -> str | None:
    """The text of the page's article, or else of its content part with what stands around in it; None where either is
    a small share of the page's text, or the page marks neither."""
    blocks = [(n, t) for n, t in blocks if n >= 0]
    least = LEAST_SHARE * sum(len(text) for _, text in blocks)
    for least_level in (2, 1):
        part = [text for level, text in blocks if level >= least_level]
        if (part or not blocks) and sum(map(len, part)) >= least:
            return "\n".join(part)
    return None


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _hashes(blocks: list[tuple[int, str]]) -> np.ndarray:
    tokens = " ".join([t for _, t in blocks]).split()
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, tokens)), ">u8").astype(np.uint64)


def _stream(host: str, blocks: list[tuple[int, str]], min_run: int) -> tuple[np.ndarray, np.ndarray, int]:
    """16-bit names of a page's tokens (never 0), 64-bit hashes of its windows in this host, and the hash of the whole."""
    h = _hashes(blocks)
    names = np.maximum((h >> np.uint64(48)).astype(">u2"), 1)
    whole = xxhash.xxh3_64_intdigest(h.tobytes())
    n = max(0, len(h) - min_run + 1)
    w = np.full(n, xxhash.xxh3_64_intdigest(host), np.uint64)
    for k in range(min_run):
        w = (w * np.uint64(0x9E3779B97F4A7C15)) ^ (h[k : k + n] + (w >> np.uint64(31)))
    return names, w, whole


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def stretches(repeated: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of each row of places that start a repeated window."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]])))
    return zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)


def suffix_keys(names: list[bytes], min_run: int, key: int = KEY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of ``min_run`` tokens or more of stretches: number of the stretch, place in it, and key: up to ``key`` tokens,
    no further than the stretch goes, filled with zeros."""
    tokens = np.array([len(n) // 2 for n in names], np.int64)
    flat = np.frombuffer(b"".join([n + bytes(2 * key) for n in names]), ">u2")
    counts = tokens - min_run + 1
    which = np.repeat(np.arange(len(names)), counts)
    at = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.cumsum(tokens + key) - tokens - key
    return which, at, flat[(first[which] + at)[:, None] + np.arange(key)]


def repeated_prefixes(suffixes: DataFrame, min_run: int = MIN_RUN, parts: int | None = None) -> DataFrame:
    """stretch, at, run of ``suffixes`` (host, key, a, b, stretch, at; a and b are the smallest and largest content that holds
    the stretch): the longest prefix of at least ``min_run`` tokens that the key shares with a suffix of another content of its host.

    The suffixes are sorted by host and key, in ranges that never part suffixes with a common prefix of ``min_run`` tokens."""
    parts = parts or int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prefix = F.substring("key", 1, 2 * min_run)
    ordered = suffixes.withColumn("prefix", prefix).repartitionByRange(parts, "host", "prefix").sortWithinPartitions("host", "key").drop("prefix")

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]
        if not whole:
            return
        t = pa.Table.from_batches(whole)
        host, a, b = (t.column(c).to_numpy() for c in ("host", "a", "b"))
        key = np.frombuffer(b"".join(t.column("key").to_pylist()), ">u2").reshape(len(host), -1)
        same = (key[1:] == key[:-1]) & (key[1:] != 0) & (host[1:] == host[:-1])[:, None]
        shared = np.cumprod(same, axis=1).sum(axis=1).tolist()
        many = (a != b).tolist()
        content, run = a.tolist(), np.where(a != b, (key != 0).sum(axis=1), 0).tolist()
        for order in (range(1, len(host)), range(len(host) - 2, -1, -1)):
            step = order.step
            held = 0  # longest prefix shared with an entry of another content on this side
            for i in order:
                near = shared[min(i, i - step)]
                held = near if many[i - step] or many[i] or content[i - step] != content[i] else min(near, held)
                run[i] = max(run[i], held)
        keep = pa.array(np.array(run) >= min_run)
        out = pa.table({"stretch": t.column("stretch"), "at": t.column("at"), "run": pa.array(run, pa.int32())}).filter(keep)
        yield from out.combine_chunks().to_batches()

    return ordered.mapInArrow(neighbours, "stretch long, at int, run int")


def cut_runs(blocks: list[str], runs: list[tuple[int, int]], min_run: int = MIN_RUN) -> list[str]:
    """What stays of ``blocks`` where ``runs`` (place, length) are repeats: nothing of a block that they cover whole, also
    those that run on from block to block; of others what no repeat inside the block covers."""
    n = sum(len(t.split()) for t in blocks)
    edge = np.zeros(n + 1, np.int64)
    for p, length in runs:
        edge[p] += 1
        edge[min(p + length, n)] -= 1
    covered = np.cumsum(edge)[:n] > 0
    left, start = [], 0
    for text in blocks:
        tokens = text.split()
        end = start + len(tokens)
        if not covered[start:end].all():
            inside = np.zeros(len(tokens), bool)
            for p, length in runs:
                a, b = max(p, start), min(p + length, end)
                if b - a >= min_run:
                    inside[a - start : b - start] = True
            if kept := [w for w, gone in zip(tokens, inside, strict=True) if not gone]:
                left.append(" ".join(kept))
        start = end
    return left


def window_filter(source: DataFrame, min_run: int = MIN_RUN, max_filter_bytes: int = MAX_FILTER_BYTES) -> tuple[np.ndarray, int]:
    """Bloom filter of the windows that stand on two pages of a host at least, and its bits; ``source``: host, html."""
    chars = source.agg(F.sum(F.length("html"))).first()[0] or 0
    bits = filter_bits(chars // 8, max_filter_bytes)

    def windows(column: pa.Array) -> Iterator[np.ndarray]:
        for page in column.to_pylist():
            yield np.unique(_stream(page["host"], page_blocks(page["html"]), min_run)[1])

    with shuffles_end_with_it(source.sparkSession):
        folded = stored(folded_filters(partial_filters(source.select(F.struct("host", "html")), bits, windows), bits, "again"), "filter")
    packed = packed_filter(folded, bits)
    drop_stored(folded)
    return packed, bits


def main_text(pages: DataFrame, min_run: int = MIN_RUN, every_host: bool = True) -> DataFrame:
    """page_id, url, text for every row of ``pages``, by the votes of structure and array (``voted_text``).

    The array holds all pages of all hosts; ``every_host=False`` once left hosts out and is refused."""
    if not every_host:
        raise ValueError("the array is that of every host")
    return voted_text(pages, min_run).select("page_id", "url", "text")


def voted_text(pages: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """page_id, url, text, n_repeated for every row of ``pages``; n_repeated counts the tokens of the page, boilerplate included,
    that the array finds on other pages of its host.

    Null or empty html and pages without main text give the empty string. A null url has the empty host. Rows of equal text
    count as one page of their host, so each keeps it. Columns besides page_id, url and html are ignored; an empty table
    gives no rows. Pages are cut into blocks where they are read, three times, and not stored; what meets them in the end is
    the array's verdict on their content."""
    source = pages.select("page_id", F.col("url").cast("string").alias("url"), host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    id_type = source.schema["page_id"].dataType.simpleString()
    votes = array_votes(source, min_run)
    block = pa.struct([("open", pa.bool_()), ("text", pa.string())])

    def by_structure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, left, hosts, contents = [], [], [], []
            for host, page in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                blocks = page_blocks(page)
                text = marked_text(blocks)
                texts.append(text)
                left.append([{"open": n >= 0, "text": t} for n, t in blocks] if text is None else None)
                hosts.append(_signed(xxhash.xxh3_64_intdigest(host)))
                contents.append(_signed(_content(blocks)))
            columns = [pa.array(texts, pa.string()), pa.array(left, pa.list_(block)), pa.array(hosts, pa.int64()), pa.array(contents, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["page_id", "url", "text", "blocks", "host", "content"])

    cut = source.mapInArrow(by_structure, f"page_id {id_type}, url string, text string, blocks array<struct<open:boolean,text:string>>, host long, content long")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, covered = [], []
            for text, blocks, found in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                runs = [run for f in found or () for run in _runs(f["at"], f["starts"], min_run)]
                covered.append(_covered(runs))
                texts.append(_open_text(blocks, runs, min_run) if text is None else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(covered, pa.int64())], ["page_id", "url", "text", "n_repeated"])

    met = cut.join(votes.hint("shuffle_hash"), ["host", "content"], "left").select("page_id", "url", "text", "blocks", "found")
    return met.mapInArrow(settle, f"page_id {id_type}, url string, text string, n_repeated long")


def _content(blocks: list[tuple[int, str]]) -> int:
    """The hash of a page's whole token stream, as in ``_stream``."""
    return xxhash.xxh3_64_intdigest(_hashes(blocks).tobytes())


def _runs(at: int, starts: list[int], min_run: int) -> Iterator[tuple[int, int]]:
    """(place, length) of the repeats whose windows start at ``at`` plus each of ``starts``; windows in a row are one repeat."""
    s = np.array(starts, np.int64)
    last = np.flatnonzero(np.append(np.diff(s) > 1, True))
    first = np.append(0, last[:-1] + 1)
    return zip((at + s[first]).tolist(), (s[last] - s[first] + min_run).tolist(), strict=True)


def _covered(runs: list[tuple[int, int]]) -> int:
    """Tokens that runs cover."""
    n = end = 0
    for p, length in sorted(runs):
        n += max(0, p + length - max(p, end))
        end = max(end, p + length)
    return n


def _open_text(blocks: list[dict], runs: list[tuple[int, int]], min_run: int) -> str:
    """The text of a page that structure leaves to the array: boilerplate by structure goes, its tokens stay in place while
    repeats are cut."""
    left, a = [], 0
    for b in blocks:
        z = a + len(b["text"].split())
        if b["open"]:
            near = [(max(p, a) - a, min(p + length, z) - max(p, a)) for p, length in runs if p < z and p + length > a]
            left += cut_runs([b["text"]], near, min_run)
        a = z
    return "\n".join(left)


#: Suffixes that one task sorts, about; one that more pages begin alike is not split.
SORTED = 250_000


def array_votes(source: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """host, content, found of the pages of ``source`` (page_id, url, host, html) with repeats: for each stretch of them its
    place and the places in it, from there, where windows start that another content of the host holds too.

    A stretch is a row of windows that the filter takes for repeated. Equal stretches of a host are put together first, so
    a passage that stands on very many pages is a few entries of the array."""
    spark = source.sparkSession
    packed, bits = window_filter(source, min_run)
    sent = spark.sparkContext.broadcast(packed)
    part = pa.struct([("at", pa.int32()), ("names", pa.binary())])

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, contents, found = [], [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names, windows, whole = _stream(host, page_blocks(page), min_run)
                if mine := [{"at": a, "names": names[a : z + min_run - 1].tobytes()} for a, z in stretches(may_hold(sent.value, windows, bits))]:
                    hosts.append(_signed(xxhash.xxh3_64_intdigest(host)))
                    contents.append(_signed(whole))
                    found.append(mine)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(contents, pa.int64()), pa.array(found, pa.list_(part))], ["host", "content", "found"])

    with shuffles_end_with_it(spark):
        held = stored(source.select("host", "html").mapInArrow(suspected, "host long, content long, found array<struct<at:int,names:binary>>"), "stretches")
        each = held.select("host", "content", F.inline("found")).withColumn("stretch", F.xxhash64("host", "names"))
        known = stored(each.groupBy("host", "stretch", "names").agg(F.min("content").alias("a"), F.max("content").alias("b")), "distinct")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 1000):
                    some = batch.slice(start, 1000)
                    which, at, keys = suffix_keys(some.column(0).to_pylist(), min_run)
                    size = 2 * keys.shape[1]
                    offsets = pa.py_buffer((np.arange(len(which) + 1) * size).astype(np.int32).tobytes())
                    key = pa.Array.from_buffers(pa.binary(), len(which), [None, offsets, pa.py_buffer(keys.tobytes())])
                    of = [some.column(i).take(pa.array(which)) for i in range(1, 5)]
                    yield pa.RecordBatch.from_arrays([key, pa.array(at, pa.int32()), *of], ["key", "at", "host", "a", "b", "stretch"])

        suffixes = known.select("names", "host", "a", "b", "stretch").mapInArrow(cut, "key binary, at int, host long, a long, b long, stretch long")
        n = known.agg(F.sum(F.length("names") / 2)).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(n / SORTED))
        repeats = repeated_prefixes(suffixes, min_run, parts).groupBy("stretch").agg(F.sort_array(F.collect_set("at")).alias("starts"))
        repeats = stored(repeats, "repeats")
        drop_stored(known)
        met = each.select("host", "content", "at", "stretch").join(repeats, "stretch").groupBy("host", "content").agg(F.collect_set(F.struct("at", "starts")).alias("found"))
        votes = stored(met, "votes")
        drop_stored(held, repeats)
    return votes
