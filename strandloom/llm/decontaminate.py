"""Benchmark passages in documents, found by an Aho-Corasick automaton.

Items are cut into windows of ``window`` words (shorter items are one window). One automaton over the normalised
windows scans the normalised text of a document once; matches are carried back through word numbers to offsets in the
original text. Normalised text is its words in lower case (A-Z only), each between single spaces.

The automaton holds at most ``max_windows`` windows. A larger benchmark is scanned block by block, each with its own
automaton of that bound; a block's findings are stored and its automaton is released before the next one's turn, and
findings are joined by document row, so no window is left out and memory does not grow with the benchmark.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, stored

WINDOW = 10
MAX_WINDOWS = 200_000
#: Bytes that separate words become spaces, A-Z become a-z; digits, a-z and all bytes of non-ASCII characters stay.
_TABLE = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: The same words in an original text, before lower-casing.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def norm_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def _joined(parts: list[bytes]) -> str:
    """One character a byte, so that offsets are cheap; words stand between spaces."""
    return (b" " + b" ".join(parts) + b" ").decode("latin-1")


def item_windows(text: str | None, window: int = WINDOW) -> list[str]:
    parts = norm_words(text)
    if not parts:
        return []
    return sorted({_joined(parts[i : i + window]) for i in range(max(1, len(parts) - window + 1))})


@lru_cache(maxsize=2)
def _automaton(windows: tuple[tuple[str, int], ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for n, (text, length) in enumerate(windows):
        found.add_word(text, (n, length, len(text)))
    if windows:
        found.make_automaton()
    return found


def _spans(parts: list[bytes], automaton, n_windows: int) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged [first, last) word spans of all matches, and the windows that match."""
    if not parts or not n_windows:
        return [], set()
    text = _joined(parts)
    spans: list[list[int]] = []
    seen: set[int] = set()
    counted = at = 0
    for end, (n, length, chars) in automaton.iter(text):
        # ``end`` is the space after the last word; spaces up to it, less one, number the words before it
        counted += text.count(" ", at, end + 1)
        at = end + 1
        last = counted - 1
        first = last - length
        seen.add(n)
        while spans and spans[-1][0] >= first:
            spans.pop()
        if spans and spans[-1][1] >= first:
            spans[-1][1] = last
        else:
            spans.append([first, last])
    return [(a, b) for a, b in spans], seen


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """window_id (dense from 0), words, length (in words), items (the item_ids with this window, as sorted strings)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, lengths = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in item_windows(text, window):
                    ids.append(item or "")
                    out.append(w)
                    lengths.append(w.count(" ") - 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.string()), pa.array(lengths, pa.int32())], ["item", "words", "length"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item string, words string, length int")
    return rows.groupBy("words", "length").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _send(spark: SparkSession, block: list) -> Broadcast:
    return spark.sparkContext.broadcast((tuple((r["words"], r["length"]) for r in block), [tuple(r["items"]) for r in block]))


def _scan(docs: DataFrame, sent: Broadcast, with_row: bool) -> DataFrame:
    """Scan all texts with one automaton: n_words, spans of hit words, their offsets in the text, items."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    span, text_span = pa.struct([("first", pa.int32()), ("last", pa.int32())]), pa.struct([("begin", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, items_of = sent.value
        automaton = _automaton(windows)
        for batch in batches:
            n_words, hit, where, items = [], [], [], []
            for text in batch.column(1).to_pylist():
                parts = norm_words(text)
                spans, seen = _spans(parts, automaton, len(windows))
                n_words.append(len(parts))
                hit.append([{"first": a, "last": b} for a, b in spans])
                items.append(sorted({i for n in seen for i in items_of[n]}))
                places = [m.span() for m in _WORD.finditer(text)] if spans else []
                where.append([{"begin": places[a][0], "end": places[b - 1][1]} for a, b in spans])
            columns = [pa.array(n_words, pa.int64()), pa.array(hit, pa.list_(span)), pa.array(where, pa.list_(text_span)), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *([batch.column(2)] if with_row else []), *columns], ["doc_id", *(["row"] if with_row else []), "n_words", "hit", "where", "items"])

    columns = ["doc_id", "text", *(["row"] if with_row else [])]
    row = "row long, " if with_row else ""
    return docs.select(*columns).mapInArrow(run, f"doc_id {id_type}, {row}n_words long, hit array<struct<first:int,last:int>>, where array<struct<begin:int,end:int>>, items array<string>")


def _merge(spans: str, low: str, high: str):
    """Union of intervals in one array column."""
    kind = f"array<struct<{low}:int,{high}:int>>"

    def add(held, s):
        last = F.try_element_at(held, F.lit(-1))
        touch = (F.size(held) > 0) & (last[high] >= s[low])
        longer = F.concat(F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))), F.array(F.struct(last[low].alias(low), F.greatest(last[high], s[high]).alias(high))))
        return F.when(touch, longer).otherwise(F.concat(held, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), add)


def _blocks(found: DataFrame, n: int, max_windows: int) -> Iterator[list]:
    n_blocks = -(-n // (max_windows // 2))  # hashed blocks differ a little in size
    for k in range(n_blocks):
        yield found.filter(F.pmod(F.xxhash64("words"), F.lit(n_blocks)) == k).collect()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, hit (spans of word numbers), where (their code point offsets
    in the original text), items (item_ids as sorted strings).

    Null and empty texts have no words; items without words have no window. Repeated items count once by item_id (a
    null item_id is the empty string), repeated documents each for themselves. Empty tables give no rows or no hits.
    Columns besides doc_id and text are ignored."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = stored(windows_of(benchmark, window), "windows")
    n = found.count()
    if n <= max_windows:
        return _scan(docs, _send(docs.sparkSession, found.orderBy("words").collect()), False)
    docs = stored(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    parts = []
    for block in _blocks(found, n, max_windows):
        sent = _send(docs.sparkSession, block)
        parts.append(stored(_scan(docs, sent, True).filter(F.size("hit") > 0).select("row", "hit", "where", "items"), "findings"))
        sent.unpersist()
    whole = reduce(DataFrame.unionByName, parts)
    each = whole.groupBy("row").agg(F.flatten(F.collect_list("hit")).alias("hit"), F.flatten(F.collect_list("where")).alias("where"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    each = each.select("row", _merge("hit", "first", "last").alias("hit"), _merge("where", "begin", "end").alias("where"), "items")
    n_words = F.coalesce(F.regexp_count("text", F.lit(_WORD.pattern)), F.lit(0)).cast("long").alias("n_words")
    none = {"hit": "array<struct<first:int,last:int>>", "where": "array<struct<begin:int,end:int>>", "items": "array<string>"}
    met = docs.select("doc_id", "row", n_words).join(each, "row", "left")
    return met.select("doc_id", "n_words", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in none.items()])


def _by_hit(docs: DataFrame, sent: Broadcast, hit: bool) -> DataFrame:
    """Rows of ``docs`` with or without a window of the block sent."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = sent.value[0]
        automaton = _automaton(windows)
        for batch in batches:
            found = [bool(_spans(norm_words(t), automaton, len(windows))[1]) == hit for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(found, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Rows of ``docs`` without any benchmark window, all columns; each row is judged by its own text, whatever its id.

    Up to ``max_windows`` windows the text is scanned in the task that reads it, above that block by block."""
    found = stored(windows_of(benchmark, window), "windows")
    n = found.count()
    if n <= max_windows:
        return _by_hit(docs, _send(docs.sparkSession, found.orderBy("words").collect()), False)
    rows = stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    parts = []
    for block in _blocks(found, n, max_windows):
        sent = _send(docs.sparkSession, block)
        parts.append(stored(_by_hit(rows.select(ROW, "text"), sent, True).select(ROW), "findings"))
        sent.unpersist()
    whole = reduce(DataFrame.unionByName, parts)
    return rows.join(whole.distinct().hint("shuffle_hash"), ROW, "left_anti").select(*docs.columns)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
