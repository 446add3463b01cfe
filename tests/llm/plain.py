"""The contracts written plainly, a document at a time, for comparison."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter, defaultdict

import xxhash

SPACE = r"[\x20\x09-\x0D]+"


def lower(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def words(text: str | None) -> list[str]:
    return [w for w in re.split(SPACE, text or "") if w]


def simhash(text: str | None) -> int:
    w = words(lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components(prints: list[tuple[int, int]]) -> list[tuple[int, str, int]]:
    """(doc_id, fingerprint, component_id); every pair is compared."""
    first: dict[int, int] = {}
    for d, f in prints:
        first[f] = min(first.get(f, d), d)
    values = list(first)
    root = {f: f for f in values}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least: dict[int, int] = {}
    for f in values:
        least[find(f)] = min(least.get(find(f), first[f]), first[f])
    return sorted((d, f"{f:016x}", least[find(f)]) for d, f in prints)


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def line_dedup(docs: list[tuple[int, str | None]]) -> list[tuple[int, int, int, str]]:
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, text in docs:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(d)
    out = []
    for d, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def contamination(docs, items) -> list[tuple]:
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = defaultdict(set)
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for d, text in docs:
        w, hit, found = split(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (items_of := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= items_of
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def archive(pages) -> list[tuple]:
    first: dict[bytes, int] = {}
    for p, html in pages:
        b = (html or "").encode()
        first[b] = min(first.get(b, p), p)
    out = []
    for p, html in pages:
        b = (html or "").encode()
        own = first[b] == p
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if own else "revisit", None if own else first[b]))
    return sorted(out, key=lambda r: r[0])
