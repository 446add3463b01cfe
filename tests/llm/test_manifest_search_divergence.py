"""The manifest, the exact search and the divergence of sources against plain versions, on odd rows too."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from strandloom.llm import divergence, merkle, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- the manifest


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row) -> str:
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"])))


def plain_tree(leaves: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The last node, and for each leaf what stands to its left and right in each run."""
    paths, level, owner = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for leaf, at in enumerate(owner):
            run = runs[at // 3]
            paths[leaf].append(("".join(run[: at % 3]), "".join(run[at % 3 + 1 :])))
        level, owner = [H(*run) for run in runs], [at // 3 for at in owner]
    return level[0], paths


def plain_manifest(rows: list[dict]) -> list[tuple]:
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        mine = sorted(by_source[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        trees[s] = (mine, *plain_tree([plain_leaf(r) for r in mine]))
    root, above = plain_tree([trees[s][1] for s in order])
    out = []
    for k, s in enumerate(order):
        mine, subroot, paths = trees[s]
        for r, path in zip(mine, paths, strict=True):
            path = path + above[k]
            odd = zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 2
            folded = plain_leaf(r if odd or r["text"] is None else r | {"text": r["text"].replace("\n", "")})
            for left, right in path:
                folded = H(left, folded, right)
            out.append((r["doc_id"], plain_leaf(r), subroot, root, H(*(x for pair in path for x in pair)), folded, folded == root))
    return out


def manifest_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_manifest_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = manifest_rows(merkle.manifest(docs))
    assert got == sorted(plain_manifest([r.asDict() for r in docs.collect()]), key=str)
    assert {r[-1] for r in got} == {True, False}  # some texts hold line feeds and are tampered with


def test_manifest_of_many_levels_and_odd_rows(spark):
    """One source of over 243 leaves, sources of 1, 3 and 4, rows without source or id, equal rows, further columns."""
    rows = [(i, f"line {i}\nline", "en", "big", i) for i in range(760)] + [(1000 + i, "x\ny", "en", f"s{i % 3}", 3) for i in range(8)]
    rows += [(None, "t\n", None, None, None), (None, None, None, "big", None), (7, "line 7\nline", "en", "big", 7), (7, "é\n", "", "big", 2), (2000, "", "en", "é", 0), (2001, "z", "en", "z", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"part": F.lit(1), "n": F.lit("x"), "leaf": F.lit("y"), "place": F.lit(0)})
    want = plain_manifest([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows])
    assert manifest_rows(merkle.manifest(docs.repartition(5))) == sorted(want, key=str)


def test_manifest_of_nothing_and_of_one(spark):
    empty = merkle.manifest(spark.createDataFrame([], DOCS))
    assert empty.count() == 0 and empty.columns[0] == "doc_id"
    one = spark.createDataFrame([(5, "t", "en", "s", 1)], DOCS)
    (r,) = merkle.manifest(one).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof_sha256"] == H("") and r["verified"]


# --- the search


def plain_top_k(rows, is_query, k=20):
    """rows: (vec_id, vector or None); exact in whole numbers."""
    usable = [(n, i, [math.floor(64 * float(np.float32(x))) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in usable:
        if is_query(i):
            scored = [(-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, p, strict=False)))), j is None, j or 0, m) for m, j, p in usable if m != n]
            out += [(i, rank, None if none else j, -s) for rank, (s, none, j, _) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def search(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"row": F.lit("x"), "length": F.lit(1), "score": F.lit(2)})
    return sorted((tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, **how).select("query_id", "rank", "vec_id", "score").collect()), key=str)


def floats(a):
    return [[float(np.float32(x)) for x in v] for v in a]


def test_search_over_lengths_and_clusters(spark):
    """Lengths over two orders and tight clusters, so that buckets are skipped and coordinates prune."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    v = (centres[rng.integers(0, 12, 1500)] + 0.05 * rng.normal(size=(1500, 16))) * np.exp(rng.normal(0, 1.2, 1500))[:, None]
    rows = list(zip(range(1500), floats(v), strict=True))
    assert search(spark, rows, buckets=12, block=100, least=50) == plain_top_k(rows, lambda i: i % 20 == 0)


def test_search_on_odd_rows(spark):
    rng = np.random.default_rng(4)
    v = floats(rng.normal(size=(260, 8)))
    rows = list(zip(range(260), v, strict=True))
    rows += [(300 + i, v[40]) for i in range(300)]  # one vector many times: ties by vec_id
    rows += [(1, v[1]), (40, v[40]), (None, v[40]), (None, [9.0] * 8), (20, None), (60, [None, *v[0][1:]]), (80, [float("nan")] * 8), (100, [float("inf")] * 8), (5, [])]
    rows += [(120, [0.0] * 8), (2000, [1.0, 2.0]), (2020, [3.0e3] * 11), (2040, [1e7, -1e7]), (2041, [1e15] * 3), (2060, [1e17] * 3), (2080, [-1.0] * 8)]
    for how in ({}, {"buckets": 9, "block": 64, "least": 16}):
        assert search(spark, rows, **how) == plain_top_k(rows, lambda i: i is not None and i % 20 == 0)
    few = rows[:3] + [(20, [1.0] * 8)]
    assert search(spark, few) == plain_top_k(few, lambda i: i % 20 == 0)
    assert search(spark, [(1, [1.0])]) == [] and search(spark, []) == []


def test_each_way_of_pruning_gives_the_same(spark):
    """One block of queries and one of vectors: both prunings are used, and neither loses a product at its threshold."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(900, 12))
    v = np.floor(2000 * v / np.linalg.norm(v, axis=1)[:, None] * np.linspace(1.01, 1, 900)[:, None]).astype(np.int64)
    q = np.concatenate([v[20::22], np.floor(64 * rng.normal(size=(40, 12))).astype(np.int64)])
    p = {"row": np.arange(900), "vec_id": np.arange(900), "v": v, "length": np.sqrt((v * v).sum(axis=1).astype(float))}
    exact = q @ v.T
    used = Counter()
    old = topk.choose_cut

    def counted(cosines, left, long_enough):
        cut = old(cosines, left, long_enough)
        used["list"] += int((cosines >= cut).sum())
        used["length"] += int((cosines < cut).sum())
        return cut

    topk.choose_cut = counted
    try:
        need = np.array([np.sort(exact[i])[-1] if i < 40 else 1 for i in range(80)], float)
        at, found, scores = topk.search_block({"row": np.full(80, -1), "v": q, "length": np.sqrt((q * q).sum(axis=1).astype(float)), "threshold": need}, p, 900)
    finally:
        topk.choose_cut = old
    assert used["list"] and used["length"]
    want = {(i, j, int(exact[i, j])) for i in range(80) for j in range(900) if exact[i, j] >= need[i]}
    assert set(zip(at.tolist(), found.tolist(), scores.tolist(), strict=True)) == want


# --- the divergence


def plain_divergence(rows, min_docs=30, top=50):
    df, n = defaultdict(Counter), defaultdict(Counter)
    groups = defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang].add(source)
        df[lang].update(set(terms))
        n[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, c in df[lang].items() if c >= min_docs]
        share = lambda count, total, v=len(kept): 1 + 1_000_000_000 * (count + 5) // (total + 5 * v)
        totals = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        whole = sum(totals.values())
        p = {s: {t: share(n[lang, s][t], totals[s]) for t in kept} for s in sources}
        for s in sources:
            pair = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, p[s][t] - q) for t in kept if n[lang, s][t] and p[s][t] > (q := share(sum(n[lang, o][t] for o in sources), whole))]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def divergence_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergence_on_odd_rows(spark):
    rng = np.random.default_rng(6)
    vocabulary = ["The", "the", "THE", "straße", "Ärger", "ärger", "a", "b-c", "d_e", "x9y", "語", "𝒳", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = []
    for i in range(400):
        words = rng.choice(vocabulary, int(rng.integers(0, 30)))
        rows.append((" \n".join(words), ["en", "de", None, ""][i % 4 if i % 3 else 0], ["s1", "s2", None, "", "é", "z"][int(rng.integers(0, 6))]))
    rows += [(None, "en", "only"), ("", "fr", "a"), ("rare words", "fr", "b"), ("123 !", "fr", "c"), ("alone", "it", "a")] + [("the the the", "en", "s1")] * 50
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit(1), "n": F.lit(2), "df": F.lit(3), "k": F.lit(4), "item": F.lit(5)})
    got = divergence_rows(divergence.divergence(docs.repartition(7)))
    assert got == plain_divergence(rows)
    assert {r[0] for r in got} == {"", "en", "de", "fr"}
    assert divergence_rows(divergence.divergence(docs.limit(0))) == []


def test_divergence_without_broadcasts_and_in_large_counts(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang <> 'en'")
    want = plain_divergence([(r["text"], r["lang"], r["source"]) for r in docs.collect()])
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    assert divergence_rows(divergence.divergence(docs)) == want
    big = spark.range(1).select(divergence._share(F.lit(10**15), F.lit(3 * 10**16), F.lit(7)).alias("p")).first()["p"]
    assert big == 1 + 10**9 * (10**15 + 5) // (3 * 10**16 + 35)
