"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import plain
import pytest
from pyspark.sql import functions as F
from strandloom.llm import decontaminate, embed_classifier, linededup, packing, pagetext, quality_rules, sharding, simhash, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in ("shard", "slot", "n_lines", "fp", "row", "length", "score", "group", "level", "key", "item_id", "size"))
LINE = "the same line in many documents"
TEXTS = [
    (1, None), (2, ""), (3, " \t\n "), (4, f"{LINE}\nown line of number four\n{LINE}"), (5, f"{LINE.upper()}\nanother one"), (5, f"{LINE.upper()}\nanother one"), (None, f"  {LINE}\nnull id"),
    (6, "é" * 9 + "\n" + "é" * 10), (7, "É" * 10 + "\n" + "é" * 10 + "\r"), (8, "word " * 30_000), (9, "x" * 200_000), (10, "one two three"), (11, "one two three"),
    (12, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"), (13, "prefix ALPHA beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi suffix"), (14, "<|endoftext|> marks \U0001f600 the end"), (15, "  not ascii space "),
]
ITEMS = [("b1", "beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), ("b2", "one, two!"), ("b3", None), ("b4", "--"), (None, "marks"), ("b2", "one, two!")]


@pytest.fixture(scope="module")
def docs(spark):
    extra = [("clash",) * 12, (None,) * 12]
    return spark.createDataFrame([(d, t, None, "s", None, *extra[i % 2]) for i, (d, t) in enumerate(TEXTS)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(d, None if d == 2 else d % 2, d % 2) for d in range(1, 16)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id string, text string, row string")


def key(r):
    return tuple((x is not None, x) for x in r)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


def test_packing(docs):
    out = packing.pack(docs)
    per_doc = got(out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.count("*").alias("pieces")), "doc_id", "n", "pieces")
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(packing.default_vocabulary()[0]).encode
    want: dict = {}
    for d, t in TEXTS:
        n = len(encode(t or "", add_special_tokens=False).ids) + 1
        a, b = want.get(d, (0, 0))
        want[d] = a + n, b + -(-n // 2048)
    assert per_doc == sorted(((d, *v) for d, v in want.items()), key=key)
    whole = packing.packed_sequences(out).select("length", F.octet_length("ids").alias("bytes")).collect()
    assert all(r["bytes"] == 4 * r["length"] <= 4 * 2048 for r in whole)


def test_bounds():
    assert packing.piece_bounds(2048, 2048) == [(0, 2048)]
    assert packing.piece_bounds(2049, 2048) == [(0, 1), (1, 2048)]
    assert packing.piece_bounds(4096, 2048) == [(0, 2048), (2048, 2048)]


def test_simhash(docs):
    out = got(simhash.near_duplicates(docs), "doc_id", "fp", "component_id")
    plain_ids = [(99 if d is None else d, plain.simhash(t)) for d, t in TEXTS]  # a null id comes last here too
    want = sorted(((None if d == 99 else d, int(f, 16) - (1 << 64 if int(f, 16) >> 63 else 0), c) for d, f, c in plain.components(plain_ids)), key=key)
    assert [(d, f, 99 if c is None else c) for d, f, c in out] == want
    assert {c for d, _, c in out if d in (1, 2, 3)} == {1}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} - {None} == {c for _, _, c in out} - {None}


def test_radii_cover_all_distances():
    for n in (2, 3):
        plan = simhash.segments(n)
        assert sum(r + 1 for _, _, r in plan) == simhash.MAX_BITS + 1 and sum(w for _, w, _ in plan) == 64


def test_quality_rules(docs):
    out = got(quality_rules.quality_verdicts(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = [(d, *(m := plain.measures(t)), m[0] < 50 or 100 * m[4] > 50 * m[0]) for d, t in TEXTS]
    assert out == sorted(want, key=key)


def test_line_dedup(docs):
    out = linededup.dedup_lines(docs)
    assert out.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    rows = got(out.withColumn("sha", F.sha2("text", 256)), "doc_id", "n_lines", "n_dropped", "sha")
    with_ids = plain.line_dedup([(99 if d is None else d, t) for d, t in TEXTS])
    assert rows == sorted(((None if d == 99 else d, *r) for d, *r in with_ids), key=key)


def test_line_dedup_with_a_crowded_filter(docs, monkeypatch):
    """A filter far too small suspects nearly every line; the result is the same."""
    monkeypatch.setattr(linededup, "STRETCH", 64)
    small = linededup.dedup_lines(docs, max_filter_bytes=8)
    assert got(small, "doc_id", "n_dropped", "text") == got(linededup.dedup_lines(docs), "doc_id", "n_dropped", "text")


def test_decontamination(docs, benchmark):
    out = decontaminate.contamination(docs, benchmark)
    n_hit = F.aggregate("hit", F.lit(0), lambda a, s: a + s["last"] - s["first"])
    rows = got(out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").alias("n")), "doc_id", "n_words", "n_hit", "n")
    want = plain.contamination([(99 if d is None else d, t) for d, t in TEXTS], [(i or "", t) for i, t in ITEMS])
    assert rows == sorted(((None if d == 99 else d, n, h, k) for d, n, h, k, _, _ in want), key=key)
    kept = decontaminate.clean_documents(docs, benchmark)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, *_, bad in want if not bad and d != 99} | {None}


def test_decontamination_by_blocks(docs, benchmark):
    blocks = decontaminate.contamination(docs, benchmark, max_windows=2)
    whole = decontaminate.contamination(docs, benchmark)
    columns = ("doc_id", "n_words", F.to_json(F.struct("hit", "where", "items")).alias("j"))
    assert got(blocks, *columns) == got(whole, *columns)


def test_offsets_name_the_original_text(docs, benchmark):
    r = decontaminate.contamination(docs, benchmark).filter("doc_id = 13").first()
    text = dict(TEXTS)[13]
    assert [text[w["begin"] : w["end"]] for w in r["where"]] == ["beta gamma delta epsilon zeta eta theta iota kappa lambda mu"]


def test_sharding(docs):
    out = got(sharding.assign_shards(docs, shards=4), "doc_id", "size", "shard", "slot")
    assert [r[:2] for r in out] == sorted(((d, len((t or "").encode()) + 1) for d, t in TEXTS), key=key)
    for s in range(4):
        slots = sorted(r[3] for r in out if r[2] == s)
        assert slots == list(range(len(slots)))


def test_classifiers(docs, labels):
    for op, label in ((embed_classifier.classify, "quality"), (toxicity.toxicity, "toxic")):
        out = op(docs, labels, label)
        assert out.columns == ["doc_id", "held_out", "score", "predicted"]
        found = out.collect()
        assert len(found) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
        assert len({r["score"] for r in found if r["doc_id"] in (1, 2, 3)}) == 1
        none = op(docs, labels.limit(0), label).collect()
        assert len(none) == len(TEXTS)
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_pages(spark):
    rows = [(1, None, None, "t"), (2, "http://a.b/x", "", None), (3, "http://a.b/x", "<p>one", "t"), (3, "http://a.b/x", "<p>one", "t"), (None, None, "<article><p>x &amp; y</article>", "t"), (4, "c", "plain " * 50_000, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = got(pagetext.main_text(pages), "page_id", "url", "text")
    assert out == sorted([(1, None, ""), (2, "http://a.b/x", ""), (3, "http://a.b/x", "one"), (3, "http://a.b/x", "one"), (None, None, "x & y"), (4, "c", ("plain " * 50_000).strip())], key=key)
    stored = got(warc.archive_pages(pages), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert [r[1] for r in stored] == [31, 0, 0, 6, 6, 300_000]
    assert [(r[3], r[4]) for r in stored] == [("response", None), ("response", None), ("revisit", 1), ("response", None), ("revisit", 3), ("response", None)]


@pytest.mark.parametrize("op", [
    lambda d, labels, b: packing.pack(d), lambda d, labels, b: simhash.near_duplicates(d), lambda d, labels, b: simhash.keep_one(d), lambda d, labels, b: quality_rules.quality_verdicts(d), lambda d, labels, b: linededup.dedup_lines(d),
    lambda d, labels, b: decontaminate.contamination(d, b), lambda d, labels, b: sharding.assign_shards(d), lambda d, labels, b: embed_classifier.classify(d, labels), lambda d, labels, b: toxicity.toxicity(d, labels),
    lambda d, labels, b: pagetext.main_text(d.selectExpr("doc_id as page_id", "source as url", "text as html")), lambda d, labels, b: warc.archive_pages(d.selectExpr("doc_id as page_id", "source as url", "text as html")),
])
def test_empty_tables(docs, labels, benchmark, op):
    assert op(docs.limit(0), labels.limit(0), benchmark.limit(0)).count() == 0


def test_empty_benchmark(docs, benchmark):
    out = decontaminate.contamination(docs, benchmark.limit(0))
    assert out.count() == len(TEXTS) and out.filter(F.size("items") > 0).count() == 0
    assert decontaminate.clean_documents(docs, benchmark.limit(0)).count() == len(TEXTS)




def test_page_ids_over_all_longs(spark):
    top = (1 << 63) - 1
    pages = spark.createDataFrame([(9 * 10**18, "http://a/", "x"), (9 * 10**18 + 1, "http://a/", "x"), (-top - 1, "http://a/", "y"), (top, "u", "z"), (None, "u", "x")], "page_id long, url string, html string")
    out = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.archive_pages(pages).collect()}
    assert out == {9 * 10**18: ("response", None), 9 * 10**18 + 1: ("revisit", 9 * 10**18), -top - 1: ("response", None), top: ("response", None), None: ("revisit", 9 * 10**18)}
    assert [warc.page_number(t) for t in (str(top + 1), "1x", "", None, "-7")] == [None, None, None, None, -7]


def test_toxicity_learns_one_text_of_a_repeated_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "discover_voters", lambda rows: seen.append(rows.count()) or tuple((w, 1) for w in toxicity.LEXICON))
    docs = spark.createDataFrame([(d, t) for d in range(1, 9) for t in (f"text {d}", "an idiot" if d % 2 else "kind", "more")] * 5, "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in range(1, 9)], "doc_id long, toxic int")
    toxicity.train(docs, labels, "toxic", F.lit(False))
    assert seen == [8]


def test_one_round_of_fitting_is_one_job_whatever_the_partitions(spark):
    import numpy as np

    k = 3
    rows = [(bytes(np.packbits(np.array([i & 1, i >> 1 & 1, i >> 2 & 1], np.uint8))), i, 2 * i, 1) for i in range(8)]
    patterns = spark.createDataFrame(rows, "pattern binary, n long, clean long, toxic long").repartition(16)
    sc = spark.sparkContext
    sc.setJobGroup("summed", "")
    got = toxicity._summed(patterns, k, lambda v, n: v.T.astype(float) @ n, 9).reshape(3, 3)
    assert len(sc.statusTracker().getJobIdsForGroup("summed")) <= 3
    sc.setJobGroup("other", "")
    bits = np.array([[i & 1, i >> 1 & 1, i >> 2 & 1] for i in range(8)], float)
    assert (got == bits.T @ np.array([[i, 2 * i, 1] for i in range(8)], float)).all()
