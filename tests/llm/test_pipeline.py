"""Each stage of the pipeline on its own input against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter

import corpus_pipeline
import plain
import pytest
from strandloom.llm import toxicity
from strandloom.llm.common import stored, table
from test_contracts import check_packing


def pairs(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"test-{name}")
        steps[name] = before, docs
        if name != "packing":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes

    before, after = steps["toxicity"]
    bad = {r["doc_id"] for r in toxicity.toxicity(before, table(spark, sf_dir, "labels")).filter("predicted = 1").collect()}
    assert pairs(after) == [(d, t) for d, t in pairs(before) if d not in bad] and bad

    before, after = steps["line_dedup"]
    digests = lambda rows: {d: (n - k, h) for d, n, k, h in rows}
    want = digests(plain.line_dedup(pairs(before)))
    assert {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in pairs(after)} == {d: h for d, (_, h) in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())

    before, after = steps["near_dedup"]
    found = plain.components([(d, plain.simhash(t)) for d, t in pairs(before)])
    assert pairs(after) == [(d, t) for d, t in pairs(before) if d in {c for _, _, c in found}]

    before, after = steps["decontamination"]
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    clean = {r[0] for r in plain.contamination(pairs(before), items) if not r[-1]}
    assert pairs(after) == [(d, t) for d, t in pairs(before) if d in clean]

    before, after = steps["packing"]
    from strandloom.llm import packing
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(packing.default_vocabulary()[0]).encode
    check_packing(sorted(map(tuple, after.collect())), {d: [*encode(t or "", add_special_tokens=False).ids, 0] for d, t in pairs(before)})


LEAK = "a leaked passage of the benchmark that stands in this document word for word from its first to its last"
EDGE_ROWS = [
    (1, None), (2, ""), (3, " \t\n "), (5, "the same line of two documents\nown line of five"), (5, "the same line of two documents\nown line of five"), (7, "The same line of two documents  \nown line of seven"),
    (None, "the same line of two documents\nand a null id"), (None, LEAK), (None, "nothing to find in this text of a row without id"), (8, LEAK.upper()), (8, "clean text under an id that a leak has too"),
    (9, "word " * 20_000), (10, "x" * 100_000), (11, "idiot moron scum trash worthless pathetic disgusting stupid clown loser " * 3), (12, " " * 50_000 + "spaces before"),
]


@pytest.fixture(scope="module")
def edge_docs(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars int, n_lines string, n_dropped string, fp string, `group` string, level string, piece string, row string, place string, label string, size string"
    return spark.createDataFrame([(d, t, None, "s", None, *["clash"] * 10) for d, t in EDGE_ROWS], schema).repartition(3)


@pytest.fixture(scope="module")
def edge_dir(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("edges")
    table(spark, sf_dir, "labels").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("b1", LEAK, "x"), ("b2", None, "x"), (None, "--", "x")], "item_id string, text string, row string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_on_odd_rows(spark, edge_docs, edge_dir):
    """Null and repeated ids, empty and long texts, clashing columns: what each stage does with them is its docstring's."""
    stages = dict(corpus_pipeline.STAGES)
    counted = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    all_rows = Counter(EDGE_ROWS)

    toxic = stages["toxicity"](spark, edge_docs, edge_dir)
    assert toxic.columns == edge_docs.columns and counted(toxic) == all_rows - Counter([EDGE_ROWS[13]])

    lines = stages["line_dedup"](spark, edge_docs, edge_dir)
    # the smallest id keeps a line, in all its rows; rows without id are one document after all others
    assert lines.columns == edge_docs.columns and lines.dtypes == edge_docs.dtypes
    cut = {(7, EDGE_ROWS[5][1]): "own line of seven", (None, EDGE_ROWS[6][1]): "and a null id", (8, LEAK.upper()): LEAK.upper(), (None, LEAK): "", (1, None): ""}
    assert counted(lines) == Counter((d, cut.get((d, t), t)) for d, t in EDGE_ROWS)

    near = stages["near_dedup"](spark, edge_docs, edge_dir)
    gone = Counter([(2, ""), (3, " \t\n "), EDGE_ROWS[3], (None, LEAK)])  # empty like document 1; repeats 5; the passage in capitals of 8
    kept = counted(near)
    assert near.columns == edge_docs.columns and kept == all_rows - gone

    clean = stages["decontamination"](spark, edge_docs, edge_dir)
    assert clean.columns == edge_docs.columns and counted(clean) == all_rows - Counter([(None, LEAK), (8, LEAK.upper())])

    packed = stages["packing"](spark, edge_docs, edge_dir).collect()
    assert sum(r["piece"] == 0 for r in packed) == len(EDGE_ROWS)


def test_stages_on_empty_tables(spark, edge_docs, edge_dir, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{edge_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, edge_docs.limit(0), edge_dir).count() == 0
        some = stage(spark, edge_docs, str(tmp_path))
        if name in ("toxicity", "decontamination"):
            assert some.count() == len(EDGE_ROWS) - (name == "toxicity")
