"""Each operator's query over the small tables against the contract written plainly."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import plain
import pytest
from strandloom.llm import packing
from strandloom.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def rows(spark, sf_dir, name, *columns):
    return sorted(tuple(r) for r in QUERIES[name](spark, sf_dir).select(*columns).collect())


def best_fit_count(lengths, capacity=2048):
    gaps, opened = defaultdict(int), 0
    for n in sorted(lengths, reverse=True):
        g = next((g for g in range(n, capacity) if gaps[g]), None)
        if g is None:
            opened, g = opened + 1, capacity
        else:
            gaps[g] -= 1
        gaps[g - n] += 1
    return opened


def check_packing(out, expected_ids, capacity=2048):
    """out: rows of op1; expected_ids: the ids of each document."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for doc, piece, start, length, crc, seq, offset in out:
        pieces[doc].append((piece, start, length, crc))
        sequences[seq].append((offset, length))
    assert pieces.keys() == expected_ids.keys()
    for doc, ids in expected_ids.items():
        at = 0
        for k, (piece, start, length, crc) in enumerate(sorted(pieces[doc])):
            assert (piece, start) == (k, at) and crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())
            assert length == capacity or k == 0
            at += length
        assert at == len(ids) and (len(ids) > capacity) == (len(pieces[doc]) > 1)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    # matched in sweeps, the number of sequences stays close to that of one-by-one best-fit
    lengths = [r[3] for r in out]
    assert len(sequences) <= 1.03 * best_fit_count(lengths) + 2


def test_packing(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(packing.default_vocabulary()[0])
    ids = {d: [*encoder.encode(t or "", add_special_tokens=False).ids, 0] for d, t in docs}
    check_packing(rows(spark, sf_dir, "op1_best_fit_packing", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"), ids)


def test_simhash(spark, sf_dir, docs):
    assert rows(spark, sf_dir, "op3_simhash", "doc_id", "fingerprint", "component_id") == plain.components([(d, plain.simhash(t)) for d, t in docs])


def test_quality_rules(spark, sf_dir, docs):
    out = rows(spark, sf_dir, "op4_quality_rules", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    expected = sorted((d, *plain.measures(t)) for d, t in docs)
    assert [r[:6] for r in out] == expected
    for _, n, _, _, _, repeated, failed, kept in out:
        assert failed == (n < 50 or 100 * repeated > 50 * n) and not (failed and kept)
    assert sum(r[7] for r in out) > 0.5 * sum(not r[6] for r in out)


def test_warc(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()]
    out = QUERIES["op6_warc"](spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, out), key=lambda r: r[0]) == plain.archive(pages)


def test_line_dedup(spark, sf_dir, docs):
    assert rows(spark, sf_dir, "op8_line_dedup", "doc_id", "n_lines", "n_dropped", "kept_sha256") == plain.line_dedup(docs)


def test_decontamination(spark, sf_dir, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    out = rows(spark, sf_dir, "op10_decontamination", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert out == plain.contamination(docs, items)


def test_sharding(spark, sf_dir, docs):
    out = rows(spark, sf_dir, "op9_sharding", "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    assert [r[:3] for r in out] == sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    slots, load = defaultdict(list), defaultdict(int)
    for _, size, _, law, shard, slot, grown in out:
        assert law == "bytes" and 0 <= shard < 16 and grown is None
        slots[shard].append(slot)
        load[shard] += size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r[1] for r in out)
    assert max(load.values()) <= sum(load.values()) / 16 + largest


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = QUERIES[name](spark, sf_dir)
    want = con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))
