"""Removal of lines that repeat across documents.

A first pass sets bits for the keys of each document in two Bloom filters: one for keys seen once, one for keys seen
again. Partial filters of tasks merge exactly: seen = a | b, seen again = A | B | (a & b), so no repeat is missed.
The filters grow with the number of lines, up to ``max_filter_bytes``, and the second goes to all tasks. A second
pass lets only suspected repeats through; these are confirmed by their whole key, and the smallest doc_id that holds a
key keeps it. Only documents that may lose a line, again by a filter, are shuffled and joined with what they lose; all
others pass by. If a corpus overfills the filters, more lines are suspected and shuffled, and the result is the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, stored

MIN_KEY = 10
#: Bits of one stretch of the filter, the unit in which partial filters travel.
STRETCH = 1 << 18
MAX_FILTER_BYTES = 64 << 20
_STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip(_STRIP).lower()


def _long_keys(text: str | None, min_key: int) -> set[bytes]:
    keys = {line_key(x) for x in (text or "").encode().split(b"\n")}
    # a key of at least n code points has at least n bytes
    return {k for k in keys if len(k) >= min_key and (len(k) >= 4 * min_key or len(k.decode()) >= min_key)}


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """Two bit positions for each hash, shape (2, n)."""
    m = np.uint64(bits - 1)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.stack([h & m, (h >> np.uint64(32)) & m]).astype(np.int64)


def _get(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _set(packed: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(packed, at.ravel() >> 3, np.uint8(1) << (at.ravel() & 7).astype(np.uint8))


def may_hold(packed: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Whether each hash may be in the packed filter."""
    at = _places(h, bits)
    return _get(packed, at[0]) & _get(packed, at[1])


def filter_bits(n_keys: int, max_filter_bytes: int = MAX_FILTER_BYTES) -> int:
    """A power of two of at least 16 bits a key, one stretch at least and the bound at most."""
    want = max(STRETCH, 16 * max(n_keys, 1))
    return min(1 << (want - 1).bit_length(), 1 << ((8 * max_filter_bytes).bit_length() - 1))


def partial_filters(rows: DataFrame, bits: int, hashes: Callable[[pa.Array], Iterator[np.ndarray]]) -> DataFrame:
    """The filters of each task over the one column of ``rows``; each array that ``hashes`` yields counts as one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for h in hashes(batch.column(0)):
                if h.size:
                    at = _places(h, bits)
                    seen = _get(once, at[0]) & _get(once, at[1])
                    _set(again, at[:, seen])
                    _set(once, at)
        size = STRETCH // 8
        for k in range(bits // STRETCH):
            part = slice(k * size, (k + 1) * size)
            if once[part].any():
                pack = lambda x: pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pack(once[part]), pack(again[part])], ["stretch", "once", "again"])

    return rows.mapInArrow(run, "stretch int, once binary, again binary")


def folded_filters(partial: DataFrame, bits: int, which: str) -> DataFrame:
    """stretch, bits of the filter ``which`` ("once" or "again") of all tasks. Each task folds the stretches dealt to it, one
    partial filter at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        load = lambda raw: np.frombuffer(zlib.decompress(raw), np.uint8)
        for batch in batches:
            for k, once, again in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                a, b = load(once), load(again)
                if k in held:
                    x, y = held[k]
                    a, b = x | a, y | b | (x & a)
                held[k] = a, b
        for k, (a, b) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress((a if which == "once" else b).tobytes(), 1)], pa.binary())], ["stretch", "bits"])

    return partial.repartition(max(1, min(bits // STRETCH, 64)), "stretch").mapInArrow(run, "stretch int, bits binary")


def merged_filter(partial: DataFrame, bits: int, which: str) -> np.ndarray:
    """The packed filter ``which`` of all tasks; the driver holds the whole, max_filter_bytes at most."""
    return packed_filter(folded_filters(partial, bits, which), bits)


def packed_filter(folded: DataFrame, bits: int) -> np.ndarray:
    whole = np.zeros(bits // 8, np.uint8)
    for k, raw in folded.toLocalIterator():
        whole[k * STRETCH // 8 : (k + 1) * STRETCH // 8] = np.frombuffer(zlib.decompress(raw), np.uint8)
    return whole


def repeated_filter(docs: DataFrame, min_key: int = MIN_KEY, max_filter_bytes: int = MAX_FILTER_BYTES) -> tuple[np.ndarray, int]:
    """The packed filter of keys seen in two rows at least, and its bits."""
    lines = F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    bits = filter_bits(docs.agg(lines).first()[0] or 0, max_filter_bytes)
    keys = lambda column: (_hashes(list(_long_keys(t, min_key))) for t in column.to_pylist())
    return merged_filter(partial_filters(docs.select("text"), bits, keys), bits, "again"), bits


def _suspects(docs: DataFrame, packed: np.ndarray, bits: int, min_key: int) -> DataFrame:
    """doc_id, text_hash, key: the keys of each row that may stand in other rows."""
    sent = docs.sparkSession.sparkContext.broadcast(packed)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                keys = list(_long_keys(text, min_key))
                found = np.flatnonzero(may_hold(sent.value, _hashes(keys), bits)) if keys else ()
                out += [keys[j].decode() for j in found]
                row += [i] * len(found)
            index = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), pa.array(out, pa.string())], ["doc_id", "text_hash", "key"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {id_type}, text_hash long, key string")


def _touched(spark: SparkSession, lost: DataFrame, max_filter_bytes: int) -> Callable[[Column], Column]:
    """A test of row hashes: false only for rows that lose nothing."""
    bits = filter_bits(lost.count(), max_filter_bytes)
    some = merged_filter(partial_filters(lost.select("__row_hash"), bits, lambda column: iter([column.to_numpy(zero_copy_only=False).view(np.uint64)])), bits, "once")
    sent = spark.sparkContext.broadcast(some)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(may_hold(sent.value, h.to_numpy(np.int64).view(np.uint64), bits))

    return test


def dedup_lines(docs: DataFrame, min_key: int = MIN_KEY, max_filter_bytes: int = MAX_FILTER_BYTES, counts: bool = True) -> DataFrame:
    """``docs`` with text replaced by its kept lines, plus n_lines (before) and n_dropped if ``counts``.

    A key of ``min_key`` code points or more that stands in two documents at least loses all its lines except in the
    smallest doc_id that holds it. Rows that repeat a doc_id are one document, so they don't repeat each other. A null
    doc_id is one document after all others. A null or empty text is one empty line and becomes the empty text.
    With counts, columns named n_lines or n_dropped are replaced; all others pass through. An empty table gives no rows."""
    spark = docs.sparkSession
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    packed, bits = repeated_filter(plain, min_key, max_filter_bytes)
    suspects = stored(_suspects(plain, packed, bits, min_key), "suspects")
    some, nulls = F.count("doc_id"), F.count(F.when(F.col("doc_id").isNull(), 1))
    confirmed = suspects.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), some.alias("n"), nulls.alias("n_null"))
    # read back from a table, both sides of the join are dealt for it alone, so Spark may split the rows of a hot line
    confirmed = stored(confirmed.filter("first_id <> last_id or (n > 0 and n_null > 0)").select("key", "first_id"), "confirmed")
    lost = suspects.join(confirmed, "key").filter(~F.col("doc_id").eqNullSafe(F.col("first_id")))
    # by id and text, so that a set holds lines of one text only, also where many rows have no id
    lost = lost.groupBy("doc_id", "text_hash").agg(F.collect_set("key").alias("__lost"))
    lost = stored(lost.select(F.xxhash64("doc_id", "text_hash").alias("__row_hash"), F.col("doc_id").alias("__lost_id"), F.col("text_hash").alias("__lost_hash"), "__lost"), "lost")
    drop_stored(suspects, confirmed)
    test = _touched(spark, lost, max_filter_bytes)

    base = (docs.drop("n_lines", "n_dropped") if counts else docs).withColumn("text", F.col("text").cast("string"))
    names = base.columns
    at = names.index("text")
    row_hash = F.xxhash64("doc_id", F.xxhash64("text"))
    text = F.coalesce("text", F.lit(""))
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    whole = base.filter(~test(row_hash)).withColumns({"text": text} | ({"n_lines": n_lines, "n_dropped": F.lit(0).cast("long")} if counts else {}))
    same = (row_hash == F.col("__row_hash")) & base["doc_id"].eqNullSafe(F.col("__lost_id")) & (F.xxhash64(base["text"]) == F.col("__lost_hash"))
    wide = base.filter(test(row_hash)).join(lost.hint("shuffle_hash"), same, "left").select(*[F.col(f"`{c}`") for c in names], "__lost")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, lost_keys in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                lines = (text or "").encode().split(b"\n")
                gone = {k.encode() for k in lost_keys or ()}
                kept = [x for x in lines if line_key(x) not in gone] if gone else lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                texts.append(b"\n".join(kept).decode())
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            if counts:
                columns += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_lines", "n_dropped"][: len(columns)])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return whole.unionByName(wide.mapInArrow(rebuild, fields + ", n_lines long, n_dropped long" * counts))
