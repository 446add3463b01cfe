"""Near-duplicate documents by SimHash and multi-index hashing.

Documents with equal fingerprints form one class. Classes are linked where fingerprints differ in at most four bits.
A fingerprint is cut into segments; if two fingerprints differ in at most ``max_bits``, then in some segment they
differ in at most that segment's radius (the radii plus one each add up to ``max_bits`` + 1). So every fingerprint
enumerates the small Hamming ball around each of its segments, fetches the fingerprints that the segment tables hold
there, and verifies the complete distance inside the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, stored
from .graph import connected_components

SHINGLE = 4
MAX_BITS = 4
#: Above this many distinct fingerprints, two segments of 32 bits replace three of 21 or 22 (same links, rarer chance meetings).
WIDE_FROM = 1 << 24


def simhash64(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text: bit b is set if it is set in over half of the shingles' XXH64; zero without words."""
    import xxhash

    parts = (text or "").encode().lower().split()  # on bytes: A-Z only, ASCII white space only
    if not parts:
        return 0
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) < shingle:
        hashes = [digest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        starts = [0, *ends[:-shingle].tolist()]
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        some = np.array(hashes[at : at + 65536], dtype="<u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, id_column: str = "doc_id") -> DataFrame:
    """doc_id (or another column), fp (the 64 bits as a signed long) for every row; a null text has no words."""
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([simhash64(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.int64())], [id_column, "fp"])

    return docs.select(id_column, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{id_column} {id_type}, fp long")


def segments(n_segments: int, max_bits: int = MAX_BITS) -> list[tuple[int, int, int]]:
    """(offset, width, radius) of each segment; radius -1 segments are never needed and left out."""
    width, extra = divmod(64, n_segments)
    out, at = [], 0
    for k in range(n_segments):
        w = width + (k >= n_segments - extra)
        radius = (max_bits + 1) // n_segments + (k < (max_bits + 1) % n_segments) - 1
        if radius >= 0:
            out.append((at, w, radius))
        at += w
    return out


def ball(width: int, radius: int) -> list[int]:
    """Masks of up to ``radius`` bits among ``width``."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _key(fp: Column, k: int, offset: int, width: int) -> Column:
    part = F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    return part.bitwiseOR(F.lit(k << 40).cast("long"))


def near_links(distinct: DataFrame, max_bits: int = MAX_BITS, n_segments: int = 3) -> DataFrame:
    """(u, v): each pair of different fingerprints (column fp) at most ``max_bits`` apart, once."""
    plan = segments(n_segments, max_bits)
    table = F.array(*[_key(F.col("fp"), k, o, w) for k, (o, w, _) in enumerate(plan)])
    stored_side = distinct.select(F.explode(table).alias("key"), F.col("fp").alias("v"))
    probes = F.array(*[_key(F.col("fp"), k, o, w).bitwiseXOR(F.lit(m).cast("long")) for k, (o, w, r) in enumerate(plan) for m in ball(w, r)])
    probe_side = distinct.select(F.explode(probes).alias("key"), F.col("fp").alias("u"))
    near = (F.col("p.key") == F.col("s.key")) & (F.col("p.u") < F.col("s.v")) & (F.bit_count(F.col("p.u").bitwiseXOR(F.col("s.v"))) <= max_bits)
    return probe_side.alias("p").join(stored_side.alias("s"), near).select("u", "v").distinct()


def _linked_classes(prints: DataFrame, first: str, max_bits: int, n_segments: int | None) -> DataFrame:
    """fp, first (the smallest of this column), component for each distinct fp of ``prints``."""
    classes = stored(prints.groupBy("fp").agg(F.min(first).alias("first")), "classes")
    if n_segments is None:
        n_segments = 3 if classes.count() < WIDE_FROM else 2
    member = connected_components(near_links(classes, max_bits, n_segments))
    return classes.join(member, classes["fp"] == member["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, n_segments: int | None = None) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``.

    component_id is the smallest doc_id reachable over links; fingerprint-equal documents are linked too, those
    without words among them. A null doc_id belongs to its component but never names one; a component of null ids
    only has a null component_id. Repeated rows share everything. An empty table gives no rows; columns besides
    doc_id and text are ignored."""
    prints = stored(fingerprints(docs), "prints")
    linked = _linked_classes(prints, "doc_id", max_bits, n_segments)
    first = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    named = linked.join(first, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Exactly one row of every component, all columns: the one with the smallest doc_id.

    A null doc_id comes last; among rows that repeat a doc_id, the first by position stays. Where a doc_id stands with
    two texts, each row belongs to the component of its own text."""
    rows = stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW)
    prints = stored(fingerprints(rows.select(place.alias("place"), "text"), id_column="place"), "prints")
    kept = _linked_classes(prints, "place", max_bits, None).groupBy("component").agg(F.min("first").alias("first")).select(f"first.{ROW}")
    return rows.join(kept.hint("shuffle_hash"), ROW, "left_semi").select(*docs.columns)
