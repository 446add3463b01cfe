"""A manifest of a dataset as a tree of digests, built and proved by supersteps over an RDD.

Each row is a leaf. The leaves of a source, in order of doc_id, are the leaves of its tree; runs of three nodes become their
parent until one node is left, the source's subroot. Subroots, in order of source, are the leaves of one more tree; its last
node is the root. In an upward superstep every node of a level messages its parent (its place and digest), and a parent that
has all of its children hashes them and forwards. In a downward superstep every parent messages the path of siblings that it
got, with its own run put before it, to its children; at the leaves the paths are complete, and each leaf folds its row, as it
is read now, up to the root.

Vertices are dealt by blocks of 3 ^ ``LEVELS`` neighbours. For that many levels parents live with their children, so these
supersteps move nothing; only the tops of blocks are shuffled, one node for 243 leaves, and checkpointed, which cuts the
lineage. A source with a third of all rows is many blocks. The rank of a leaf comes from a range partitioning: counts by
source and partition give each partition's offset. Only the number of levels, the number of sources and the root are known to the driver."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_of_id, shared_dir, stored

FAN, LEVELS = 3, 5
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a range partition, about.
RANGE_ROWS = 200_000


def hashed(*digests: bytes) -> bytes:
    """H of digests: SHA-256 of their hex texts in a row."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def leaf_digest(fields: dict[str, Column]) -> Column:
    """H of the five fields: ``-`` for null, else the count of UTF-8 bytes, ``:`` and the value."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[part(fields[c].cast("string")) for c in FIELDS]), 256)


def _tree(key: tuple[object, int, int]) -> int:
    """Where a vertex (tree, block, place in its block) lives: with its block."""
    return hash((key[0], key[1]))


def _upward(level: RDD, parts: int) -> RDD:
    """One superstep: (tree, block, place) -> (digest, nodes of the level in the tree, digests of the children).

    A node that is alone in its level is the tree's last one; it is passed on as it is, without children."""

    def message(nodes: Iterator[tuple]) -> Iterator[tuple]:
        for (tree, block, place), (digest, n, _) in nodes:
            yield (tree, block, place // FAN), (place, digest, n)

    def complete(item: tuple) -> tuple:
        (tree, block, place), messages = item
        run = sorted(messages)
        n = run[0][2]
        if n == 1:
            return (tree, block, place), (run[0][1], 1, None)
        return (tree, block, place), (hashed(*(m[1] for m in run)), -(-n // FAN), tuple(m[1] for m in run))

    sent = level.mapPartitions(message, preservesPartitioning=True)
    return sent.groupByKey(parts, _tree).mapPartitions(lambda items: map(complete, items), preservesPartitioning=True)


def _downward(parents: RDD, paths: RDD) -> RDD:
    """One superstep back: each parent sends its path, its own run before it, to its children.

    A path is (the tree's last digest, (digests to the left, digests to the right) level by level)."""

    def message(items: Iterator[tuple]) -> Iterator[tuple]:
        for (tree, block, place), ((_, _, run), (top, path)) in items:
            if run is None:
                yield (tree, block, place * FAN), (top, path)
            for i in range(len(run or ())):
                yield (tree, block, place * FAN + i), (top, ((run[:i], run[i + 1 :]), *path))

    return parents.join(paths).mapPartitions(message, preservesPartitioning=True)


class Forest:
    """Trees over leaves ((tree, index), (digest, number of leaves of the tree)), of at most ``most`` leaves each."""

    def __init__(self, leaves: RDD, most: int, parts: int) -> None:
        self.steps: list[list[RDD]] = []
        self.parts = parts
        nodes, width = leaves, most
        while True:
            placed = nodes.map(lambda x: ((x[0][0], x[0][1] // BLOCK, x[0][1] % BLOCK), (*x[1], None))).partitionBy(parts, _tree)
            levels = [placed]
            for _ in range(LEVELS):
                levels.append(_upward(levels[-1], parts).persist(StorageLevel.DISK_ONLY))
            self.steps.append(levels)
            nodes = levels[-1].map(lambda x: ((x[0][0], x[0][1]), (x[1][0], x[1][1])))
            nodes.checkpoint()
            nodes.count()
            width = -(-width // BLOCK)
            if width <= 1:
                break
        self.tops = nodes.map(lambda x: (x[0][0], x[1][0]))

    def paths(self, tops: RDD) -> RDD:
        """(tree, block, place) of each leaf -> (the tree's last digest, path), where ``tops`` gives (tree, (digest, path)) of
        the last nodes."""
        at = tops.map(lambda x: ((x[0], 0), x[1]))
        for levels in reversed(self.steps):
            found = at.map(lambda x: ((x[0][0], x[0][1], 0), x[1])).partitionBy(self.parts, _tree)
            for parents in reversed(levels[1:]):
                found = _downward(parents, found)
            at = found.map(lambda x: ((x[0][0], x[0][1] * BLOCK + x[0][2]), x[1]))
        return found

    def release(self) -> None:
        for levels in self.steps:
            for level in levels[1:]:
                level.unpersist()


def ranked_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf and now (digest of the row as it is and as it may be later, both hex), place (from 0 in its source), n (rows of the source)."""
    fields = {c: F.col(c) for c in FIELDS}
    later = fields | {"text": F.when(crc32_of_id(F.col("doc_id")) % 2 == 0, F.translate(F.col("text").cast("string"), "\n", "")).otherwise(F.col("text").cast("string"))}
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), leaf_digest(fields).alias("leaf"), leaf_digest(later).alias("now"))
    rows = stored(rows, "leaves")
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // RANGE_ROWS))
    order = ("source", "doc_id", "leaf")
    rows = stored(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    counts = rows.groupBy("source", "part").agg(F.count("*").alias("n"))
    of = Window.partitionBy("source")
    before = F.coalesce(F.sum("n").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("source").alias("of"), F.col("part").alias("in"), before.alias("before"), F.sum("n").over(of).alias("n"))
    inside = F.row_number().over(Window.partitionBy("source", "part").orderBy("doc_id", "leaf")) - 1
    joined = rows.withColumn("inside", inside).join(counts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
    return joined.select("doc_id", "source", "leaf", "now", (F.col("before") + F.col("inside")).alias("place"), "n")


def numbered_sources(sources: DataFrame) -> DataFrame:
    """source, number (from 0, null first, then by UTF-8 bytes), without one task for all of them."""
    spark = sources.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-sources.count() // RANGE_ROWS))
    ranged = stored(sources.repartitionByRange(parts, "source").withColumn("part", F.spark_partition_id()), "sources")
    counts = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}  # a row a partition
    start, starts = 0, {}
    for p in sorted(counts):
        starts[p] = start
        start += counts[p]
    offset = F.element_at(F.create_map(*[F.lit(int(x)) for pair in (starts or {0: 0}).items() for x in pair]), F.col("part"))
    return ranged.select("source", (offset + F.row_number().over(Window.partitionBy("part").orderBy("source")) - 1).alias("number"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of ``docs``.

    The first four digests, and the proof (of all siblings from the leaf to the root), are of the rows as they are; folded_root is
    recomputed from the row after tampering, which deletes line feeds from the texts of half of the doc_ids. Null fields are
    ``-`` in a leaf; rows without doc_id come first in their source (and count as doc_id '' where tampering chooses), rows that
    repeat a doc_id follow each other by digest. Rows without source are a source of their own, before all others. An empty
    table gives no rows; columns besides doc_id, source, lang, n_chars and text are ignored."""
    spark = docs.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    columns = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {columns}"
    leaves = ranked_leaves(docs)
    sources = numbered_sources(leaves.groupBy("source").agg(F.max("n").alias("n")).select("source", "n"))
    leaves = leaves.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    leaves = stored(leaves.select("doc_id", "leaf", "now", "number", "place", "n"), "places")
    most, trees = leaves.agg(F.max("n"), F.max("number")).first()
    if most is None:
        return spark.createDataFrame([], schema)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = leaves.select("number", "place", "leaf", "n").rdd.map(lambda r: ((r[0], r[1]), (bytes.fromhex(r[2]), r[3])))
    below = Forest(given, most, parts)
    n_trees = trees + 1
    above = Forest(below.tops.map(lambda x: ((0, x[0]), (x[1], n_trees))), n_trees, parts)
    root = above.tops.first()[1]
    over = above.paths(above.tops.mapValues(lambda top: (top, ())))
    tops = over.map(lambda x: (x[0][1] * BLOCK + x[0][2], x[1][1])).join(below.tops, parts).mapValues(lambda x: (x[1], x[0]))
    paths = below.paths(tops)

    rows = leaves.select("number", "place", "doc_id", "leaf", "now").rdd.map(lambda r: ((r[0], r[1] // BLOCK, r[1] % BLOCK), (r[2], r[3], r[4]))).partitionBy(parts, _tree)

    def verify(items: Iterator[tuple]) -> Iterator[tuple]:
        for _, ((doc_id, leaf, now), (subroot, path)) in items:
            folded = bytes.fromhex(now)
            for left, right in path:
                folded = hashed(*left, folded, *right)
            proof = hashed(*(d for left, right in path for d in (*left, *right)))
            yield doc_id, leaf, subroot.hex(), root.hex(), proof.hex(), folded.hex(), folded == root

    return spark.createDataFrame(rows.join(paths).mapPartitions(verify), schema, verifySchema=False)
