"""Shards of near equal bytes by vector bin packing over bytes, tokens and rows.

Documents of equal text form a group. Groups above 1/``resolution`` of a shard in any measure are units of their own
(there are at most 3 x shards x resolution of those); the others are gathered by hash in shards x resolution cells,
which are units too. So the number of units is bounded, whatever the input. Units are placed in order of falling size
where the dot product of their vector with a shard's residual capacity is highest, and then moved while that lowers the
worst measure. A group of over a shard's capacity is dealt in parts by row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, stored

SHARDS = 16
RESOLUTION = 512
#: Slots are numbered inside buckets of about this many rows, then shifted by the buckets before.
BUCKET_ROWS = 50_000
BYTES_WEIGHT = 4.0
MEASURES = ("bytes", "tokens", "rows")


def place(units: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unit (rows of ``units``: shares of the total by measure). Among the shards with room in every
    measure, or else in bytes, the highest dot product with the residual wins, the lowest number on ties."""
    left = np.full((shards, units.shape[1]), 1.0 / shards)
    out = np.zeros(len(units), np.int32)
    for i in np.lexsort((np.arange(len(units)), -units.max(axis=1))):
        unit = units[i]
        fits = left >= unit
        room = fits.all(axis=1) if fits.all(axis=1).any() else fits[:, 0]
        k = int(np.argmax(np.where(room, left @ unit, -np.inf))) if room.any() else int(np.argmax(left[:, 0]))
        left[k] -= unit
        out[i] = k
    return out


def level(units: np.ndarray, where: np.ndarray, shards: int, rounds: int = 4000) -> np.ndarray:
    """Move units out of the shard that is fullest in any measure while that lowers the worst of the two shards. Bytes,
    the law, count ``BYTES_WEIGHT`` times as much as the other measures."""
    units = units * np.array([BYTES_WEIGHT] + [1.0] * (units.shape[1] - 1))
    load = np.stack([np.bincount(where, units[:, m], minlength=shards) for m in range(units.shape[1])], axis=1) - units.sum(axis=0) / shards
    for _ in range(rounds):
        a, m = np.unravel_index(int(load.argmax()), load.shape)
        mine = np.flatnonzero(where == a)
        best = (load[a].max() - 1e-15, -1, -1)
        for b in np.argsort(load[:, m])[: max(1, shards // 4)]:
            if b != a and len(mine):
                worst = np.maximum((load[a] - units[mine]).max(axis=1), (load[b] + units[mine]).max(axis=1))
                j = int(worst.argmin())
                best = min(best, (float(worst[j]), int(mine[j]), int(b)))
        if best[1] < 0:
            break
        _, j, b = best
        where[j] = b
        load[a] -= units[j]
        load[b] += units[j]
    return where


def assign_shards(docs: DataFrame, shards: int = SHARDS, resolution: int = RESOLUTION, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, shard, slot for every row of ``docs``.

    Null texts have no bytes and share a group with empty ones. Equal texts share a shard unless they exceed its
    capacity in some measure; then their rows are dealt evenly, also where they share a doc_id. Slots run from 0 without
    gaps in each shard, in an order fixed by the stored input. An empty table gives no rows; columns besides doc_id, text
    and those of ``carry`` are ignored."""
    carried = list(carry)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(*carried, "doc_id", text.alias("text")).select(
        *carried, "doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("group"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
    )
    narrow = stored(narrow, "sizes")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    groups = stored(narrow.groupBy("group").agg(*sums), "groups")
    total = np.array(groups.agg(*[F.sum(m) for m in MEASURES]).first(), dtype=object)
    buckets = 16 + int(total[2] or 0) // (shards * BUCKET_ROWS)
    if total[0] is None:
        total = np.zeros(3)
    total = np.maximum(total.astype(float), 1.0)
    n_cells = shards * resolution
    most = F.greatest(*[F.col(m) / float(t) for m, t in zip(MEASURES, total, strict=True)])
    heavy = groups.filter(most > 1.0 / n_cells).withColumn("parts", F.when(most > 1.0 / shards, F.ceil(most * 4 * shards)).otherwise(1).cast("int"))
    heavy_rows = heavy.orderBy("group").collect()  # at most 3 x n_cells
    cell = F.pmod(F.col("group"), F.lit(n_cells)).cast("int")
    cells = groups.filter(most <= 1.0 / n_cells).groupBy(cell.alias("cell")).agg(*[F.sum(m).alias(m) for m in MEASURES]).collect()  # at most n_cells

    spark = docs.sparkSession
    heads = F.broadcast(spark.createDataFrame([(r["group"], r["parts"]) for r in heavy_rows], "group long, parts int"))
    dealt = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    # what each part of a split group really holds; at most 4 x shards + 1 parts for each of at most 3 x shards groups
    split = narrow.join(heads.filter("parts > 1"), "group").groupBy("group", dealt.alias("part")).agg(*sums).collect()
    names = [(r["group"], r["part"]) for r in split] + [(r["group"], 0) for r in heavy_rows if r["parts"] == 1] + [(None, r["cell"]) for r in cells]
    vectors = [[r[m] for m in MEASURES] for r in [*split, *(r for r in heavy_rows if r["parts"] == 1), *cells]]
    units = np.array(vectors, dtype=float).reshape(-1, 3) / total
    where = level(units, place(units, shards), shards)

    chosen = F.broadcast(spark.createDataFrame([(*n, int(w)) for n, w in zip(names, where, strict=True)], "of long, part int, shard int"))
    part = F.when(F.col("parts").isNull(), cell).otherwise(dealt)
    found = narrow.join(heads, "group", "left").withColumn("unit_part", part).withColumn("of_group", F.when(F.col("parts").isNotNull(), F.col("group")))
    found = found.join(chosen, F.col("of_group").eqNullSafe(F.col("of")) & (F.col("unit_part") == F.col("part")))
    bucket = F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int")
    found = found.select(*carried, "doc_id", "size", "text_crc32", "shard", "row", bucket.alias("bucket"))
    counts = found.groupBy("shard", "bucket").agg(F.count("*").alias("n"))  # shards x buckets rows
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("row")
    ranked = found.withColumn("rank", F.row_number().over(inside)).join(F.broadcast(starts), ["shard", "bucket"])
    return ranked.select(*carried, "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank") - 1).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, resolution: int = RESOLUTION) -> DataFrame:
    """Write ``docs`` under ``path`` by shard and return the assignment. Every row is written once, those without doc_id
    and those that repeat one too; columns named shard or slot are replaced."""
    rows = stored(docs.drop("shard", "slot").withColumn(ROW, F.monotonically_increasing_id()), "rows")
    found = stored(assign_shards(rows, shards, resolution, (ROW,)), "shards")
    joined = rows.join(found.select(ROW, "shard", "slot"), ROW).drop(ROW)
    joined.repartition("shard", F.floor(F.col("slot") / BUCKET_ROWS)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return found.drop(ROW)
