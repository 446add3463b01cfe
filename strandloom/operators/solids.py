"""Solids as runs: in each column (i, j) of a grid the voxels inside are a few runs from lo to hi along k.

Union, boundary and surface cells come from the ends of runs, summed up by place and swept along the column, so no row stands
for a voxel before the result asks for one. A column holds at most as many ends as the grid is high."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_COLUMN = ["structure_id", "i", "j"]


def chords(placed: DataFrame) -> DataFrame:
    """structure_id, i, j, lo, hi, atom_idx, ck, side: what each ball covers of each column of its grid.

    ``placed`` holds balls: structure_id, atom_idx, centre (ci, cj, ck), radius (ball) and grid (nx, ny, nz). The squared
    distance of a voxel k of a chord is side + (k - ck)^2."""
    w = F.floor("ball").cast("int")
    rows = placed.withColumn("di", F.explode(F.sequence(-w, w))).withColumn("dj", F.explode(F.sequence(-w, w)))
    rows = rows.withColumn("side", F.col("di") * F.col("di") + F.col("dj") * F.col("dj")).withColumn("rest", F.col("ball") * F.col("ball") - F.col("side")).filter("rest >= 0")
    half = F.floor(F.sqrt("rest")).cast("int")
    place = {"i": F.col("ci") + F.col("di"), "j": F.col("cj") + F.col("dj"), "lo": F.greatest(F.col("ck") - half, F.lit(0)), "hi": F.least(F.col("ck") + half, F.col("nz") - 1)}
    return rows.withColumns(place).filter("i >= 0 and j >= 0 and i < nx and j < ny and lo <= hi").select(*_COLUMN, "lo", "hi", "atom_idx", "ck", "side")


def union(chords: DataFrame) -> DataFrame:
    """structure_id, i, j, lo, hi: the runs that ``chords`` cover, apart from each other; touching ones are one run."""
    longest = chords.groupBy(*_COLUMN, "lo").agg(F.max("hi").alias("hi"))  # the rest of those that start here lies inside
    along = Window.partitionBy(*_COLUMN).orderBy("lo")
    before = F.max("hi").over(along.rowsBetween(Window.unboundedPreceding, -1))
    runs = longest.withColumn("before", before).withColumn("opens", (F.col("before").isNull() | (F.col("lo") > F.col("before") + 1)).cast("int"))
    runs = runs.withColumn("run", F.sum("opens").over(along))
    return runs.groupBy(*_COLUMN, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


def as_runs(solid: DataFrame) -> DataFrame:
    """Runs as they are; voxels (structure_id, i, j, k) as runs."""
    return solid if "lo" in solid.columns else union(solid.select(*_COLUMN, F.col("k").alias("lo"), F.col("k").alias("hi")))


def voxels(runs: DataFrame) -> DataFrame:
    """structure_id, i, j, k of the voxels of ``runs``."""
    return runs.select(*_COLUMN, F.explode(F.sequence(F.col("lo").cast("int"), F.col("hi").cast("int"))).alias("k"))


def _swept(ends: DataFrame, *values: str) -> DataFrame:
    """structure_id, i, j, lo, hi and the ``values`` that hold from lo to hi, of what is added at k to each value (``ends``)."""
    steps = ends.groupBy(*_COLUMN, "k").agg(*[F.sum(v).alias(v) for v in values])
    along = Window.partitionBy(*_COLUMN).orderBy("k")
    return steps.select(*_COLUMN, F.col("k").alias("lo"), (F.lead("k").over(along) - 1).alias("hi"), *[F.sum(v).over(along).alias(v) for v in values]).filter("hi is not null")


def _ends(lo: Column, hi: Column, value: Column | int) -> Column:
    """``value`` is added at lo and taken away after hi."""
    v = F.lit(value) if isinstance(value, int) else value
    return F.array(F.struct(lo.alias("k"), v.alias("v")), F.struct((hi + 1).alias("k"), (-v).alias("v")))


def boundary(runs: DataFrame, grid: DataFrame) -> DataFrame:
    """Runs of the voxels of ``runs`` with one of 26 neighbours in the grid outside.

    A voxel is no boundary if the runs of all nine columns around it, shortened by one at ends within the grid, cover it."""
    sized = runs.join(grid.select("structure_id", "nx", "ny", "nz"), "structure_id")
    lo = F.when(F.col("lo") == 0, 0).otherwise(F.col("lo") + 1)
    hi = F.when(F.col("hi") == F.col("nz") - 1, F.col("hi")).otherwise(F.col("hi") - 1)
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in product((-1, 0, 1), repeat=2)])
    none, at = F.lit(0), lambda v: F.col(f"e.{v}")
    inner = sized.select(*_COLUMN, lo.alias("lo"), hi.alias("hi"), F.explode(around).alias("o")).filter("lo <= hi")
    inner = inner.select("structure_id", (F.col("i") + F.col("o.a")).alias("i"), (F.col("j") + F.col("o.b")).alias("j"), F.explode(_ends(F.col("lo"), F.col("hi"), 1)).alias("e"))
    inner = inner.select(*_COLUMN, at("k").alias("k"), at("v").alias("covered"), none.alias("own"))
    own = runs.select(*_COLUMN, F.explode(_ends(F.col("lo"), F.col("hi"), 1)).alias("e")).select(*_COLUMN, at("k").alias("k"), none.alias("covered"), at("v").alias("own"))
    swept = _swept(inner.unionByName(own), "covered", "own").filter("own = 1").join(grid.select("structure_id", "nx", "ny"), "structure_id")
    beside = lambda v, n: 3 - (F.col(v) == 0).cast("int") - (F.col(v) == F.col(n) - 1).cast("int")
    return swept.filter(F.col("covered") < beside("i", "nx") * beside("j", "ny")).select(*_COLUMN, "lo", "hi")


def mixed_cells(runs: DataFrame, grid: DataFrame) -> DataFrame:
    """structure_id, i, j, k, mask of the grid cells with corners inside and outside; bit a + 2 b + 4 c of the mask stands for
    the corner (i + a, j + b, k + c)."""
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"), F.lit(1 << (a + 2 * b + 4 * c)).alias("bit")) for a, b, c in product((0, 1), repeat=3)])
    each = runs.select(*_COLUMN, "lo", "hi", F.explode(corners).alias("o"))
    ends = each.select("structure_id", (F.col("i") - F.col("o.a")).alias("i"), (F.col("j") - F.col("o.b")).alias("j"), F.explode(_ends(F.col("lo") - F.col("o.c"), F.col("hi") - F.col("o.c"), F.col("o.bit"))).alias("e"))
    swept = _swept(ends.select(*_COLUMN, F.col("e.k").alias("k"), F.col("e.v").alias("mask")), "mask").filter("mask not in (0, 255)").join(grid.select("structure_id", "nx", "ny", "nz"), "structure_id")
    swept = swept.filter("i >= 0 and j >= 0 and i < nx - 1 and j < ny - 1").withColumn("lo", F.greatest("lo", F.lit(0))).withColumn("hi", F.least("hi", F.col("nz") - 2)).filter("lo <= hi")
    return swept.select(*_COLUMN, F.explode(F.sequence(F.col("lo").cast("int"), F.col("hi").cast("int"))).alias("k"), "mask")


def owners(nodes: DataFrame, chords: DataFrame) -> DataFrame:
    """structure_id, i, j, k, atom_idx, d2 of the distinct ``nodes`` (structure_id, i, j, k) inside any ball: the nearest centre,
    the first atom on ties. Nodes and chords meet by column."""
    met = nodes.select(*_COLUMN, "k").distinct().join(chords, _COLUMN).filter("k between lo and hi")
    d2 = F.col("side") + (F.col("k") - F.col("ck")) * (F.col("k") - F.col("ck"))
    return met.groupBy(*_COLUMN, "k").agg(F.min(F.struct(d2.alias("d2"), "atom_idx")).alias("o")).select(*_COLUMN, "k", F.col("o.atom_idx").alias("atom_idx"), F.col("o.d2").alias("d2"))
