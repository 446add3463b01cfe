"""Joins between positions and intervals of whole numbers, with work in proportion to rows and matches.

No interval is written out position by position, and no position meets intervals that miss it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import kept
from .scan import running

#: A node of a level holds 2 ^ ``BITS`` nodes of the level below; ``LEVELS`` levels from single positions up. A node of the highest
#: one, 4,096 positions, is the most that one join key covers.
BITS, LEVELS = 4, 4


def _nodes(start: Column, end: Column, levels: int = LEVELS) -> Column:
    """Nodes that together cover start to end, both included, each position once: an array of (level, node)."""
    none = F.array().cast("array<bigint>")
    run = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(none)
    first = lambda level: F.shiftright(start + ((1 << BITS * level) - 1), BITS * level)
    last = lambda level: F.shiftright(end + 1, BITS * level) - 1
    of_level = lambda nodes, level: F.transform(nodes, lambda n: F.struct(F.lit(level).alias("level"), n.alias("node")))
    parts = []
    for level in range(levels):
        a, b = first(level), last(level)
        if level == levels - 1:
            nodes = run(a, b)
        else:  # without the nodes below a whole node of the next level
            up, to = first(level + 1), last(level + 1)
            nodes = F.when(up > to, run(a, b)).otherwise(F.concat(run(a, up * (1 << BITS) - 1), run((to + 1) * (1 << BITS), b)))
        parts.append(of_level(nodes, level))
    return F.concat(*parts)


def levels_for(spans: DataFrame, start: str, end: str) -> int:
    """Levels with which no span needs more than 2 ^ ``BITS`` nodes of the highest, ``LEVELS`` at most. ``spans`` are read."""
    longest = spans.agg(F.max(F.col(end).cast("long") - F.col(start).cast("long") + 1)).first()[0] or 1
    return next((n for n in range(1, LEVELS) if longest <= 1 << BITS * n), LEVELS)


def within(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, levels: int = LEVELS) -> DataFrame:
    """Each row of ``points`` with each row of ``spans`` of its ``keys`` from whose ``start`` to whose ``end`` it lies; columns
    of points, then those of spans but for the keys.

    A span is cut into nodes of a tree over all positions, at most 30 a level below the highest, and a point is looked for in
    its own node of each level: an equi-join whose result is the matches, each once. Spans that end before they start and nulls
    in keys or positions match nothing; repeated rows match as often as they stand. Where
    spans are short (``levels_for``), fewer levels move fewer rows; the matches are the same with any number of them."""
    p, long = points, lambda c: F.col(c).cast("long")
    own = F.array(*[F.struct(F.lit(level).alias("level"), F.shiftright(long(at), BITS * level).alias("node")) for level in range(levels)])
    p = p.withColumn("__n", F.explode(own)).withColumns({"__level": F.col("__n.level"), "__node": F.col("__n.node")}).drop("__n")
    s = spans.filter(F.col(start) <= F.col(end)).withColumn("__n", F.explode(_nodes(long(start), long(end), levels)))
    s = s.withColumns({"__level": F.col("__n.level"), "__node": F.col("__n.node")}).drop("__n")
    return p.join(s, [*keys, "__level", "__node"]).select(*points.columns, *[c for c in spans.columns if c not in keys])


def reach(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, value: str) -> DataFrame:
    """``spans`` with first, the smallest ``value`` of the points of its ``keys`` at or after ``start``, and last, the largest
    one of those at or before ``end``; null where there is none, or where a key is null. Spans with a null position are left out.

    Points and ends of spans stand in one order, and what is open is carried from block to block (``running``), so a span
    costs two rows however many points it passes."""
    spans = kept(spans.dropna(subset=[start, end]).withColumn("__id", F.monotonically_increasing_id()), "spans")
    # a position counts once, however many points stand there
    points = points.dropna(subset=[*keys, at]).groupBy(*keys, F.col(at).cast("long").alias("__at")).agg(F.min(value).alias("__least"), F.max(value).alias("__most"))
    found = spans
    for name, sign, kind, place, v in (("first", -1, "min", start, "__least"), ("last", 1, "max", end, "__most")):
        of_points = points.select(*keys, (F.col("__at") * 2 * sign).alias("__order"), F.col(v).alias("__v"), F.lit(None).cast("long").alias("__id"))
        of_spans = spans.select(*keys, (F.col(place).cast("long") * 2 * sign + 1).alias("__order"), F.lit(None).cast(points.schema[v].dataType).alias("__v"), "__id")
        events = kept(of_points.unionByName(of_spans), "events")
        passed = running(events, keys, "__order", {name: (kind, F.col("__v"))}).filter("__id is not null").select("__id", name)
        found = found.join(passed, "__id")
    return found.drop("__id")
