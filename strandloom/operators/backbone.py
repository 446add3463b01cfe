"""Chain segments, backbone points and secondary structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import drop, kept
from .intervals import reach, within
from .scan import BLOCK, number, running


def ter_segments(raw: DataFrame, residues: DataFrame, chains: DataFrame, ters: DataFrame, segments: str = "closed") -> DataFrame:
    """structure_id, chain_idx, start_residue, end_residue, ter_line of residue runs that TER records close.

    A segment starts at the smallest residue first seen since the chain's previous TER and ends at the residue of the
    chain's last atom before the TER; it needs a start not above its end. A TER without chain takes the chain of the
    last atom before it. ``segments="all"`` also closes each chain at its end."""
    atoms = raw.join(residues, ["structure_id", "chain_id", "res_seq", "icode", "res_name"]).join(chains, ["structure_id", "chain_id"])
    events = atoms.select("structure_id", "line_no", "chain_idx", "residue_idx", F.when(F.col("line_no") == F.col("first_line"), F.col("residue_idx")).alias("new_residue"), F.lit(0).alias("ter"))
    named = ters.join(chains, ["structure_id", "chain_id"], "left").select("structure_id", "line_no", "chain_idx", F.lit(None).cast("int").alias("residue_idx"), F.lit(None).cast("int").alias("new_residue"), F.when(F.col("chain_id").isNull(), 2).otherwise(1).alias("ter"))
    events = events.unionByName(named)
    if segments == "all":
        ends = atoms.groupBy("structure_id", "chain_idx").agg((F.max("line_no") + 1_000_000_000).alias("line_no"))
        events = events.unionByName(ends.select("structure_id", "line_no", "chain_idx", F.lit(None).cast("int").alias("residue_idx"), F.lit(None).cast("int").alias("new_residue"), F.lit(1).alias("ter")))
    chain = ["structure_id", "chain_idx"]
    if ters.filter("chain_id is null").isEmpty():
        events = kept(events.filter("chain_idx is not null"), "events")
    else:
        told = kept(events, "events")
        events = running(told, ["structure_id"], "line_no", {"last_chain": ("last", F.when(F.col("ter") == 0, F.col("chain_idx")))})
        events = kept(events.withColumn("chain_idx", F.when(F.col("ter") == 2, F.col("last_chain")).otherwise(F.col("chain_idx"))).filter("chain_idx is not null"), "events")
        drop(told)
    events = running(events, chain, "line_no", {"closings": ("sum", (F.col("ter") > 0).cast("int")), "last_residue": ("last", F.col("residue_idx"))})
    events = events.withColumn("run", F.col("closings") - (F.col("ter") > 0).cast("int"))
    closed = events.groupBy("structure_id", "chain_idx", "run").agg(F.min("new_residue").alias("start_residue"), F.max(F.when(F.col("ter") > 0, F.col("line_no"))).alias("ter_line"), F.max(F.when(F.col("ter") > 0, F.col("last_residue"))).alias("end_residue"))
    return closed.filter("ter_line is not null and start_residue <= end_residue").select("structure_id", "chain_idx", "start_residue", "end_residue", "ter_line")


def fallback_segments(atoms: DataFrame, closed: DataFrame) -> DataFrame:
    """For structures without any closed segment: each chain from its smallest to its largest residue."""
    spans = atoms.groupBy("structure_id", "chain_idx").agg(F.min("residue_idx").alias("start_residue"), F.max("residue_idx").alias("end_residue"))
    return spans.join(closed.select("structure_id").distinct(), "structure_id", "left_anti").withColumn("ter_line", F.col("chain_idx").cast("long"))


def representatives(atoms: DataFrame, rule: str = "observed") -> DataFrame:
    """structure_id, residue_idx, atom_idx of each residue's point.

    "observed": the first atom with a name, but if that is atom 0, the first later one named CA or P. "ca_p": the
    first atom named CA or P, else the first with a name."""
    named = atoms.filter(F.trim("name") != "")
    trace = F.upper(F.trim("name")).isin("CA", "P")
    by = named.groupBy("structure_id", "residue_idx").agg(F.min("atom_idx").alias("f"), F.min(F.when(trace & ((F.col("atom_idx") > 0) if rule == "observed" else F.lit(True)), F.col("atom_idx"))).alias("t"))
    pick = F.when(F.col("f") != 0, F.col("f")).otherwise(F.coalesce("t", "f")) if rule == "observed" else F.coalesce("t", "f")
    return by.select("structure_id", "residue_idx", pick.alias("atom_idx"))


def backbone_points(segments: DataFrame, reps: DataFrame, atoms: DataFrame) -> DataFrame:
    """structure_id, point, segment, residue_idx, atom_idx, x, y, z; points of segments below two points have a null
    segment_start. Segments follow each other in the order of their TER records."""
    order = Window.partitionBy("structure_id").orderBy("ter_line", "chain_idx")  # a row a segment
    numbered = segments.withColumn("segment", (F.row_number().over(order) - 1).cast("int"))
    met = within(reps, numbered, ["structure_id"], "residue_idx", "start_residue", "end_residue")
    points = met.select("structure_id", "segment", "residue_idx", "atom_idx").join(atoms.select("structure_id", "atom_idx", "x", "y", "z"), ["structure_id", "atom_idx"])
    points = number(kept(points, "points"), ["structure_id", "segment"], "residue_idx", "place")
    sizes = points.groupBy("structure_id", "segment").agg(F.count("*").cast("int").alias("size"))
    before = Window.partitionBy("structure_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    points = points.join(sizes.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("int")), ["structure_id", "segment"])
    long = F.col("size") >= 2
    return points.select(
        "structure_id", "atom_idx", "residue_idx", "segment", "x", "y", "z", (F.col("start") + F.col("place")).alias("point"),
        F.when(long, F.col("start")).alias("segment_start"), F.when(long, F.col("start") + F.col("size")).alias("segment_end"),
    )


def backbone_pairs(points: DataFrame, block: int | None = None) -> DataFrame:
    """Consecutive points of a segment: structure_id, segment, point, next_point and their positions."""
    known = points.filter("segment_start is not null").select("structure_id", "segment", "point", "x", "y", "z")
    # the first point of a block goes to the block before it too, so points are moved once and meet no table of themselves
    size = block or BLOCK
    own = F.floor(F.col("point") / size)
    placed = known.withColumn("block", F.explode(F.when(F.col("point") % size == 0, F.array(own, own - 1)).otherwise(F.array(own))))
    order = Window.partitionBy("structure_id", "segment", "block").orderBy("point")
    met = placed.select("structure_id", "segment", "point", "x", "y", "z", "block", *[F.lead(c).over(order).alias(f"next_{c}") for c in ("point", "x", "y", "z")])
    return met.filter((own == F.col("block")) & (F.col("next_point") == F.col("point") + 1)).drop("block")


def secondary_spans(secondary: DataFrame, residues: DataFrame, chains: DataFrame) -> DataFrame:
    """structure_id, span (helices first, then by line), kind, chain_idx, start_residue, end_residue.

    The start is the chain's first residue numbered at or above the record's start, the end its last one numbered at
    or below the record's end, wherever they stand; spans with end below start are left out."""
    of_chain = residues.join(chains, ["structure_id", "chain_id"]).select("structure_id", "chain_idx", "residue_idx", "res_seq")
    met = reach(of_chain, secondary.join(chains, ["structure_id", "chain_id"]), ["structure_id", "chain_idx"], "res_seq", "start_seq", "end_seq", "residue_idx")
    spans = met.withColumnsRenamed({"first": "start_residue", "last": "end_residue"})
    spans = spans.filter("start_residue <= end_residue")
    w = Window.partitionBy("structure_id").orderBy("kind", "line_no")
    return spans.select("structure_id", (F.row_number().over(w) - 1).cast("int").alias("span"), "kind", "chain_idx", "start_residue", "end_residue")


def residue_kinds(spans: DataFrame) -> DataFrame:
    """structure_id, residue_idx, kind (1 helix, 2 sheet; the later span paints over), sheet_end."""
    each = spans.select("structure_id", "span", "kind", "end_residue", F.explode(F.sequence("start_residue", "end_residue")).alias("residue_idx"))
    return each.groupBy("structure_id", "residue_idx").agg(
        F.max_by(F.when(F.col("kind") == "helix", 1).otherwise(2), "span").alias("kind"), F.max_by("end_residue", F.when(F.col("kind") == "sheet", F.col("span"))).alias("sheet_end")
    )


def ribbon_widths(kinds: DataFrame, width: float = 1.2) -> DataFrame:
    """Width of the flat ribbon at each painted residue: helices the base, sheets wider with a tip over the last two residues."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("sheet_end") - F.col("residue_idx")) / 2.0))
    tip = F.when(F.col("sheet_end") - F.col("residue_idx") <= 2, (1.3 - 0.3 * (1 - t)) * t).otherwise(1.0)
    return kinds.select("structure_id", "residue_idx", "kind", F.when(F.col("kind") == 1, F.lit(width)).otherwise(width * 1.4 * tip).alias("width"))
