"""Atom tables: dictionaries by first appearance, alternate sites, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.elements import covalent_radius, element_code, element_rgb, vdw_radius
from ..functions.fields import float32, uint32
from ..sources.store import kept
from .scan import number

RESIDUE_KEY = ["chain_id", "res_seq", "icode", "res_name"]


def _dense(df: DataFrame, order: str, name: str) -> DataFrame:
    return number(kept(df, name), ["structure_id"], order, name)  # stored, as a scan reads its rows twice


def chain_dictionary(raw: DataFrame) -> DataFrame:
    """structure_id, chain_idx (by first appearance), chain_id."""
    first = raw.groupBy("structure_id", "chain_id").agg(F.min("line_no").alias("first_line"))
    return _dense(first, "first_line", "chain_idx").select("structure_id", "chain_idx", "chain_id")


def residue_dictionary(raw: DataFrame) -> DataFrame:
    """structure_id, residue_idx (by first appearance), its key and first_line."""
    first = raw.groupBy("structure_id", *RESIDUE_KEY).agg(F.min("line_no").alias("first_line"))
    return _dense(first, "first_line", "residue_idx").select("structure_id", "residue_idx", *RESIDUE_KEY, "first_line")


def resolve_sites(raw: DataFrame, policy: str = "occupancy", columns: list[str] | None = None) -> DataFrame:
    """One record for each site (residue and raw name): the highest occupancy (null counts as 1), the first on ties.

    atom_idx numbers survivors in the order in which their sites first appear. ``policy="all"`` keeps every record. Only ``columns`` are carried along, if given."""
    columns = columns or raw.columns
    if policy == "all":
        return _dense(raw.select(columns), "line_no", "atom_idx")
    if policy != "occupancy":
        raise ValueError(f"unknown policy: {policy}")
    site = Window.partitionBy("structure_id", *RESIDUE_KEY, "name")
    best = site.orderBy(F.desc(F.coalesce("occupancy", F.lit(1.0))), "line_no")
    best_rows = raw.withColumn("site_line", F.min("line_no").over(site)).withColumn("place", F.row_number().over(best)).filter("place = 1")
    return _dense(best_rows.select(*columns, "site_line"), "site_line", "atom_idx").drop("site_line")


def site_warnings(raw: DataFrame) -> DataFrame:
    sites = raw.groupBy("structure_id", *RESIDUE_KEY, "name").agg(F.count("*").alias("n"))
    lost = sites.groupBy("structure_id").agg(F.sum(F.col("n") - 1).alias("n")).filter("n > 0")
    return lost.select("structure_id", F.format_string("AltLoc: kept highest-occupancy sites, dropped %d atoms", "n").alias("warning"))


def indexed(raw: DataFrame, chains: DataFrame, residues: DataFrame) -> DataFrame:
    """Records with chain_idx and residue_idx. Chains meet residues, not records, and what comes out lies by residue, where
    ``resolve_sites`` finds it."""
    of = residues.select("structure_id", "residue_idx", *RESIDUE_KEY).join(chains, ["structure_id", "chain_id"])
    return raw.join(of, ["structure_id", *RESIDUE_KEY])


#: What ``pack`` needs of a site.
PACKED = ["structure_id", "serial", "name", "element", "x", "y", "z", "chain_idx", "residue_idx", "line_no"]


def pack(sites: DataFrame) -> DataFrame:
    """The atoms table of ``indexed`` sites: positions and radii in single precision, indices, element attributes."""
    return sites.select(
        "structure_id", "atom_idx", uint32(F.col("serial")).alias("serial"), F.trim("name").alias("name"), "name_raw" if "name_raw" in sites.columns else F.col("name").alias("name_raw"), "element",
        element_code(F.col("element")).alias("element_code"), F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"), F.col("z").cast("float").alias("z"),
        vdw_radius(F.col("element")).cast("float").alias("radius"), covalent_radius(F.col("element")).cast("float").alias("covalent"), element_rgb(F.col("element")).alias("rgb"),
        "chain_idx", "residue_idx", "line_no",
    )


def bounding_boxes(rows: DataFrame, *keys: str) -> DataFrame:
    """Count and box by structure and further keys; give raw rows for the box of a whole file, atoms for that of a subset."""
    axes = [f(c).cast("double").alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))]
    return rows.groupBy("structure_id", *keys).agg(F.count("*").alias("n_atoms"), *axes)


def camera(boxes: DataFrame, aspect: float = 1.0, fov: float = 60.0, margin: float = 1.6) -> DataFrame:
    """Centre of each box and the camera distance that fits its width and height."""
    import math

    half = math.tan(math.radians(fov) / 2)
    size = lambda c: F.col(f"max_{c}") - F.col(f"min_{c}")
    fit = F.greatest(size("x") / 2 / (half * aspect), size("y") / 2 / half) * margin
    return boxes.select("structure_id", *[((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2).alias(f"centre_{c}") for c in "xyz"], fit.alias("distance"))


def single(c: str):
    return float32(F.col(c))
