"""Chain subsets of structures, with and without new numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import reach


def kept_residues(residues: DataFrame, keep: DataFrame) -> DataFrame:
    """Residues of the chains in ``keep`` (structure_id, chain_id); each has an atom, whichever record of a site is chosen."""
    return residues.join(keep.select("structure_id", "chain_id").distinct(), ["structure_id", "chain_id"], "left_semi")


def _renumber(rows: DataFrame, old: str) -> DataFrame:
    w = Window.partitionBy("structure_id").orderBy(old)
    return rows.select("structure_id", old, (F.row_number().over(w) - 1).cast("int").alias(f"new_{old}"))


def kept_atoms(atoms: DataFrame, keep: DataFrame) -> DataFrame:
    """Atoms of the chains in ``keep`` (structure_id, chain_idx)."""
    return atoms.join(keep.select("structure_id", "chain_idx").distinct(), ["structure_id", "chain_idx"], "left_semi")


def renumbered(atoms: DataFrame, keep: DataFrame) -> DataFrame:
    """Atoms of the kept chains, with atoms, residues and chains numbered anew without gaps; the old numbers stay in old_*."""
    kept = kept_atoms(atoms, keep)
    for column in ("atom_idx", "residue_idx", "chain_idx"):
        numbers = _renumber(kept.select("structure_id", column).distinct(), column)
        kept = kept.join(numbers, ["structure_id", column]).withColumnsRenamed({column: f"old_{column}", f"new_{column}": column})
    return kept


def subset_chains(atoms: DataFrame, bonds: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Atoms and bonds of the kept chains, with atoms, residues and chains numbered anew without gaps; a bond stays if
    both ends do. The old numbers stay in old_* columns."""
    kept = renumbered(atoms, keep)
    return kept, remap_bonds(bonds, kept.select("structure_id", "old_atom_idx", "atom_idx"))


def remap_bonds(bonds: DataFrame, numbers: DataFrame) -> DataFrame:
    """Bonds by new atom numbers (structure_id, old_atom_idx, atom_idx), each with its own order."""
    for end in ("a", "b"):
        of = numbers.withColumnsRenamed({"old_atom_idx": end, "atom_idx": f"new_{end}"})
        bonds = bonds.join(of, ["structure_id", end]).drop(end).withColumnRenamed(f"new_{end}", end)
    return bonds.select("structure_id", "a", "b", "bond_order")


def filtered(atoms: DataFrame, keep: DataFrame) -> DataFrame:
    """As ``renumbered``, but chains and residues keep their numbers; only atoms are numbered anew."""
    kept = kept_atoms(atoms, keep)
    numbers = _renumber(kept.select("structure_id", "atom_idx"), "atom_idx")
    return kept.join(numbers, ["structure_id", "atom_idx"]).withColumnsRenamed({"atom_idx": "old_atom_idx", "new_atom_idx": "atom_idx"})


def filter_chains(atoms: DataFrame, bonds: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``subset_chains``, but chains and residues keep their numbers; only atoms are numbered anew."""
    kept = filtered(atoms, keep)
    return kept, remap_bonds(bonds, kept.select("structure_id", "old_atom_idx", "atom_idx"))


def backbone_runs(points: DataFrame, residues: DataFrame) -> DataFrame:
    """Points of kept residues (structure_id, residue_idx), numbered anew, cut into runs where points are missing.

    Runs of one point have no segment."""
    kept = points.filter("segment_start is not null").join(residues.select("structure_id", "residue_idx").distinct(), ["structure_id", "residue_idx"], "left_semi")
    order = Window.partitionBy("structure_id").orderBy("point")
    new = kept.withColumn("new_point", (F.row_number().over(order) - 1).cast("int"))
    in_segment = Window.partitionBy("structure_id", "segment").orderBy("point")
    new = new.withColumn("island", F.col("point") - F.row_number().over(in_segment))
    run = Window.partitionBy("structure_id", "segment", "island")
    size = F.count("*").over(run)
    return new.select("structure_id", "new_point", "point", "segment", "residue_idx", F.when(size >= 2, F.min("new_point").over(run)).alias("run_start"), F.when(size >= 2, F.max("new_point").over(run) + 1).alias("run_end"))


def filtered_backbone(points: DataFrame, residues: DataFrame) -> DataFrame:
    """As ``backbone_runs`` without cutting at gaps; segments left with one point are dropped whole."""
    kept = points.filter("segment_start is not null").join(residues.select("structure_id", "residue_idx").distinct(), ["structure_id", "residue_idx"], "left_semi")
    kept = kept.withColumn("n", F.count("*").over(Window.partitionBy("structure_id", "segment"))).filter("n >= 2").drop("n")
    return kept.withColumn("new_point", (F.row_number().over(Window.partitionBy("structure_id").orderBy("point")) - 1).cast("int"))


def subset_spans(spans: DataFrame, residues: DataFrame) -> DataFrame:
    """Secondary spans shrunk to the kept residues inside them; spans without any are left out."""
    met = reach(residues.select("structure_id", "residue_idx"), spans, ["structure_id"], "residue_idx", "start_residue", "end_residue", "residue_idx")
    return met.filter("first <= last").select("structure_id", "span", "kind", F.col("first").alias("start_residue"), F.col("last").alias("end_residue"))
