"""A structure's tables as one lazy plan each, and structure text derived from the lineitem table.

The driver's tables hold no molecules, so each supplier's line items become one structure, written as fixed-width
lines and parsed again."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import atoms as A
from ..operators import backbone as B
from ..operators import bonds as C
from ..operators import lookup, parsing, subset
from ..operators.scan import number
from ..sources.store import drop, drop_steps, kept
from ..sources.structures import atom_line

# Fixed values of the derived structures: name and element by line number 1 to 7, and secondary records.
NAMES = [" CA ", " N  ", " O  ", " SG ", " H  ", "CA  ", " K  "]
ELEMENTS = ["C", "N", "O", "S", "H", "CA", "K"]
SECONDARY = [("HELIX", "A", 5, 12), ("HELIX", "N", 3, 9), ("SHEET", "R", 20, 30), ("SHEET", "A", 10, 20)]
TER_EVERY, CONECT_EVERY = 50, 10


def derived_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """structure_id, i (order in the file), n and the fields of one atom for each line item."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("l_linenumber"))
    return li.select(
        F.col("l_suppkey").alias("structure_id"), (F.row_number().over(order) - 1).alias("i"), F.count("*").over(Window.partitionBy("l_suppkey")).alias("n"),
        F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100).alias("y"), F.round(F.col("l_tax") * 100).alias("z"), F.col("l_returnflag").alias("chain_id"),
        (F.col("l_orderkey") % 50).cast("int").alias("res_seq"), F.when(F.col("l_linestatus") == "O", "GLY").otherwise("ALA").alias("res_name"),
        pick(NAMES).alias("name"), pick(ELEMENTS).alias("element"), (1 - F.col("l_discount")).alias("occupancy"),
    )


def derived_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """structure_id, line_no, line: two models, TER records, CONECT, HELIX and SHEET records. All lines of an atom are
    made from its own row, so the text needs one shuffle by structure."""
    base = derived_atoms(spark, sf_dir)
    i, n = F.col("i"), F.col("n")
    at = lambda no, line: F.struct(no.cast("long").alias("line_no"), line.alias("line"))
    atom = atom_line(F.lit("ATOM"), i + 1, F.col("name"), F.lit(" "), F.col("res_name"), F.col("chain_id"), F.col("res_seq"), F.col("x"), F.col("y"), F.col("z"), F.col("occupancy"), F.col("element"))
    five = lambda c: F.lpad(c.cast("string"), 5, " ")
    link = lambda a, b: F.concat(F.lit("CONECT"), five(a), five(b))
    ter = F.rpad(F.concat(F.lit("TER   "), F.lit(" " * 15), F.col("chain_id")), 27, " ")
    tail = [(F.lit("MODEL        2"), 3), (F.lit("ATOM      1  N   GLY A   1       9.000   9.000   9.000  1.00  0.00           N"), 4), (F.lit("ENDMDL"), 5)]
    for k, (kind, chain, start, end) in enumerate(SECONDARY):
        text = f"HELIX{k + 1:>5}{k + 1:>4} GLY {chain} {start:>4}  ALA {chain} {end:>4}" if kind == "HELIX" else f"SHEET{k + 1:>5}{k + 1:>4} 1 GLY {chain}{start:>4}  ALA {chain}{end:>4}"
        tail.append((F.lit(text), 10 + k))
    with_link = (i % CONECT_EVERY == 0) & (i + 1 < n)
    parts = F.concat(
        F.array(at(2 * i + 2, atom)),
        F.when(i == 0, F.array(at(F.lit(1), F.lit("MODEL        1")))).otherwise(F.array()),
        F.when(i % TER_EVERY == TER_EVERY - 1, F.array(at(2 * i + 3, ter))).otherwise(F.array()),
        F.when(i == n - 1, F.array(at(2 * n + 2, F.lit("ENDMDL")), *[at(2 * n + k, t) for t, k in tail])).otherwise(F.array()),
        F.when(with_link, F.array(at(2 * n + 20 + 2 * i, link(i + 1, i + 2)))).otherwise(F.array()),
        F.when(with_link & (i % (2 * CONECT_EVERY) == 0), F.array(at(2 * n + 21 + 2 * i, link(i + 2, i + 1)))).otherwise(F.array()),
    )
    return base.select("structure_id", F.inline(parts))


class Scene:
    """Tables of parsed structures; give lines (structure_id, line_no, line). Those from which other tables are made are kept as
    Parquet when they are first asked for, the others are lazy. ``release`` deletes what is kept."""

    def __init__(self, lines: DataFrame, alt_loc: str = "occupancy", model: int | None = None, policy: str = "conect+heuristic", backbone_rep: str = "observed", segments: str = "closed"):
        self.lines, self.alt_loc, self.model, self.policy, self.rep, self.segment_rule = lines, alt_loc, model, policy, backbone_rep, segments
        self._kept: list[DataFrame] = []

    def _keep(self, df: DataFrame, label: str) -> DataFrame:
        self._kept.append(kept(df, label))
        drop_steps(df, [*self._kept, self.lines])
        return self._kept[-1]

    def release(self) -> None:
        """Delete the kept tables; no table of this scene can be read any more."""
        drop(*self._kept)
        self._kept.clear()

    @cached_property
    def records(self) -> DataFrame:
        return self._keep(parsing.with_model(kept(self.lines, "lines"), self.model), "records")

    @cached_property
    def raw(self) -> DataFrame:
        return self._keep(parsing.atoms_raw(self.records), "raw")

    @cached_property
    def chains(self) -> DataFrame:
        return self._keep(A.chain_dictionary(self.raw), "chains")

    @cached_property
    def residues(self) -> DataFrame:
        return self._keep(A.residue_dictionary(self.raw), "residues")

    @cached_property
    def sites(self) -> DataFrame:
        return A.resolve_sites(self.raw, self.alt_loc)

    @cached_property
    def atoms(self) -> DataFrame:
        sites = A.resolve_sites(A.indexed(self.raw, self.chains, self.residues), self.alt_loc, A.PACKED)
        return self._keep(A.pack(sites), "atoms")

    @cached_property
    def conect(self) -> DataFrame:
        return self._keep(C.conect_bonds(parsing.conect_mentions(self.records), self.raw, self.atoms), "conect")

    @cached_property
    def bonds(self) -> DataFrame:
        return self._keep(C.bonds(self.conect, self.atoms, self.policy), "bonds")

    def ends(self, *columns: str) -> DataFrame:
        """The bonds with columns of both their atoms or these atoms' residues, as c_a and c_b."""
        atoms = self.atoms
        if of_residue := [c for c in columns if c not in atoms.columns]:  # atoms meet residues once, before bonds are made
            own = atoms.select(*dict.fromkeys([*C.PLACED, "residue_idx", *[c for c in columns if c in atoms.columns]]))
            named = own.join(self.residues.select("structure_id", "residue_idx", *of_residue), ["structure_id", "residue_idx"], "left")
            atoms = kept(named, "named")
            self._kept.append(atoms)
        return C.bonds(self.conect, atoms, self.policy, columns)

    def bonds_among(self, keep: DataFrame) -> DataFrame:
        """The bonds among the atoms of the chains in ``keep`` (structure_id, chain_idx), by these atoms' new numbers."""
        some = subset.kept_atoms(self.atoms, keep).select(*C.PLACED)
        some = kept(some, "some")
        numbered = kept(number(some, ["structure_id"], "atom_idx", "new"), "subset")
        drop(some)
        self._kept.append(numbered)
        made = C.bonds(self.conect, numbered, self.policy, ["new"])
        return made.select("structure_id", F.col("new_a").alias("a"), F.col("new_b").alias("b"), "bond_order")

    @cached_property
    def segments(self) -> DataFrame:
        return self._keep(B.ter_segments(self.raw, self.residues, self.chains, parsing.terminators(self.records), self.segment_rule), "segments")

    @cached_property
    def points(self) -> DataFrame:
        spans = self.segments.unionByName(B.fallback_segments(self.atoms, self.segments))
        return self._keep(B.backbone_points(spans, B.representatives(self.atoms, self.rep), self.atoms), "points")

    @cached_property
    def spans(self) -> DataFrame:
        return self._keep(B.secondary_spans(parsing.secondary_records(self.records), self.residues, self.chains), "spans")

    @cached_property
    def selections(self) -> DataFrame:
        return lookup.atom_selections(self.atoms, None, self.residues)

    @cached_property
    def warnings(self) -> DataFrame:
        out = parsing.coordinate_warnings(self.records).unionByName(A.site_warnings(self.raw)) if self.alt_loc == "occupancy" else parsing.coordinate_warnings(self.records)
        return out if self.policy == "conect-only" else out.unionByName(C.bond_warnings(self.bonds))
