"""Indices, selections and picking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.elements import element_symbol
from ..sources.store import kept
from .atoms import single
from .scan import running


def csr(rows: DataFrame, key: str, value: str) -> DataFrame:
    """structure_id, key, members (sorted, distinct), first: where the key's members start in the concatenation by key."""
    lists = rows.groupBy("structure_id", key).agg(F.array_sort(F.collect_set(value)).alias("members"))
    before = Window.partitionBy("structure_id").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return lists.withColumn("first", F.coalesce(F.sum(F.size("members")).over(before), F.lit(0)))


def residue_chains(atoms: DataFrame) -> DataFrame:
    """structure_id, residue_idx, chain_idx: the chain of the residue's first atom."""
    return atoms.groupBy("structure_id", "residue_idx").agg(F.min_by("chain_idx", "atom_idx").alias("chain_idx"))


def bonds_by(bonds: DataFrame, atoms: DataFrame | None, level: str) -> DataFrame:
    """structure_id, level key, bonds (sorted bond numbers); a bond inside one residue or chain is listed once. Without
    ``atoms``, bonds carry the level of theirs (level_a, level_b).

    A bond's number is how many come before its first atom's and its place among those, so atoms are numbered, not bonds: the
    bonds of an atom, in order, are one row on the way."""
    if level == "atom_idx":
        bonds = bonds.withColumns({"__a": F.col("a"), "__b": F.col("b")})
    elif atoms is None:
        bonds = bonds.withColumnsRenamed({f"{level}_{e}": f"__{e}" for e in "ab"})
    else:
        of = atoms.select("structure_id", "atom_idx", level)
        for e in "ab":
            bonds = bonds.join(of.withColumnsRenamed({"atom_idx": e, level: f"__{e}"}), ["structure_id", e])
    each = kept(bonds.groupBy("structure_id", "a").agg(F.first("__a").alias("key"), F.array_sort(F.collect_list(F.struct("b", F.col("__b").alias("key")))).alias("to")), "adjacent")
    each = running(each, ["structure_id"], "a", {"first": ("sum", F.size("to"))}, inclusive=False)
    # an atom's own bonds are a run of numbers; runs are moved by their ends, in one number
    run = lambda at, first, n: F.struct(at.alias("at"), (F.shiftleft(first.cast("long"), 32) + n.cast("long")).alias("run"))
    far = F.filter(F.transform("to", lambda t, n: run(t["key"], F.col("first") + n, F.lit(1))), lambda t: t["at"] != F.col("key"))
    ends = each.select("structure_id", F.inline(F.concat(F.array(run(F.col("key"), F.col("first"), F.size("to"))), far)))
    lists = ends.groupBy("structure_id", F.col("at").alias(level)).agg(F.collect_list("run").alias("runs"))
    first, n = (lambda r: F.shiftright(r, 32).cast("int")), (lambda r: r.bitwiseAND(0xFFFFFFFF).cast("int"))
    numbers = F.flatten(F.transform("runs", lambda r: F.sequence(first(r), first(r) + n(r) - 1)))
    return lists.select("structure_id", level, F.array_sort(numbers).alias("bonds"))


def atom_selections(atoms: DataFrame, chains: DataFrame | None, residues: DataFrame) -> DataFrame:
    """structure_id, atom_idx and what names the atom; missing parts are null. Without ``chains``, an atom's chain has the id
    that its residue has, so atoms are moved once."""
    linked = atoms if chains is None else atoms.join(chains, ["structure_id", "chain_idx"], "left")
    of = residues.select("structure_id", "residue_idx", "res_name", "res_seq", "icode", *(["chain_id"] if chains is None else []))
    linked = linked.join(of, ["structure_id", "residue_idx"], "left")
    return linked.select("structure_id", "atom_idx", "serial", "name", element_symbol(F.col("element_code")).alias("symbol"), "chain_idx", "chain_id", "residue_idx", "res_name", "res_seq", "icode", "x", "y", "z")


def atom_labels(selections: DataFrame) -> DataFrame:
    """structure_id, atom_idx, label: the non-empty parts joined by a middle dot."""
    residue = F.trim(F.concat(F.coalesce("res_name", F.lit("")), F.lit(" "), F.coalesce(F.col("res_seq").cast("string"), F.lit("")), F.coalesce("icode", F.lit(""))))
    parts = [F.col("chain_id"), residue, F.col("name"), F.col("symbol"), F.concat(F.lit("#"), F.col("serial").cast("string"))]
    return selections.select("structure_id", "atom_idx", F.concat_ws(" · ", *[F.nullif(p, F.lit("")) for p in parts]).alias("label"))


def bond_selections(bonds: DataFrame, selections: DataFrame) -> DataFrame:
    """Bonds with both ends' selections as structs; a bond whose end is missing is left out."""
    end = selections.select("structure_id", "atom_idx", F.struct(*[c for c in selections.columns if c != "structure_id"]).alias("s"))
    a, b = (end.withColumnsRenamed({"atom_idx": e, "s": f"atom_{e}"}) for e in "ab")
    return bonds.join(a, ["structure_id", "a"]).join(b, ["structure_id", "b"])


def chain_keys(chains: DataFrame) -> DataFrame:
    """structure_id, key, chain_idx: the dictionary of chain ids; of equal ids the last index counts."""
    return chains.groupBy("structure_id", F.col("chain_id").alias("key")).agg(F.max("chain_idx").alias("chain_idx"))


def residue_keys(atoms: DataFrame, chains: DataFrame, residues: DataFrame) -> DataFrame:
    """structure_id, key, residue_idx: the dictionary of residues by chain of their first atom, number, insertion code and
    name; of equal keys the last index counts. Residues without atoms have a blank chain."""
    of = residues.select("structure_id", "residue_idx", "res_seq", "icode", "res_name").join(residue_chains(atoms), ["structure_id", "residue_idx"], "left").join(chains, ["structure_id", "chain_idx"], "left")
    key = F.concat_ws("|", F.coalesce("chain_id", F.lit(" ")), F.col("res_seq").cast("string"), F.coalesce("icode", F.lit("")), "res_name")
    return of.groupBy("structure_id", key.alias("key")).agg(F.max("residue_idx").alias("residue_idx"))


def table_sizes(atoms: DataFrame) -> DataFrame:
    """structure_id, atoms, residues, chains: lengths of arrays that any index of the atoms fits in."""
    return atoms.groupBy("structure_id").agg(*[(F.max(c) + 1).alias(n) for c, n in (("atom_idx", "atoms"), ("residue_idx", "residues"), ("chain_idx", "chains"))])


def visible_chains(flags: DataFrame) -> DataFrame:
    """structure_id, chains: rising indices of the chains of ``flags`` (structure_id, chain_idx, visible) that are not switched off."""
    shown = F.when(F.coalesce(F.col("visible"), F.lit(True)), F.col("chain_idx"))
    return flags.groupBy("structure_id").agg(F.array_sort(F.collect_list(shown)).alias("chains"))


def hovered(atoms: DataFrame, picks: DataFrame, mode: str) -> DataFrame:
    """picks (structure_id, atom_idx) to the hovered id of ``mode``: atom, residue or chain; null for unknown atoms."""
    column = {"atom": "atom_idx", "residue": "residue_idx", "chain": "chain_idx"}[mode]
    known = atoms.select("structure_id", F.col("atom_idx"), F.struct(F.col(column).alias("id")).alias("found"))
    return picks.join(known, ["structure_id", "atom_idx"], "left").select("structure_id", "atom_idx", F.col("found.id").alias("id"))


def overlay(atoms: DataFrame, bonds: DataFrame, hover: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """Atoms and bonds to highlight for hover (structure_id, id). Bonds that carry the column of ``mode`` (as c_a, c_b) meet the
    hovered ids at once; others first meet atoms."""
    column = {"atom": "atom_idx", "residue": "residue_idx", "chain": "chain_idx"}[mode]
    ids = hover.select("structure_id", F.col("id").alias(column)).distinct()
    lit = atoms.join(ids, ["structure_id", column], "left_semi")
    carried = [f"{column}_{e}" for e in "ab"]
    if set(carried) <= set(bonds.columns):
        own = [c for c in bonds.columns if c not in carried]
        met = bonds.withColumn("end", F.explode(F.array_distinct(F.array(*carried)))).join(ids.withColumnRenamed(column, "end"), ["structure_id", "end"], "left_semi")
        return lit, met.select(own).distinct()
    near = lit.select("structure_id", F.col("atom_idx").alias("end"))
    touched = bonds.withColumn("end", F.explode(F.array("a", "b"))).join(near, ["structure_id", "end"], "left_semi").drop("end").distinct()
    return lit, touched


def pick_cell(atoms: DataFrame, radius_scale: float = 1.0) -> DataFrame:
    """structure_id, cell: edge of the picking grid, twice the mean drawn radius."""
    return atoms.groupBy("structure_id").agg(F.greatest(F.lit(1e-4), F.avg(single("radius")) * (radius_scale * 2)).alias("cell"))


def _crossings(some: Column, first: Column, step: Column, axis: int) -> Column:
    return F.transform(some, lambda k: F.struct((first + k * step).alias("t"), F.lit(axis).alias("axis")))


def grid_ray_hits(atoms: DataFrame, boxes: DataFrame, rays: DataFrame, radius_scale: float = 1.0) -> DataFrame:
    """The sphere that picking through a grid finds: structure_id, ray, atom_idx, t.

    Atoms lie in cells of ``pick_cell`` from the corner of their structure's box (min_x, max_x, ...). A ray visits the
    cells on its way through the box, one after another, and ends with the nearest hit so far once that lies before the
    cell's far side; a sphere that reaches out of its cell may so lose to a farther one. Cells and atoms meet by an
    equi-join, so a ray only meets the atoms along it."""
    r = rays.join(boxes, "structure_id").join(pick_cell(atoms, radius_scale), "structure_id")
    enter, leave, outside = F.lit(0.0), F.lit(float("inf")), F.lit(False)
    for c in "xyz":
        o, d, lo, hi = (F.col(f"{k}{c}") for k in ("o", "d", "min_", "max_"))
        flat = F.abs(d) < 1e-8
        a, b = F.try_divide(lo - o, d), F.try_divide(hi - o, d)
        enter = F.greatest(enter, F.when(~flat, F.least(a, b)).otherwise(F.lit(float("-inf"))))
        leave = F.least(leave, F.when(~flat, F.greatest(a, b)).otherwise(F.lit(float("inf"))))
        outside = outside | (flat & ((o < lo) | (o > hi)))
    r = r.withColumns({"t0": enter, "t1": leave}).filter(~outside & (F.col("t0") <= F.col("t1")))
    crossings = []
    for n, c in enumerate("xyz"):
        d = F.col(f"d{c}")
        start = F.col(f"o{c}") + d * F.col("t0") - F.col(f"min_{c}")
        r = r.withColumn(f"i{c}", F.floor(start / F.col("cell")))
        side = (F.col(f"i{c}") + F.when(d > 0, 1).otherwise(0)) * F.col("cell")
        first, step = F.try_divide(side - start, d), F.try_divide(F.col("cell"), F.abs(d))
        last = F.floor(F.try_divide(F.col("t1") - F.col("t0") - first, step))
        some = F.when((d != 0) & (last >= 0), F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))
        crossings.append(_crossings(some, F.col("t0") + first, step, n))
    begin = F.array(F.struct(F.col("t0").alias("t"), F.lit(-1).alias("axis")))
    cells = r.select("*", F.posexplode(F.concat(begin, F.array_sort(F.concat(*crossings)))).alias("place", "at"))
    way = Window.partitionBy("structure_id", "ray").orderBy("place")
    for n, c in enumerate("xyz"):
        moved = F.sum((F.col("at.axis") == n).cast("long")).over(way)
        cells = cells.withColumn(f"c{c}", F.col(f"i{c}") + moved * F.signum(f"d{c}").cast("long"))
    cells = cells.withColumn("exit", F.lead("at.t", 1, float("inf")).over(way))
    box = boxes.select("structure_id", *[F.col(f"min_{c}").alias(f"low_{c}") for c in "xyz"]).join(pick_cell(atoms, radius_scale), "structure_id")
    placed = atoms.select("structure_id", "atom_idx", *[single(c).alias(c) for c in "xyz"], (single("radius") * radius_scale).alias("r")).join(box, "structure_id")
    placed = placed.select("structure_id", "atom_idx", "x", "y", "z", "r", *[F.floor((F.col(c) - F.col(f"low_{c}")) / F.col("cell")).alias(f"c{c}") for c in "xyz"])
    met = cells.join(placed, ["structure_id", "cx", "cy", "cz"], "left")
    o = {c: F.col(f"o{c}") - F.col(c) for c in "xyz"}
    b = o["x"] * F.col("dx") + o["y"] * F.col("dy") + o["z"] * F.col("dz")
    disc = b * b - (o["x"] * o["x"] + o["y"] * o["y"] + o["z"] * o["z"] - F.col("r") * F.col("r"))
    t = F.when(disc >= 0, -b - F.sqrt(F.greatest(disc, F.lit(0.0))))
    hit = F.when(t.between(F.col("t0"), F.col("t1")), F.struct(t.alias("t"), "atom_idx"))
    each = met.groupBy("structure_id", "ray", "place", "exit").agg(F.min(hit).alias("h"))
    each = each.withColumn("h", F.min("h").over(way)).filter(F.col("h.t") < F.col("exit"))
    return each.groupBy("structure_id", "ray").agg(F.min_by("h", "place").alias("h")).select("structure_id", "ray", F.col("h.atom_idx").alias("atom_idx"), F.col("h.t").alias("t"))


def ray_hits(atoms: DataFrame, rays: DataFrame, radius_scale: float = 1.0) -> DataFrame:
    """Nearest sphere that each ray (structure_id, ray, ox, oy, oz, dx, dy, dz with unit direction) enters at t >= 0.

    Rays meet the atoms of their structure by an equi-join; a partial arg-min keeps one row a ray and task."""
    met = atoms.select("structure_id", "atom_idx", *[single(c).alias(c) for c in "xyz"], (single("radius") * radius_scale).alias("r")).join(rays, "structure_id")
    o = {c: F.col(f"o{c}") - F.col(c) for c in "xyz"}
    b = o["x"] * F.col("dx") + o["y"] * F.col("dy") + o["z"] * F.col("dz")
    c = o["x"] * o["x"] + o["y"] * o["y"] + o["z"] * o["z"] - F.col("r") * F.col("r")
    hit = met.withColumn("b", b).withColumn("disc", b * b - c).filter("disc >= 0").withColumn("t", -F.col("b") - F.sqrt("disc")).filter("t >= 0")
    return hit.groupBy("structure_id", "ray").agg(F.min(F.struct("t", "atom_idx")).alias("h")).select("structure_id", "ray", F.col("h.atom_idx").alias("atom_idx"), F.col("h.t").alias("t"))
