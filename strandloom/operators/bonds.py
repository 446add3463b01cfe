"""Bonds from CONECT records and from distances by a grid join."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import drop, kept
from .atoms import single

# Grid cell, slack over the covalent radii, least distance (angstrom).
CELL, SLACK, NEAREST = 2.5, 0.45, 0.4
CELL_KEY = ["structure_id", "cx", "cy", "cz"]
#: What bonds need of atoms.
PLACED = ["structure_id", "atom_idx", "x", "y", "z", "covalent"]
#: A cell of more atoms is cut, at most so many times: 2.5 / 2 ^ 4 is 0.16, the diagonal 0.27.
CROWD, DEPTH = 512, 4
#: Cells along each axis of a block that one task pairs at once, and pairs that it tries at once.
SIDE, AT_ONCE = 16, 1 << 22
#: Rows of small blocks that a task pairs together.
AT_ONCE_ROWS = 1 << 15
_BLOCK = ["structure_id", "bx", "by", "bz"]
POLICIES = ("conect-only", "heuristic-if-missing", "conect+heuristic")


def conect_bonds(mentions: DataFrame, raw: DataFrame, atoms: DataFrame, order: str = "mentions") -> DataFrame:
    """structure_id, a, b, bond_order. Serials name accepted records; of equal serials the last atom counts.

    ``order``: "mentions" clamps the number of mentions, which a symmetric record doubles, to 1..3; "undirected"
    halves it first."""
    known = raw.select("structure_id", F.col("serial").cast("long").alias("serial")).distinct()
    last = atoms.groupBy("structure_id", "serial").agg(F.max("atom_idx").alias("atom_idx")).join(known, ["structure_id", "serial"], "left_semi")
    lo, hi = (last.select("structure_id", F.col("serial").alias(s), F.col("atom_idx").alias(f"{s}_idx")) for s in ("lo", "hi"))
    pairs = mentions.join(lo, ["structure_id", "lo"]).join(hi, ["structure_id", "hi"]).filter("lo_idx <> hi_idx")
    n = F.col("mentions") if order == "mentions" else F.ceil(F.col("mentions") / 2)
    pairs = pairs.groupBy("structure_id", F.least("lo_idx", "hi_idx").alias("a"), F.greatest("lo_idx", "hi_idx").alias("b")).agg(F.max(n).alias("n"))
    return pairs.select("structure_id", "a", "b", F.least(F.lit(3), F.greatest(F.lit(1), F.col("n"))).cast("int").alias("bond_order"))


def forward_offsets() -> list[tuple[int, int, int]]:
    """Each pair of neighbouring cells once: the cell itself and the 13 offsets above zero in order."""
    return [o for o in product((-1, 0, 1), repeat=3) if o >= (0, 0, 0)]


def grid_cells(atoms: DataFrame, cell: float = CELL) -> DataFrame:
    return atoms.select("structure_id", "atom_idx", *[single(c).alias(c) for c in "xyz"], single("covalent").alias("r"), *[F.floor(single(c) / cell).alias(f"c{c}") for c in "xyz"])


def _bonded(p: str, q: str) -> Column:
    """Whether atoms in structs ``p`` and ``q`` (x, y, z, r) stand at a bonding distance."""
    d2 = sum(((F.col(f"{p}.{c}") - F.col(f"{q}.{c}")) * (F.col(f"{p}.{c}") - F.col(f"{q}.{c}")) for c in "xyz"), F.lit(0.0))
    reach = F.col(f"{p}.r") + F.col(f"{q}.r") + SLACK
    return (d2 >= NEAREST * NEAREST) & (d2 <= reach * reach)


def _pair(p: str, q: str) -> list[Column]:
    i, j = F.col(f"{p}.atom_idx"), F.col(f"{q}.atom_idx")
    return [F.least(i, j).alias("a"), F.greatest(i, j).alias("b"), F.lit(1).alias("bond_order")]


def heuristic_bonds(atoms: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Atom pairs in the same or touching cells at a bonding distance, order 1. An equi-join on structure and cell over
    14 forward offsets, so each pair meets once and no distance predicate is left to a nested loop. Cells of more than ``crowd``
    atoms and what touches them are cut into smaller ones first (``crowded_bonds``)."""
    placed = grid_cells(atoms)
    crowded = kept(placed.groupBy(*CELL_KEY).agg(F.count("*").alias("n")).filter(F.col("n") > crowd), "crowded")
    if crowded.isEmpty():
        return _cell_bonds(placed)
    rest = _cell_bonds(placed.join(crowded.select(*CELL_KEY), CELL_KEY, "left_anti"))
    return rest.unionByName(crowded_bonds(placed, crowded.select(*CELL_KEY), crowd))


def _cell_bonds(placed: DataFrame) -> DataFrame:
    left = placed.select(*CELL_KEY, F.struct("atom_idx", "x", "y", "z", "r").alias("p"))
    right = left.select("structure_id", "cx", "cy", "cz", F.col("p").alias("q"), F.explode(_offsets(forward_offsets())).alias("o"))
    same = (F.col("o.dx") == 0) & (F.col("o.dy") == 0) & (F.col("o.dz") == 0)
    right = right.select("structure_id", "q", *[(F.col(f"c{c}") + F.col(f"o.d{c}")).alias(f"c{c}") for c in "xyz"], same.alias("same"))
    pairs = left.join(right, CELL_KEY).filter((~F.col("same") | (F.col("p.atom_idx") < F.col("q.atom_idx"))) & _bonded("p", "q"))
    return pairs.select("structure_id", *_pair("p", "q"))


def _offsets(offsets: list[tuple[int, int, int]]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(o, ("dx", "dy", "dz"), strict=True)]) for o in offsets])


def tree_nodes(placed: DataFrame) -> DataFrame:
    """Atoms once for each depth: cell, depth, code (of the part of the cell in Morton order) and the code of the part above,
    with the part's place ux, uy, uz among 2 ^ depth along each axis."""
    fine = 1 << DEPTH
    for c in "xyz":
        placed = placed.withColumn(f"s{c}", F.greatest(F.lit(0), F.least(F.lit(fine - 1), F.floor((F.col(c) / CELL - F.col(f"c{c}")) * fine).cast("int"))))
    each = placed.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in range(DEPTH + 1)])))
    for c in "xyz":
        each = each.withColumn(f"u{c}", F.floor(F.col(f"s{c}") / F.pow(F.lit(2), DEPTH - F.col("depth"))).cast("int"))
    bit = lambda c, k: F.floor(F.col(f"u{c}") / (1 << k)).cast("int") % 2
    code = sum((bit(c, k) * (1 << (3 * k + n)) for k in range(DEPTH) for n, c in enumerate("zyx")), F.lit(0))
    return each.withColumn("code", code.cast("int")).withColumn("above", F.floor(F.col("code") / 8).cast("int"))


def _apart(p: str, q: str) -> tuple[Column, Column]:
    """Squared least and greatest distance of the boxes of nodes ``p`` and ``q``."""
    least, most = F.lit(0.0), F.lit(0.0)
    for c in "xyz":
        low = {n: (F.col(f"{n}.c{c}") + F.col(f"{n}.u{c}") / F.pow(F.lit(2.0), F.col(f"{n}.depth"))) * CELL for n in (p, q)}
        size = {n: CELL / F.pow(F.lit(2.0), F.col(f"{n}.depth")) for n in (p, q)}
        gap = F.greatest(F.lit(0.0), low[q] - low[p] - size[p], low[p] - low[q] - size[q])
        span = F.greatest(low[q] + size[q] - low[p], low[p] + size[p] - low[q])
        least, most = least + gap * gap, most + span * span
    return least, most


def crowded_bonds(placed: DataFrame, crowded: DataFrame, crowd: int = CROWD) -> DataFrame:
    """The bonds of ``heuristic_bonds`` with an atom in one of the ``crowded`` cells.

    Cells are roots of trees: a part with more than ``crowd`` atoms is cut in eight, up to ``DEPTH`` times. Pairs of touching
    roots are followed downwards together, a level a round, and a pair of parts is given up where their boxes are too far apart
    to bond or too close to (parts of the last depth are smaller than the least bonding distance, so atoms that stand in one
    place cost nothing). Atoms meet only in pairs of leaves, cut in chunks of at most about ``crowd``."""
    ring = [o for o in product((-1, 0, 1), repeat=3)]
    near = crowded.select("structure_id", "cx", "cy", "cz", F.explode(_offsets(ring)).alias("o"))
    near = near.select("structure_id", *[(F.col(f"c{c}") + F.col(f"o.d{c}")).alias(f"c{c}") for c in "xyz"]).distinct()
    each = tree_nodes(placed.join(near, CELL_KEY, "left_semi"))
    nodes = each.groupBy(*CELL_KEY, "depth", "code", "above", "ux", "uy", "uz").agg(F.count("*").alias("n"), F.max("r").alias("r"))
    nodes = kept(nodes.withColumn("leaf", (F.col("n") <= crowd) | (F.col("depth") == DEPTH)), "nodes")
    facts = F.struct("cx", "cy", "cz", "depth", "code", "ux", "uy", "uz", "n", "r", "leaf")

    def useful(pairs: DataFrame) -> DataFrame:
        least, most = _apart("p", "q")
        reach = F.col("p.r") + F.col("q.r") + SLACK + 1e-6
        return pairs.filter((least <= reach * reach) & (most >= NEAREST * NEAREST * (1 - 1e-9)))

    roots = nodes.filter("depth = 0").join(crowded.withColumn("crowded", F.lit(True)), CELL_KEY, "left").select(*CELL_KEY, facts.alias("p"), F.coalesce("crowded", F.lit(False)).alias("crowded"))
    others = roots.select(*CELL_KEY, F.col("p").alias("q"), F.col("crowded").alias("q_crowded"), F.explode(_offsets(forward_offsets())).alias("o"))
    others = others.select("structure_id", "q", "q_crowded", *[(F.col(f"c{c}") + F.col(f"o.d{c}")).alias(f"c{c}") for c in "xyz"])
    pairs = kept(useful(roots.join(others, CELL_KEY).filter("crowded or q_crowded").select("structure_id", "p", "q")), "pairs")
    children = nodes.filter("depth > 0").select(F.col("structure_id").alias("of"), *[F.col(f"c{c}").alias(f"of_c{c}") for c in "xyz"], (F.col("depth") - 1).alias("of_depth"), F.col("above").alias("of_code"), facts.alias("child"))
    for _ in range(DEPTH):
        below = pairs
        for n in "pq":
            parent = (F.col("structure_id") == F.col("of")) & (F.col(f"{n}.depth") == F.col("of_depth")) & (F.col(f"{n}.code") == F.col("of_code"))
            for c in "xyz":
                parent &= F.col(f"{n}.c{c}") == F.col(f"of_c{c}")
            cut = below.join(children, parent & ~F.col(f"{n}.leaf"), "left")
            below = cut.withColumn(f"new_{n}", F.coalesce("child", n)).drop(*children.columns)
        # one part cut against itself: its parts meet each other once, and themselves
        itself = F.col("p") == F.col("q")
        once = ~itself | F.col("p.leaf") | (F.col("new_p.code") <= F.col("new_q.code"))
        below = kept(useful(below.filter(once).select("structure_id", F.col("new_p").alias("p"), F.col("new_q").alias("q"))), "pairs")
        drop(pairs)
        pairs = below
    chunks = lambda n: F.sequence(F.lit(0).cast("long"), F.ceil(F.col(f"{n}.n") / crowd) - 1)
    met = pairs.withColumn("itself", F.col("p") == F.col("q")).withColumn("p_chunk", F.explode(chunks("p"))).withColumn("q_chunk", F.explode(chunks("q")))
    met = met.filter("not itself or p_chunk <= q_chunk")
    home = each.join(nodes.filter("leaf").select(*CELL_KEY, "depth", "code", "n"), [*CELL_KEY, "depth", "code"])
    home = home.withColumn("place", F.row_number().over(Window.partitionBy("structure_id", "atom_idx").orderBy("depth"))).filter("place = 1")  # the first leaf from the root
    home = home.withColumn("chunk", F.pmod(F.col("atom_idx"), F.ceil(F.col("n") / crowd)))
    home = kept(home.select(*CELL_KEY, "depth", "code", "chunk", F.struct("atom_idx", "x", "y", "z", "r").alias("atom")), "leaves")
    for n in "pq":
        of = home.select(F.col("structure_id").alias("of"), *[F.col(c).alias(f"of_{c}") for c in ("cx", "cy", "cz", "depth", "code", "chunk")], F.col("atom").alias(f"{n}_atom"))
        on = (F.col("structure_id") == F.col("of")) & (F.col(f"{n}_chunk") == F.col("of_chunk"))
        for c in ("cx", "cy", "cz", "depth", "code"):
            on &= F.col(f"{n}.{c}") == F.col(f"of_{c}")
        met = met.join(of, on).drop(*[c for c in of.columns if c.startswith("of")])
    met = met.filter(~F.col("itself") | (F.col("p_chunk") < F.col("q_chunk")) | (F.col("p_atom.atom_idx") < F.col("q_atom.atom_idx")))
    return met.filter(_bonded("p_atom", "q_atom")).select("structure_id", *_pair("p_atom", "q_atom"))


def bonds(conect: DataFrame, atoms: DataFrame, policy: str = "conect+heuristic", carry: Sequence[str] = (), crowd: int = CROWD) -> DataFrame:
    """Bonds under a policy; a pair from both sources keeps its CONECT order. Columns of the atoms in ``carry`` come along from
    where the atoms meet, as c_a and c_b, so what needs both ends of a bond joins no bonds with atoms.

    Only atoms are shuffled: to blocks of ``SIDE`` cells along each axis and a cell around them. A bond is made in the block of its
    first atom, where its CONECT record is sent too. Structures with a cell of more than ``crowd`` atoms take ``crowded_bonds``."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy: {policy}")
    if policy == "conect-only":
        return _with_ends(conect, atoms, carry)
    if policy == "heuristic-if-missing":
        rest = atoms.join(conect.select("structure_id").distinct(), "structure_id", "left_anti")
        return _with_ends(conect, atoms, carry).unionByName(bonds(conect.limit(0), rest, "conect+heuristic", carry, crowd))
    dense = _dense_structures(atoms, crowd)
    if dense is None:
        return _block_bonds(conect, atoms, carry)
    few, many = ([df.join(dense, "structure_id", how) for df in (conect, atoms)] for how in ("left_anti", "left_semi"))
    both = many[0].withColumn("source", F.lit(0)).unionByName(heuristic_bonds(many[1], crowd).withColumn("source", F.lit(1)))
    both = both.groupBy("structure_id", "a", "b").agg(F.min_by("bond_order", "source").alias("bond_order"))
    return _block_bonds(*few, carry).unionByName(_with_ends(both, many[1], carry))


def _with_ends(bonds: DataFrame, atoms: DataFrame, carry: Sequence[str]) -> DataFrame:
    for end in "ab" if carry else "":
        bonds = bonds.join(atoms.select("structure_id", F.col("atom_idx").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in carry]), ["structure_id", end])
    return bonds.select("structure_id", "a", "b", "bond_order", *[f"{c}_{e}" for e in "ab" for c in carry])


def _dense_structures(atoms: DataFrame, crowd: int) -> DataFrame | None:
    """structure_id of structures with a cell of more than ``crowd`` atoms, None if there are none. Cells are counted only in
    blocks of more atoms than that."""
    placed = atoms.select("structure_id", *[F.floor(single(c) / CELL).alias(f"c{c}") for c in "xyz"])
    placed = placed.select("*", *[F.floor(F.col(f"c{c}") / SIDE).alias(f"b{c}") for c in "xyz"])
    full = kept(placed.groupBy(*_BLOCK).agg(F.count("*").alias("n")).filter(F.col("n") > crowd).drop("n"), "blocks")
    if full.isEmpty():
        drop(full)
        return None
    cells = placed.join(full, _BLOCK, "left_semi").groupBy(*CELL_KEY).agg(F.count("*").alias("n")).filter(F.col("n") > crowd)
    dense = kept(cells.select("structure_id").distinct(), "dense")
    drop(full)
    if dense.isEmpty():
        drop(dense)
        return None
    return dense


def _block_bonds(conect: DataFrame, atoms: DataFrame, carry: Sequence[str], side: int = SIDE, at_once: int = AT_ONCE_ROWS) -> DataFrame:
    cell = lambda of: [F.floor(single(f"{of}{c}") / CELL).alias(f"c{c}") for c in "xyz"]
    placed = atoms.select("structure_id", "atom_idx", *[single(c).alias(f"p{c}") for c in "xyz"], single("covalent").alias("r"), *cell(""), *[F.col(c).alias(f"of_{c}") for c in carry])
    for c in "xyz":
        placed = placed.withColumn(f"b{c}", F.explode(F.sequence(F.floor((F.col(f"c{c}") - 1) / side), F.floor((F.col(f"c{c}") + 1) / side))))
    first = atoms.select("structure_id", F.col("atom_idx").alias("a"), *[(F.floor(single(c) / CELL)).alias(f"c{c}") for c in "xyz"])
    told = conect.join(first, ["structure_id", "a"])
    if carry:
        told = told.join(atoms.select("structure_id", F.col("atom_idx").alias("b"), *[F.col(c).alias(f"of_{c}") for c in carry]), ["structure_id", "b"])
    told = told.select("structure_id", F.col("a").alias("atom_idx"), "b", "bond_order", *[f"of_{c}" for c in carry], *[F.floor(F.col(f"c{c}") / side).alias(f"b{c}") for c in "xyz"])
    fields = {f.name: f.dataType.simpleString() for f in atoms.select("structure_id", *carry).schema}
    schema = ", ".join([f"structure_id {fields['structure_id']}, a int, b int, bond_order int", *[f"{c}_{e} {fields[c]}" for e in "ab" for c in carry]])
    names = list(carry)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in _whole_blocks(batches, at_once):
            yield from _paired(rows, block, names, side).to_batches()

    rows = placed.unionByName(told, allowMissingColumns=True).repartition(*_BLOCK).sortWithinPartitions(*_BLOCK)
    return rows.mapInArrow(make, schema)


def _whole_blocks(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by block in tables of whole blocks, many small ones or one large one, with the number of each row's block."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) < at_once:
            continue
        rows = pa.concat_tables(held)
        block = _block_numbers(rows)
        last = int(np.searchsorted(block, block[-1]))  # the last block may go on
        if last:
            yield rows.slice(0, last), block[:last]
        held = [rows.slice(last)]
    if held:
        rows = pa.concat_tables(held)
        yield rows, _block_numbers(rows)


def _block_numbers(rows: pa.Table) -> np.ndarray:
    ids = rows["structure_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices
    parts = np.stack([ids.to_numpy(), *[rows[c].to_numpy() for c in _BLOCK[1:]]], 1).astype(np.int64)
    return np.concatenate([[0], np.cumsum((parts[1:] != parts[:-1]).any(1))])


def _paired(rows: pa.Table, block: np.ndarray, carry: list[str], side: int) -> pa.Table:
    """The bonds whose first atom lies in its block: CONECT rows have ``b``, the others are atoms of a block and around it."""
    is_told = rows["b"].is_valid().to_numpy()
    told, told_block = rows.filter(pa.array(is_told)), block[is_told]
    atoms, block = rows.filter(pa.array(~is_told)), block[~is_told]
    column = lambda c: atoms[c].to_numpy()
    cell, corner = (np.stack([column(f"{k}{c}") for c in "xyz"], 1).astype(np.int64) for k in "cb")
    place = cell - corner * side + 2  # a cell around the block, and an empty one that keeps rows of cells apart
    size = side + 4
    code = ((block * size + place[:, 0]) * size + place[:, 1]) * size + place[:, 2]
    order = np.argsort(code, kind="stable")
    atoms, code, block, own = atoms.take(pa.array(order)), code[order], block[order], (cell // side == corner).all(1)[order]
    number, at, r = column("atom_idx").astype(np.int64), np.stack([column(f"p{c}") for c in "xyz"], 1), column("r")
    # three cells in a row along z are neighbours in this order: the rest of one's own row, and four rows ahead
    start, end = [np.arange(1, len(code) + 1)], [np.searchsorted(code, code + 1, "right")]
    for dx, dy in ((0, 1), (1, -1), (1, 0), (1, 1)):
        ahead = code + (dx * size + dy) * size
        start.append(np.searchsorted(code, ahead - 1, "left"))
        end.append(np.searchsorted(code, ahead + 1, "right"))
    ps, qs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in zip(start, end, strict=True):
        total = np.cumsum(hi - lo)
        begin = 0
        while begin < len(code):
            past = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + AT_ONCE, "right")))
            n = (hi - lo)[begin:past]
            p = np.repeat(np.arange(begin, past), n)
            q = np.repeat(lo[begin:past] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            d2 = ((at[p] - at[q]) ** 2).T
            d2, reach = d2[0] + d2[1] + d2[2], r[p] + r[q] + SLACK
            met = (d2 >= NEAREST * NEAREST) & (d2 <= reach * reach)
            ps.append(p[met])
            qs.append(q[met])
            begin = past
    p, q = np.concatenate(ps), np.concatenate(qs)
    p, q = np.where(number[p] < number[q], p, q), np.where(number[p] < number[q], q, p)
    p, q = p[own[p]], q[own[p]]
    a, b = told["atom_idx"].to_numpy().astype(np.int64), told["b"].to_numpy().astype(np.int64)
    named = block << 32 | number
    by_name = np.argsort(named)
    told_p = by_name[np.searchsorted(named[by_name], told_block << 32 | a)] if len(a) else np.zeros(0, np.int64)
    new = ~np.isin(p << 32 | number[q], told_p << 32 | b)
    p, q = p[new], q[new]
    firsts, seconds = pa.array(np.concatenate([p, told_p])), pa.array(q)
    out = {"structure_id": atoms["structure_id"].take(firsts), "a": number[firsts].astype(np.int32), "b": np.concatenate([number[q], b]).astype(np.int32)}
    out["bond_order"] = np.concatenate([np.ones(len(p), np.int32), told["bond_order"].to_numpy().astype(np.int32)])
    for c in carry:
        of = atoms[f"of_{c}"]
        out[f"{c}_a"] = of.take(firsts)
        out[f"{c}_b"] = pa.chunked_array([*of.take(seconds).chunks, *told[f"of_{c}"].chunks], of.type)
    return pa.table({n: out[n] for n in ("structure_id", "a", "b", "bond_order", *[f"{c}_{e}" for e in "ab" for c in carry])})


def bond_warnings(heuristic: DataFrame) -> DataFrame:
    return heuristic.groupBy("structure_id").agg(F.format_string("Heuristic bonds: created %d total bonds", F.count("*")).alias("warning"))


def cell_occupancy(atoms: DataFrame, cell: float = CELL) -> DataFrame:
    """Cells with counts and the prefix sum of counts in cell order within a structure."""
    counts = grid_cells(atoms, cell).groupBy("structure_id", "cx", "cy", "cz").agg(F.count("*").alias("n"))
    before = Window.partitionBy("structure_id").orderBy("cx", "cy", "cz").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
