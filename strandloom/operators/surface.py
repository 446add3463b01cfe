"""Molecular surfaces over voxel grids: filling, boundary, distance, surface nets.

Filling, boundary, vertices and faces of solids of balls are made tile by tile (``tiles``), so only balls are shuffled. Of other
solids, runs along their columns (``solids``) or a row for each voxel, they are joins, aggregations and sweeps of columns. The
distance wave of the solvent-excluded surface depends on the order in which voxels are visited; it runs shell by shell over the
voxels of all structures, and each offer carries its place in that order.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import drop, kept
from . import solids, tiles
from .atoms import single

PROBE, DEFAULT_SCALE, MARGIN, LARGE_VOLUME = 1.4, 2, 5.5, 1_000_000
NEIGHBOURS = [o for o in product((-1, 0, 1), repeat=3) if any(o)]
# The order in which the wavefront visits the neighbours of a voxel.
WAVE_ORDER = (
    (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1), (1, 1, 0), (1, -1, 0), (-1, 1, 0), (-1, -1, 0), (1, 0, 1), (1, 0, -1), (-1, 0, 1),
    (-1, 0, -1), (0, 1, 1), (0, 1, -1), (0, -1, 1), (0, -1, -1), (1, 1, 1), (1, 1, -1), (1, -1, 1), (-1, 1, 1), (1, -1, -1), (-1, -1, 1), (-1, 1, -1), (-1, -1, -1),
)


def surface_input(atoms: DataFrame) -> DataFrame:
    """The rows that surfaces need: structure_id, atom_idx, x, y, z, radius."""
    return atoms.select("structure_id", "atom_idx", *[single(c).alias(c) for c in ("x", "y", "z", "radius")])


def grids(atoms: DataFrame, kind: str = "vdw", probe: float = PROBE, voxel: float | None = None) -> DataFrame:
    """One row a structure: scale, origin shift (tx, ty, tz) and sizes (nx, ny, nz) of its grid."""
    inflate = 0.0 if kind == "vdw" else probe
    r = F.col("radius") + inflate
    box = atoms.groupBy("structure_id").agg(*[f.alias(n) for c in "xyz" for f, n in ((F.min(F.col(c) - r), f"lo_{c}"), (F.max(F.col(c) + r), f"hi_{c}"))])
    volume = (F.col("hi_x") - F.col("lo_x")) * (F.col("hi_y") - F.col("lo_y")) * (F.col("hi_z") - F.col("lo_z"))
    usual = float(max(1, int(np.floor(1 / voxel + 0.5)))) if voxel else float(DEFAULT_SCALE)
    box = box.withColumn("scale", F.when(volume > LARGE_VOLUME, DEFAULT_SCALE / 2).otherwise(usual))
    pad = MARGIN / F.col("scale") + inflate
    low = {c: F.floor((F.col(f"lo_{c}") - pad) * F.col("scale")) / F.col("scale") for c in "xyz"}
    high = {c: F.ceil((F.col(f"hi_{c}") + pad) * F.col("scale")) / F.col("scale") for c in "xyz"}
    sizes = [(F.ceil(F.col("scale") * (high[c] - low[c])) + 1).cast("int").alias(f"n{c}") for c in "xyz"]
    return box.select("structure_id", "scale", *[(-low[c]).alias(f"t{c}") for c in "xyz"], *sizes)


def shared_radii(atoms: DataFrame, grid: DataFrame, kind: str = "vdw", probe: float = PROBE) -> DataFrame:
    """Atoms with grid centre (ci, cj, ck) and the ball radius in voxels. Radii that round to one key share the ball of
    the structure's first atom with that key."""
    inflate = 0.0 if kind == "vdw" else probe
    tr = (F.col("radius") + inflate) * F.col("scale") + 0.5
    kinds = atoms.groupBy("structure_id", "radius").agg(F.min("atom_idx").alias("atom_idx")).join(grid, "structure_id").withColumn("tr", tr)
    first = Window.partitionBy("structure_id", F.floor(F.col("tr") + 0.5)).orderBy("atom_idx")  # a row a radius
    kinds = kinds.withColumn("ball", F.first("tr").over(first)).drop("atom_idx", "tr")
    rows = atoms.join(kinds, ["structure_id", "radius"])
    centre = [F.floor(F.col("scale") * (F.col(c) + F.col(f"t{c}")) + 0.5).cast("int").alias(f"c{v}") for c, v in zip("xyz", "ijk", strict=True)]
    return rows.select("structure_id", "atom_idx", *centre, "nx", "ny", "nz", "ball", *[c for c in ("limit",) if c in grid.columns])


def fill(atoms: DataFrame, grid: DataFrame, kind: str = "vdw", probe: float = PROBE) -> DataFrame:
    """Voxels inside any ball: structure_id, i, j, k, atom_idx, d2; the owner is the nearest centre, the first atom on ties."""
    return tiles.voxels(shared_radii(atoms, grid, kind, probe))


def boundary(solid: DataFrame, grid: DataFrame) -> DataFrame:
    """Voxels of ``solid`` (voxels or runs) with one of 26 neighbours in the grid that is not inside."""
    return solids.voxels(solids.boundary(solids.as_runs(solid), grid))


_CELL = ["structure_id", "i", "j", "k"]


def _steps(frontier: DataFrame) -> DataFrame:
    """What each voxel of the frontier offers its 26 neighbours: their place, the squared distance to its own boundary
    point p, and the offer's rank (the voxel's own rank, then the number of the step)."""
    steps = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for n, (a, b, c) in enumerate(WAVE_ORDER)])
    offers = frontier.select("structure_id", "rank", "p", *[F.col(v).alias(f"from_{v}") for v in "ijk"], F.explode(steps).alias("s"))
    for v, o in zip("ijk", "abc", strict=True):
        offers = offers.withColumn(v, F.col(f"from_{v}") + F.col(f"s.{o}"))
    d = sum(((F.col(v) - F.col("p")[v]) * (F.col(v) - F.col("p")[v]) for v in "ijk"), F.lit(0))
    return offers.select(*_CELL, d.alias("d"), "rank", F.col("s.n").alias("n"), "p")


def _settled(frontier: DataFrame) -> DataFrame:
    """The frontier with the boundary points that its voxels carry when their turn comes.

    In a shell, voxels take their turns by rank, and an earlier one may bring a later one a nearer point before that one's
    turn. Such influence only goes up the ranks, so rounds in which all voxels of the shell offer what they carry to the later
    ones end in the one state that turns in order lead to; there are as many rounds as such influences follow each other."""
    start = frontier
    while True:
        target = start.select(*_CELL, F.col("rank").alias("own"), F.col("d").alias("own_d"))
        offers = _steps(frontier).join(target, _CELL).filter("rank < own and d < own_d")
        best = offers.groupBy(*_CELL).agg(F.min(F.struct("d", "rank", "n", "p")).alias("best"))
        new = kept(start.join(best, _CELL, "left").withColumn("p", F.coalesce("best.p", "p")).drop("best"), "shell")
        steady = new.select(*_CELL, "p").join(frontier.select(*_CELL, F.col("p").alias("before")), _CELL).filter("p <> before").isEmpty()
        if frontier is not start:
            drop(frontier)
        frontier = new
        if steady:
            return frontier


def distance_wave(voxels: DataFrame, bound: DataFrame, cuts: DataFrame) -> DataFrame:
    """structure_id, i, j, k, d, p: the squared distance of each voxel that the wave reaches to the boundary point p it carries.

    The wave starts from the boundary voxels in order of place. Shell by shell, each voxel in turn offers its point to its 26
    neighbours in ``WAVE_ORDER``; a neighbour takes it if it has none yet or a farther one, and joins the next shell, whose
    order is that of first taking; a voxel farther than 1.0404 times the squared ``cut`` of its structure (``cuts``:
    structure_id, cut) offers nothing. The outcome depends on that order, so an offer's rank goes with it: of the nearest offers
    the first one holds. A shell is a few joins over all structures and one stored table; the cut bounds the shells."""
    place = [F.col(v) for v in "ijk"]
    wave = kept(bound.select(*_CELL, F.lit(0).alias("d"), F.struct(*place).alias("p"), F.array(*place).alias("rank")), "wave")
    limits = cuts.select("structure_id", (F.col("cut") * F.col("cut") * 1.0404).alias("most"))
    reached = kept(wave.drop("rank"), "reached")
    first = True
    while not wave.isEmpty():
        settled = wave if first else _settled(wave)  # the boundary itself cannot come nearer
        known = reached.select(*_CELL, F.col("d").alias("known"))
        offers = _steps(settled).join(voxels.select(*_CELL), _CELL, "left_semi").join(known, _CELL, "left").filter("known is null or d < known")
        taken = offers.groupBy(*_CELL).agg(F.min(F.struct("d", "rank", "n", "p")).alias("best"), F.min(F.struct("rank", "n")).alias("first"))
        taken = kept(taken.select(*_CELL, "best.d", "best.p", F.concat("first.rank", F.array("first.n")).alias("rank")), "taken")
        after = kept(reached.join(taken.select(*_CELL), _CELL, "left_anti").unionByName(taken.drop("rank")), "reached")
        following = kept(taken.join(limits, "structure_id").filter("d <= most").select(wave.columns), "wave")
        drop(reached, taken, wave, *([settled] if settled is not wave else []))
        wave, reached, first = following, after, False
    drop(wave)
    return reached


def ses_solid(voxels: DataFrame, bound: DataFrame, grid: DataFrame, probe: float = PROBE) -> DataFrame:
    """Voxels of the inflated solid that stay when the probe is rolled off: those the wave does not reach, or reaches at the
    cut-off distance or beyond."""
    cuts = grid.select("structure_id", (F.col("scale") * probe).alias("cut"), F.greatest(F.lit(0.0), F.col("scale") - 0.5).alias("over"))
    near = distance_wave(voxels, bound, cuts).join(cuts, "structure_id").filter(F.col("d") < F.col("cut") * F.col("cut") - 0.5 / (0.1 + F.col("over")))
    return voxels.join(near.select(*_CELL), _CELL, "left_anti")


def carve_limits(grid: DataFrame, probe: float = PROBE) -> DataFrame:
    """``grid`` with ``limit``: voxels that the wave reaches below this squared distance go.

    Up to a limit of 4 no wave is needed: a voxel nearer than that is a neighbour of the boundary voxel that it is near to, which
    offers itself in the first shell, and no offer is nearer than the nearest boundary voxel."""
    cut, over = F.col("scale") * probe, F.greatest(F.lit(0.0), F.col("scale") - 0.5)
    return grid.withColumn("limit", cut * cut - 0.5 / (0.1 + over))


def ses_voxels(atoms: DataFrame, grid: DataFrame, probe: float = PROBE) -> DataFrame:
    """The voxels of ``ses_solid`` of the balls of ``atoms``, with their owners: by tiles where the limit allows, by the wave
    where it does not."""
    grid = carve_limits(grid, probe)
    near = tiles.voxels(shared_radii(atoms, grid.filter(F.col("limit") <= 4), "ses", probe))
    far = grid.filter(F.col("limit") > 4)
    if far.isEmpty():
        return near
    placed = shared_radii(atoms, far.drop("limit"), "ses", probe)
    return near.unionByName(ses_solid(kept(tiles.voxels(placed), "voxels"), tiles.voxels(placed, "boundary"), far, probe))


def net_vertices(solid: DataFrame, grid: DataFrame) -> DataFrame:
    """One vertex for each grid cell with corners of ``solid`` (voxels or runs) inside and outside: structure_id, i, j, k (cell), x, y, z in grid
    units, the mean of the middles of the cell edges that cross, and owner voxel coordinates."""
    cells = solids.mixed_cells(solids.as_runs(solid), grid)
    inside = lambda n: F.col("mask").bitwiseAND(F.lit(1 << n)) > 0
    total, sums = F.lit(0), {c: F.lit(0.0) for c in "xyz"}
    for n, m in ((n, n | 1 << axis) for axis in range(3) for n in range(8) if not n >> axis & 1):
        cross = (inside(n) != inside(m)).cast("int")
        total = total + cross
        for at, c in enumerate("xyz"):
            sums[c] = sums[c] + cross * (((n >> at & 1) + (m >> at & 1)) / 2)
    return cells.select("structure_id", "i", "j", "k", *[(F.col(v) + sums[c] / total).alias(c) for c, v in zip("xyz", "ijk", strict=True)])


def net_quads(vertices: DataFrame) -> DataFrame:
    """Quads of four cells with vertices: structure_id, plane and the cells of corners a, b, c, d."""
    planes = {"xz": ((0, 0, 0), (-1, 0, 0), (-1, 0, -1), (0, 0, -1)), "yz": ((0, 0, 0), (0, -1, 0), (0, -1, -1), (0, 0, -1)), "xy": ((0, 0, 0), (-1, 0, 0), (-1, -1, 0), (0, -1, 0))}
    rows = F.array(*[F.struct(F.lit(p).alias("plane"), F.lit(n).alias("corner"), *[F.lit(-s).alias(v) for v, s in zip("abc", o, strict=True)]) for p, offsets in planes.items() for n, o in enumerate(offsets)])
    # the vertex of a cell takes each corner of the quads around it; a quad stands where all four corners meet
    each = vertices.select("structure_id", "i", "j", "k", "x", "y", "z", F.explode(rows).alias("o"))
    base = [(F.col(v) + F.col(f"o.{s}")).alias(f"q{v}") for v, s in zip("ijk", "abc", strict=True)]
    met = each.select("structure_id", *base, F.col("o.plane").alias("plane"), F.struct(F.col("o.corner").alias("corner"), "i", "j", "k", "x", "y", "z").alias("v"))
    quads = met.groupBy("structure_id", "qi", "qj", "qk", "plane").agg(F.array_sort(F.collect_list("v")).alias("v")).filter(F.size("v") == 4)
    return quads.filter("plane <> 'xy' or qk > 0")


def triangles(quads: DataFrame, inflated: DataFrame) -> DataFrame:
    """Two triangles a quad, turned outwards by the field's gradient at its centre; degenerate ones are left out.

    The field is 1 at voxels of ``inflated`` (the solid before carving) and is sampled trilinearly at six points half a
    voxel from the centre, so the corners around each point are looked up by an equi-join."""
    centre = [(sum((F.col("v")[n][c] for n in range(4)), F.lit(0.0)) / 4).alias(f"m{c}") for c in "xyz"]
    q = quads.select("structure_id", "qi", "qj", "qk", "plane", "v", *centre)
    probes = F.array(*[F.struct(F.lit(axis).alias("axis"), F.lit(s).alias("s")) for axis in range(3) for s in (-1, 1)])
    p = q.select("structure_id", "qi", "qj", "qk", "plane", "mx", "my", "mz", F.explode(probes).alias("p"))
    for n, c in enumerate("xyz"):
        p = p.withColumn(f"p{c}", F.col(f"m{c}") + F.when(F.col("p.axis") == n, F.col("p.s") * 0.5).otherwise(0.0))
    corner = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in product((0, 1), repeat=3)])
    p = p.withColumn("o", F.explode(corner))
    weight = F.lit(1.0)
    for c, v, a in zip("xyz", "ijk", "abc", strict=True):
        low = F.floor(f"p{c}")
        p = p.withColumn(v, (low + F.col(f"o.{a}")).cast("int"))
        f = F.col(f"p{c}") - low
        weight = weight * F.when(F.col(f"o.{a}") == 1, f).otherwise(1 - f)
    met = p.withColumn("w", weight).join(inflated.select("structure_id", "i", "j", "k"), ["structure_id", "i", "j", "k"])
    grad = met.groupBy("structure_id", "qi", "qj", "qk", "plane").agg(*[F.sum(F.when(F.col("p.axis") == n, -F.col("p.s") * F.col("w")).otherwise(0.0)).alias(f"g{c}") for n, c in enumerate("xyz")])
    q = q.join(grad, ["structure_id", "qi", "qj", "qk", "plane"], "left")
    e = lambda n, c: F.col("v")[n][c] - F.col("v")[0][c]
    normal = {"x": e(1, "y") * e(2, "z") - e(1, "z") * e(2, "y"), "y": e(1, "z") * e(2, "x") - e(1, "x") * e(2, "z"), "z": e(1, "x") * e(2, "y") - e(1, "y") * e(2, "x")}
    turned = sum((normal[c] * F.coalesce(F.col(f"g{c}"), F.lit(0.0)) for c in "xyz"), F.lit(0.0)) < 0
    v = [F.col("v")[n] for n in range(4)]
    faces = F.when(turned, F.array(F.array(v[0], v[2], v[1]), F.array(v[0], v[3], v[2]))).otherwise(F.array(F.array(v[0], v[1], v[2]), F.array(v[0], v[2], v[3])))
    out = q.select("structure_id", "qi", "qj", "qk", "plane", F.posexplode(faces).alias("half", "f"))
    d = lambda n, c: F.col("f")[n][c] - F.col("f")[0][c]
    cross = [d(1, a) * d(2, b) - d(1, b) * d(2, a) for a, b in (("y", "z"), ("z", "x"), ("x", "y"))]
    return out.select("*", *[c.alias(f"n{a}") for c, a in zip(cross, "xyz", strict=True)]).filter("nx * nx + ny * ny + nz * nz > 1e-10")


def vertex_normals(faces: DataFrame) -> DataFrame:
    """Unit sum of the unnormalised normals of a vertex's faces, by cell."""
    each = faces.select("structure_id", F.explode("f").alias("v"), "nx", "ny", "nz")
    sums = each.groupBy("structure_id", "v.i", "v.j", "v.k").agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in "xyz"])
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    return sums.select("structure_id", "i", "j", "k", *[F.when(size > 0, F.col(f"n{c}") / size).otherwise(0.0).alias(f"n{c}") for c in "xyz"])


def _nearest_node() -> dict[str, Column]:
    """Columns i, j, k: the grid node nearest to x, y, z (grid units), within the grid."""
    return {v: F.greatest(F.lit(0), F.least(F.col(f"n{c}") - 1, F.floor(F.col(c) + 0.5).cast("int"))) for c, v in zip("xyz", "ijk", strict=True)}


def vertex_owners(vertices: DataFrame, voxels: DataFrame, grid: DataFrame, kind: str = "vdw") -> DataFrame:
    """Vertices in structure coordinates with the atom that owns the nearest grid node; nodes outside have owner 0 for
    van der Waals surfaces and 4294967295 for the others."""
    at = vertices.join(grid, "structure_id")
    at = at.withColumns({f"cell_{v}": F.col(v) for v in "ijk"}).withColumns(_nearest_node())
    owned = at.join(voxels.select("structure_id", "i", "j", "k", "atom_idx"), ["structure_id", "i", "j", "k"], "left")
    place = [(F.col(c) / F.col("scale") - F.col(f"t{c}")).cast("float").alias(c) for c in "xyz"]
    return owned.select("structure_id", *[F.col(f"cell_{v}").alias(v) for v in "ijk"], *place, F.coalesce(F.col("atom_idx").cast("long"), F.lit(0 if kind == "vdw" else 4294967295)).alias("atom_idx"))


def first_if_outside(kind: str = "vdw") -> Column:
    """The owner of a vertex of ``tiles.vertices``, also where its node is outside, as ``vertex_owners``."""
    return F.coalesce(F.col("atom_idx").cast("long"), F.lit(0 if kind == "vdw" else 4294967295)).alias("atom_idx")


def placed_vertices(vertices: DataFrame, grid: DataFrame, kind: str = "vdw") -> DataFrame:
    """``tiles.vertices`` in structure coordinates, with an owner where the node is outside, as ``vertex_owners``."""
    at = vertices.join(grid.select("structure_id", "scale", "tx", "ty", "tz"), "structure_id")
    place = [(F.col(c) / F.col("scale") - F.col(f"t{c}")).cast("float").alias(c) for c in "xyz"]
    return at.select("structure_id", "i", "j", "k", *place, first_if_outside(kind))


def surface(atoms: DataFrame, kind: str = "vdw", probe: float = PROBE, voxel: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices (with normals and owners) and faces of the "vdw", "sas" or "ses" surface of each structure."""
    if kind not in ("vdw", "sas", "ses"):
        raise ValueError(f"unknown surface: {kind}")
    atoms = surface_input(atoms)
    grid = grids(atoms, kind, probe, voxel)
    grid = carve_limits(grid, probe) if kind == "ses" else grid
    near = grid.filter(F.col("limit") <= 4) if kind == "ses" else grid
    placed = shared_radii(atoms, near, kind, probe)
    vertices, faces = placed_vertices(tiles.vertices(placed), near, kind), tiles.triangles(placed)
    if kind == "ses" and not grid.filter(F.col("limit") > 4).isEmpty():
        far = grid.filter(F.col("limit") > 4)
        placed = shared_radii(atoms, far.drop("limit"), kind, probe)
        voxels = kept(tiles.voxels(placed), "voxels")
        net = net_vertices(ses_solid(voxels, tiles.voxels(placed, "boundary"), far, probe), far)
        vertices = vertices.unionByName(vertex_owners(net, voxels, far, kind))
        faces = faces.unionByName(triangles(net_quads(net), voxels).select(faces.columns))
    return vertices.join(vertex_normals(faces), ["structure_id", "i", "j", "k"], "left"), faces


def areas(atoms: DataFrame, kind: str = "vdw", probe: float = PROBE, voxel: float | None = None) -> DataFrame:
    """structure_id, plane, qi, qj, qk, half, area of the faces of ``surface``."""
    columns = ["structure_id", "plane", "qi", "qj", "qk", "half"]
    if kind not in ("vdw", "sas"):
        _, faces = surface(atoms, kind, probe, voxel)
        return faces.select(*columns, (F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")) / 2).alias("area"))
    atoms = surface_input(atoms)
    return tiles.areas(shared_radii(atoms, grids(atoms, kind, probe, voxel), kind, probe)).select(*columns, "area")
