"""What must come out the same however rows are cut: scans by blocks, products, the wave, crowded cells, ribbons."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandloom.operators import backbone, bonds, geometry, scan, surface
from strandloom.plans.queries import scene


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_running_values_by_blocks(spark):
    rng = np.random.default_rng(1)
    data = [(["a", "b", None][int(rng.integers(0, 3))], int(n), None if rng.random() < 0.6 else int(rng.integers(-9, 9))) for n in rng.permutation(300)]
    df = spark.createDataFrame(data, "k string, n long, v int")
    kinds = ("sum", "min", "max", "last", "first")
    got = scan.running(df, ["k"], "n", {f"to_{x}": (x, F.col("v")) for x in kinds}, {f"all_{x}": (x, F.col("v")) for x in kinds}, block=16)
    before = scan.running(df, ["k"], "n", {"b": ("sum", F.col("v"))}, inclusive=False, block=16)
    want, want_before = [], []
    for key in ("a", "b", None):
        mine = sorted((n, v) for k, n, v in data if k == key)
        ends = lambda vs: (sum(vs), min(vs, default=None), max(vs, default=None), vs[-1] if vs else None, vs[0] if vs else None)
        whole = ends([v for _, v in mine if v is not None])
        for i, (n, _) in enumerate(mine):
            so_far = [v for _, v in mine[: i + 1] if v is not None]
            want.append((key, n, *ends(so_far), *whole))
            want_before.append((key, n, sum(v for _, v in mine[:i] if v is not None)))
    columns = [f"{w}_{x}" for w in ("to", "all") for x in kinds]
    assert sorted(map(tuple, got.select("k", "n", *columns).collect()), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, before.select("k", "n", "b").collect()), key=str) == sorted(want_before, key=str)


def test_products_keep_the_order_of_factors(spark):
    """Texts put together stand for a product that is associative and not commutative; three levels of blocks."""
    n = {"x": 150, "y": 1, "z": 9}
    df = spark.createDataFrame([(k, i, f"{k}{i};") for k, m in n.items() for i in range(m)], "k string, at long, v string").repartition(5)
    got = scan.products(df, ["k"], "at", "v", lambda later, earlier: F.concat(earlier, later), block=5)
    assert rows(got, "k", "at", "v") == sorted((k, i, "".join(f"{k}{j};" for j in range(i + 1))) for k, m in n.items() for i in range(m))


def test_one_structure_with_most_lines(spark, sf_dir, monkeypatch):
    """Blocks of a few lines give the tables that one block a structure gives, and no block is larger than its bound."""
    from strandloom.plans.scene import Scene, derived_lines

    lines = derived_lines(spark, sf_dir).filter("structure_id <= 3")
    # structure 1 holds several models' worth of lines of the others, one after another
    large = lines.withColumn("line_no", F.col("line_no") + F.col("structure_id") * 100_000).withColumn("structure_id", F.lit(1))
    lines = large.unionByName(lines.filter("structure_id > 1")).cache()
    tables = {"records": ("structure_id", "line_no", "model", "accepted", "selected"), "atoms": ("structure_id", "atom_idx", "serial", "chain_idx", "residue_idx"), "segments": ("structure_id", "chain_idx", "start_residue", "end_residue", "ter_line"), "points": ("structure_id", "point", "segment", "atom_idx", "segment_start", "segment_end")}
    found = {}
    for size in (50, 1 << 40):
        monkeypatch.setattr(scan, "BLOCK", size)
        s = Scene(lines, segments="all")
        found[size] = {k: sorted(map(str, map(tuple, getattr(s, k).select(*c).collect()))) for k, c in tables.items()}
    assert found[50] == found[1 << 40] and all(found[50].values())
    per_block = lines.groupBy("structure_id", F.floor(F.col("line_no") / 50)).count().agg(F.max("count")).first()[0]
    assert per_block <= 50


def plain_wave(inside, bound, cut):
    """The wave, voxel after voxel."""
    full, dist = set(inside), dict.fromkeys(bound, 0)
    point, shell = {v: v for v in dist}, sorted(dist)
    while shell:
        out, queued = [], set()
        for v in shell:
            p = point[v]
            for step in surface.WAVE_ORDER:
                n = tuple(a + b for a, b in zip(v, step, strict=True))
                d = sum((a - b) ** 2 for a, b in zip(n, p, strict=True))
                if n in full and (n not in dist or d < dist[n]):
                    dist[n], point[n] = d, p
                    if n not in queued:
                        queued.add(n)
                        out.append(n)
        shell = [v for v in out if dist[v] <= 1.0404 * cut * cut]
    return {v: (d, point[v]) for v, d in dist.items()}


def test_wave_is_that_of_voxels_in_turn(spark):
    """Random solids, also with holes and with boundaries that were thinned out, so that points are overtaken within a shell."""
    rng = np.random.default_rng(4)
    cells, bound, cuts, want = [], [], [], {}
    for sid, cut in enumerate((1.4, 2.8, 4.2, 5.6)):
        centres, reach = rng.integers(0, 10, (3, 3)), rng.integers(12, 40, 3)
        own = [c for c in np.ndindex(22, 22, 22) if (((centres - (np.array(c) - 6)) ** 2).sum(axis=1) <= reach).any() and (sid < 2 or rng.random() < 0.9)]
        full = set(own)
        edge = [c for c in own if any(tuple(np.add(c, o)) not in full for o in surface.NEIGHBOURS) and (sid < 1 or rng.random() < 0.4)]
        for v, (d, p) in plain_wave(own, edge, cut).items():
            want[sid, *map(int, v)] = (d, tuple(map(int, p)))
        cells += [(sid, *map(int, c)) for c in own]
        bound += [(sid, *map(int, c)) for c in edge]
        cuts.append((sid, cut))
    schema = "structure_id int, i int, j int, k int"
    got = surface.distance_wave(spark.createDataFrame(cells, schema), spark.createDataFrame(bound, schema), spark.createDataFrame(cuts, "structure_id int, cut double"))
    assert {(r["structure_id"], r["i"], r["j"], r["k"]): (r["d"], tuple(r["p"])) for r in got.collect()} == want


def _atoms(spark, places, radius=0.76):
    data = [("s", n, *map(float, p), radius) for n, p in enumerate(places)]
    return spark.createDataFrame(data, "structure_id string, atom_idx int, x float, y float, z float, covalent float")


def test_bonds_of_crowded_cells(spark):
    """Cells cut at 8 atoms, down to the last depth, against all pairs of touching cells."""
    rng = np.random.default_rng(2)
    places = np.concatenate([rng.uniform(-3, 3, (150, 3)), rng.normal(1.2, 0.15, (60, 3)), np.tile([[2.0, 2.0, 2.0]], (30, 1)), [[2.45, 2, 2], [2.5, 2.5, 2.5], [-2.5, 0, 0]]])
    atoms = _atoms(spark, places)
    f = np.array([r[0:3] for r in atoms.select("x", "y", "z").collect()])
    reach = 2 * float(np.float32(0.76)) + 0.45
    cell = np.floor(f / 2.5)
    want = sorted((i, j) for i, j in combinations(range(len(f)), 2) if abs(cell[i] - cell[j]).max() <= 1 and 0.4**2 <= ((f[i] - f[j]) ** 2).sum() <= reach**2)
    for crowd in (8, 512):
        got = rows(bonds.heuristic_bonds(atoms, crowd), "a", "b")
        assert got == want


def test_very_many_atoms_in_one_place(spark):
    """10^5 atoms of one cell would be 5 * 10^9 pairs; they stand too close to bond, and only one neighbour bonds with them."""
    n = 100_000
    crowd = spark.range(n).select(F.lit("s").alias("structure_id"), F.col("id").cast("int").alias("atom_idx"), *[(F.lit(1.01) + (F.col("id") % 7) * 0.01).cast("float").alias(c) for c in "xyz"], F.lit(0.76).cast("float").alias("covalent"))
    one = spark.createDataFrame([("s", n, 2.2, 1.0, 1.0, 0.76)], "structure_id string, atom_idx int, x float, y float, z float, covalent float")
    got = bonds.heuristic_bonds(crowd.unionByName(one))
    assert got.agg(F.count("*"), F.min("b"), F.count_distinct("a")).first() == (n, n, n)


def _turn(v, axis, angle):
    return v * math.cos(angle) + np.cross(axis, v) * math.sin(angle) + axis * (axis @ v) * (1 - math.cos(angle))


def plain_frames(p, segs, twist):
    """Curve points, normals and binormals, each frame turned from the one before."""
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else v
    n = len(p)
    full = np.vstack([2 * p[0] - p[1], p, 2 * p[-1] - p[-2]])

    def curve(u):
        k = min(int(u * (n - 1)), n - 2)
        t = u * (n - 1) - k
        a, b, c, d = full[k : k + 4]
        return (2 * b - 2 * c + (c - a) / 2 + (d - b) / 2) * t**3 + (-3 * b + 3 * c - (c - a) - (d - b) / 2) * t**2 + (c - a) / 2 * t + b

    where = [curve(i / segs) for i in range(segs + 1)]
    tangents = [unit(curve(min(1, i / segs + 1e-4)) - curve(max(0, i / segs - 1e-4))) for i in range(segs + 1)]
    begin = unit(where[1] - where[0])
    normal, out = unit(np.cross(begin, [0.0, 1.0, 0.0] if abs(begin[1]) < 0.9 else [1.0, 0.0, 0.0])), []
    for i, t in enumerate(tangents):
        axis = np.cross(tangents[i - 1], t) if i else np.zeros(3)
        size = np.linalg.norm(axis)
        if size >= 1e-6:
            normal = unit(_turn(normal, axis / size, math.acos(float(np.clip(tangents[i - 1] @ t, -1, 1)))))
        if twist[i]:
            normal = _turn(normal, t, twist[i])
        out.append((where[i], normal, unit(np.cross(t, normal))))
    return out


@pytest.mark.parametrize("per_point", [4, 9])
def test_frames_are_those_turned_one_by_one(spark, per_point):
    """Long and short segments, a straight one along y, one that turns back, points that repeat; helices twist."""
    rng = np.random.default_rng(3)
    shapes = [np.cumsum(rng.normal(size=(180, 3)), axis=0), rng.normal(size=(2, 3)), np.array([[0, k, 0] for k in range(5)], float), np.array([[0, 0, 0], [3, 0, 0], [0, 0, 0.5], [0, 0, 0.5], [1, 1, 1]], float)]
    shapes = [p.astype(np.float32).astype(float) for p in shapes]
    data, start, residue = [], 0, 0
    for seg, p in enumerate(shapes):
        for n, xyz in enumerate(p.tolist()):
            data.append(("s", seg, start + n, start, start + len(p), residue, *xyz))
            residue += 1
        start += len(p)
    points = spark.createDataFrame(data, "structure_id string, segment int, point int, segment_start int, segment_end int, residue_idx int, x float, y float, z float")
    kinds = spark.createDataFrame([("s", r, 1 if r % 40 < 15 else 2, 30 if r % 40 >= 15 else None) for r in range(residue) if r % 40 < 31], "structure_id string, residue_idx int, kind int, sheet_end int")
    atoms = spark.createDataFrame([("s", r, r, 0) for r in range(residue)], "structure_id string, atom_idx int, residue_idx int, chain_idx int")
    flat, tube = (sorted(map(tuple, f(points, atoms, kinds, per_point=per_point).select("segment", "sample", "corner", "x", "y", "z").collect())) for f in (geometry.flat_ribbons, geometry.tube_ribbons))
    kind_of = {r["residue_idx"]: (r["kind"], r["sheet_end"]) for r in kinds.collect()}
    want_flat, want_tube, first = [], [], 0
    for seg, p in enumerate(shapes):
        n, segs = len(p), max(8, len(p) * per_point)
        near = [first + max(0, min(n - 1, math.floor(i / segs * (n - 1) + 0.5))) for i in range(segs + 1)]
        twist = [2 * math.pi / 3.6 / max(1.0, segs / max(1, n - 1)) if kind_of.get(r, (0, 0))[0] == 1 else 0.0 for r in near]
        for i, (where, normal, binormal) in enumerate(plain_frames(p, segs, twist)):
            kind, end = kind_of.get(near[i], (0, None))
            wide = 1.2 if kind == 1 else 1.2 * 1.4 if kind == 2 else 1.2 * 0.6
            if kind == 2 and (left := (-1 if end is None else end) - near[i]) <= 2:
                tip = max(0.0, min(1.0, left / 2))
                wide *= (1.3 - 0.3 * (1 - tip)) * tip
            for k, (a, b) in enumerate(((1, 1), (-1, 1), (-1, -1), (1, -1))):
                want_flat.append((seg, i, k, *(where + a * normal * wide / 2 + b * binormal * wide * 0.15 / 2)))
        for i, (where, normal, binormal) in enumerate(plain_frames(p, segs, [0.0] * (segs + 1))):
            want_tube += [(seg, i, k, *(where + 0.4 * (math.cos(math.pi * k / 4) * normal + math.sin(math.pi * k / 4) * binormal))) for k in range(8)]
        first += n
    for got, want in ((flat, sorted(want_flat)), (tube, sorted(want_tube))):
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert np.allclose(np.array(got)[:, 3:], np.array(want)[:, 3:], atol=1e-9, rtol=0)


def test_ribbon_faces_join_the_rings(spark, sf_dir):
    s = scene(spark, sf_dir)
    corners = geometry.tube_ribbons(s.points, s.atoms, backbone.residue_kinds(s.spans)).filter("structure_id = 1 and segment = 0")
    faces = geometry.ribbon_faces(corners, 8)
    last = corners.agg(F.max("sample")).first()[0]
    assert faces.count() == 2 * 8 * last and faces.agg(F.max(F.greatest("v0", "v1", "v2"))).first()[0] == 8 * (last + 1) - 1
