"""Interval joins and run-length solids against plain versions."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandloom.operators import intervals, solids, surface
from strandloom.plans.queries import scene


def rows(df, *columns):
    return sorted(map(tuple, df.select(*(columns or df.columns)).collect()), key=str)


SPAN = "k string, s int, e int, name string"


def _random(seed):
    rng = np.random.default_rng(seed)
    keys = ["a", "a", "a", "b", None]
    points = [(keys[int(rng.integers(0, 5))], int(rng.integers(-9000, 9000)), int(rng.integers(0, 99))) for _ in range(400)]
    points += points[:20] + [("a", None, 1)]
    spans = []
    for n in range(60):
        start = int(rng.integers(-9500, 9000))
        spans.append((keys[int(rng.integers(0, 5))], start, start + int(10 ** rng.uniform(0, 4.3)) - 2, f"s{n}"))
    return points, spans + spans[:5] + [("a", None, 4, "no start"), ("a", 5, None, "no end"), ("c", -9000, 9000, "no points")]


def test_points_within_spans(spark):
    points, spans = _random(3)
    got = intervals.within(spark.createDataFrame(points, "k string, at int, v int"), spark.createDataFrame(spans, SPAN), ["k"], "at", "s", "e")
    assert got.columns == ["k", "at", "v", "s", "e", "name"]
    met = [(*p, *q[1:]) for p, q in product(points, spans) if p[0] is not None and p[0] == q[0] and None not in (p[1], q[1], q[2]) and q[1] <= p[1] <= q[2]]
    assert met and rows(got) == sorted(met, key=str)


def test_a_span_is_a_few_nodes(spark):
    """Rows a span becomes do not grow with its length below the highest level, and its nodes cover each position once."""
    spans = [(0, 0), (5, 4), (-3, 40), (15, 4097), (-70_000, 70_001), (4096, 8191)]
    df = spark.createDataFrame(spans, "s long, e long").withColumn("n", intervals._nodes(F.col("s"), F.col("e")))
    for start, end, nodes in df.collect():
        low = [x for x in nodes if x.level < intervals.LEVELS - 1]
        assert len(low) <= 30 * (intervals.LEVELS - 1) and len(nodes) - len(low) <= max(0, end - start + 1) // 4096
        covered = sorted(at for x in nodes for at in range(x.node << intervals.BITS * x.level, (x.node + 1) << intervals.BITS * x.level))
        assert covered == list(range(start, end + 1))


def test_first_and_last_within_reach(spark, monkeypatch):
    from strandloom.operators import scan

    monkeypatch.setattr(scan, "BLOCK", 500)
    points, spans = _random(5)
    got = intervals.reach(spark.createDataFrame(points, "k string, at int, v int"), spark.createDataFrame(spans, SPAN), ["k"], "at", "s", "e", "v")
    want = []
    for k, s, e, name in spans:
        if s is None or e is None:
            continue
        mine = [(at, v) for key, at, v in points if key == k and k is not None and at is not None]
        want.append((k, s, e, name, min((v for at, v in mine if at >= s), default=None), max((v for at, v in mine if at <= e), default=None)))
    assert rows(got) == sorted(want, key=str)


def test_empty_sides(spark):
    points, spans = spark.createDataFrame([], "k string, at int, v int"), spark.createDataFrame([("a", 1, 2, "x")], SPAN)
    assert intervals.within(points, spans, ["k"], "at", "s", "e").isEmpty()
    assert rows(intervals.reach(points, spans, ["k"], "at", "s", "e", "v")) == [("a", 1, 2, "x", None, None)]
    assert intervals.reach(points, spans.limit(0), ["k"], "at", "s", "e", "v").isEmpty()


@pytest.fixture(scope="module")
def random_solids(spark):
    """Dense, sparse, full and edge-touching solids with their grids."""
    rng = np.random.default_rng(7)
    inside, grid = set(), {}
    for s, (n, share) in enumerate([((5, 6, 7), 0.9), ((6, 5, 9), 0.3), ((4, 4, 4), 1.0), ((3, 8, 5), 0.7), ((1, 3, 4), 0.8)]):
        grid[s] = n
        inside |= {(s, *map(int, v)) for v in np.argwhere(rng.random(n) < share)}
    voxels = spark.createDataFrame(sorted(inside), "structure_id int, i int, j int, k int").repartition(4)
    return inside, grid, voxels, spark.createDataFrame([(s, *n) for s, n in grid.items()], "structure_id int, nx int, ny int, nz int")


def test_runs_hold_the_voxels(random_solids):
    inside, _, voxels, _ = random_solids
    runs = solids.as_runs(voxels)
    assert set(map(tuple, solids.voxels(runs).collect())) == inside
    ends = [(s, i, j, k) for s, i, j, k in inside if (s, i, j, k - 1) not in inside]
    assert rows(runs, "structure_id", "i", "j", "lo") == sorted(ends, key=str)  # touching runs are one


def test_boundary_by_runs(random_solids):
    inside, grid, voxels, sizes = random_solids
    want = set()
    for s, *v in inside:
        around = [tuple(a + b for a, b in zip(v, o, strict=True)) for o in product((-1, 0, 1), repeat=3)]
        if any(all(0 <= a < n for a, n in zip(w, grid[s], strict=True)) and (s, *w) not in inside for w in around):
            want.add((s, *v))
    got = solids.voxels(solids.boundary(solids.as_runs(voxels), sizes)).collect()
    assert want and len(got) == len(want) and set(map(tuple, got)) == want


def test_mixed_cells_by_runs(random_solids):
    inside, grid, voxels, sizes = random_solids
    want = []
    for s, n in grid.items():
        for i, j, k in product(*[range(m - 1) for m in n]):
            mask = sum(1 << (a + 2 * b + 4 * c) for a, b, c in product((0, 1), repeat=3) if (s, i + a, j + b, k + c) in inside)
            if mask not in (0, 255):
                want.append((s, i, j, k, mask))
    assert rows(solids.mixed_cells(solids.as_runs(voxels), sizes)) == sorted(want, key=str)


@pytest.mark.parametrize("kind", ["vdw", "sas"])
def test_owners_of_voxels_are_the_nearest_atoms(spark, sf_dir, kind):
    atoms = surface.surface_input(scene(spark, sf_dir).atoms.filter("structure_id <= 2"))
    grid = surface.grids(atoms, kind, voxel=1.0)
    best = {}
    for r in surface.shared_radii(atoms, grid, kind).collect():
        w = int(r.ball)
        for a, b, c in product(range(-w, w + 1), repeat=3):
            i, j, k, d2 = r.ci + a, r.cj + b, r.ck + c, a * a + b * b + c * c
            if d2 <= r.ball * r.ball and 0 <= i < r.nx and 0 <= j < r.ny and 0 <= k < r.nz:
                key = (r.structure_id, i, j, k)
                best[key] = min(best.get(key, (1 << 60, 0)), (d2, r.atom_idx))
    got = surface.fill(atoms, grid, kind)
    assert best and rows(got, "structure_id", "i", "j", "k", "d2", "atom_idx") == sorted(((*key, *v) for key, v in best.items()), key=str)
