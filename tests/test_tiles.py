"""Solids by tiles against runs, joins and the wave over whole grids, and what they shuffle."""

from __future__ import annotations

import pytest
from strandloom.operators import solids, surface, tiles
from strandloom.plans import more_queries  # noqa: F401
from strandloom.plans.queries import QUERIES, scene


def rows(df, *columns):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*(columns or df.columns)).collect())


def shuffled_rows(spark, df):
    """Rows that the stages of one run of ``df`` write for later ones."""

    def total():
        none, no = spark._jvm.java.util.ArrayList(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, no, none)
        return sum(stages.apply(n).shuffleWriteRecords() for n in range(stages.size()))

    before = total()
    df.write.format("noop").mode("overwrite").save()
    return total() - before


@pytest.fixture(scope="module")
def balls(spark, sf_dir):
    atoms = surface.surface_input(scene(spark, sf_dir).atoms.filter("structure_id <= 2 and atom_idx % 3 = 0"))
    return atoms, surface.grids(atoms, "ses", voxel=1.0)


@pytest.mark.parametrize("tile", [5, 64])
def test_tiles_are_seamless(balls, tile):
    atoms, grid = balls
    placed = surface.shared_radii(atoms, grid, "sas")
    chords = solids.chords(placed)
    runs = solids.union(chords)
    want = rows(solids.owners(solids.voxels(runs), chords))
    assert want and rows(tiles.voxels(placed, tile=tile), "structure_id", "i", "j", "k", "atom_idx", "d2") == want
    assert rows(tiles.voxels(placed, "boundary", tile), "structure_id", "i", "j", "k") == rows(solids.voxels(solids.boundary(runs, grid)))
    assert rows(tiles.runs(placed, tile)) == rows(runs, "structure_id", "i", "j", "lo", "hi")
    net = surface.net_vertices(runs, grid)
    assert rows(tiles.vertices(placed, tile), "structure_id", "i", "j", "k", "x", "y", "z") == rows(net)
    quads = surface.net_quads(net)
    flat = ["structure_id", "plane", "qi", "qj", "qk", "cast(v as string)"]
    assert rows(tiles.quads(placed, tile).selectExpr(*flat)) == rows(quads.selectExpr(*flat))
    face = ["structure_id", "plane", "qi", "qj", "qk", "half", "cast(f as string) f", "nx", "ny", "nz"]
    assert rows(tiles.triangles(placed, tile).selectExpr(*face)) == rows(surface.triangles(quads, solids.voxels(runs)).selectExpr(*face))


@pytest.mark.parametrize("tile", [6, 64])
def test_carving_by_tiles_is_the_wave(balls, tile):
    atoms, grid = balls
    placed = surface.shared_radii(atoms, grid, "ses")
    runs = solids.union(solids.chords(placed))
    solid = surface.ses_solid(solids.voxels(runs), surface.boundary(runs, grid), grid)
    placed = surface.shared_radii(atoms, surface.carve_limits(grid), "ses")
    want = rows(solid, "structure_id", "i", "j", "k")
    assert want and rows(tiles.voxels(placed, tile=tile), "structure_id", "i", "j", "k") == want
    net = surface.net_vertices(solid, grid)
    assert rows(tiles.vertices(placed, tile), "structure_id", "i", "j", "k", "x", "y", "z") == rows(net)
    owned = surface.vertex_owners(net, surface.fill(atoms, grid, "ses"), grid, "ses")
    assert rows(surface.placed_vertices(tiles.vertices(placed, tile), grid, "ses")) == rows(owned)


def test_finer_grids_take_the_wave(balls):
    atoms = balls[0].filter("structure_id = 1 and atom_idx < 60")
    grid = surface.grids(atoms, "ses")
    assert surface.carve_limits(grid).filter("limit <= 4").isEmpty()
    voxels = surface.fill(atoms, grid, "ses")
    want = rows(surface.ses_solid(voxels, surface.boundary(voxels, grid), grid))
    assert want and rows(surface.ses_voxels(atoms, grid)) == want


@pytest.mark.parametrize("name", ["sas_fill_owner", "voxel_boundary", "surface_net_vertices", "surface_net_quads", "surface_vertex_owners", "ses_solid_voxels", "ses_surface", "vdw_surface", "solid_runs"])
def test_only_balls_are_shuffled(spark, sf_dir, name):
    """A structure's balls are far fewer than the voxels of its solid or the vertices of its surface."""
    atoms = scene(spark, sf_dir).atoms.count()
    assert shuffled_rows(spark, QUERIES[name](spark, sf_dir)) < 4 * atoms


@pytest.mark.parametrize("name", ["hovered_ids", "ribbon_flat", "ribbon_tube"])
def test_kept_tables_are_not_broadcast(spark, sf_dir, name):
    """Tables that grow with the input do not pass through the driver, however small their files are."""
    df = QUERIES[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
