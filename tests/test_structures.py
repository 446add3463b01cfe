"""A small structure by hand: what each operator finds in it, and the invariants that any structure keeps."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from strandloom.operators import catalog, lookup, subset, surface
from strandloom.plans.scene import Scene
from strandloom.sources.structures import lines, read_structures
from strandloom.streaming.landing import ingest


def atom(serial, name, alt, res, chain, seq, x, y, z, occ="1.00", element="", record="ATOM"):
    return f"{record:<6}{serial:>5} {name:<4}{alt:1}{res:>3} {chain:1}{seq:>4}    {x:8.3f}{y:8.3f}{z:8.3f}{occ:>6}{'0.00':>6}          {element:>2}"


TEXT = "\n".join([
    "HEADER    SMALL", "HELIX    1   1 GLY A    1  ALA A    2", "MODEL        1",
    atom(1, " N  ", "", "GLY", "A", 1, 0, 0, 0, element="N"), atom(2, " CA ", "A", "GLY", "A", 1, 1.45, 0, 0, "0.40", "C"), atom(3, " CA ", "B", "GLY", "A", 1, 1.40, 0.2, 0, "0.60", "C"),
    atom(4, " C  ", "", "GLY", "A", 1, 2.0, 1.4, 0, element="C"), atom(5, " N  ", "", "ALA", "A", 2, 3.3, 1.5, 0, element="N"), atom(6, " CA ", "", "ALA", "A", 2, 4.0, 2.8, 0, element="C"),
    "TER       7      ALA A   2", atom(8, " O  ", "", "HOH", "B", 1, 20, 20, 20, element="O", record="HETATM"), atom(9, "CA  ", "", " CA", "C", 1, -9, 0, 0), "ATOM     10  X   GLY A   3       x.000   0.000   0.000",
    "ENDMDL", "MODEL        2", atom(1, " N  ", "", "GLY", "A", 1, 7, 7, 7, element="N"), "ENDMDL", "CONECT    1    9", "CONECT    9    1", "END",
])


@pytest.fixture(scope="module")
def scene(spark):
    return Scene(lines(spark.createDataFrame([("s", TEXT), ("empty", "END"), ("null", None)], "structure_id string, text string")))


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_atoms(scene):
    found = rows(scene.atoms, "atom_idx", "serial", "element", "chain_idx", "residue_idx")
    assert [f[1] for f in found] == [1, 3, 4, 5, 6, 8, 9]  # the site's other place has more occupancy
    assert [f[2] for f in found] == ["N", "C", "C", "N", "C", "O", "CA"] and [f[0] for f in found] == list(range(7))
    assert [f[3] for f in found] == [0, 0, 0, 0, 0, 1, 2]


def test_models(spark):
    second = Scene(lines(spark.createDataFrame([("s", TEXT)], "structure_id string, text string")), model=2)
    assert rows(second.raw, "serial", "x") == [(1, 7.0)]


def test_bonds(scene):
    assert rows(scene.conect, "a", "b", "bond_order") == [(0, 6, 2)]
    near = [r for r in rows(scene.bonds, "a", "b") if r != (0, 6)]
    assert near == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_bonds_against_all_pairs(scene):
    atoms = scene.atoms.select("atom_idx", "x", "y", "z", "covalent").collect()
    want = sorted(
        (p["atom_idx"], q["atom_idx"]) for p in atoms for q in atoms
        if p["atom_idx"] < q["atom_idx"] and 0.4**2 <= sum((p[c] - q[c]) ** 2 for c in "xyz") <= (p["covalent"] + q["covalent"] + 0.45) ** 2
    )
    from strandloom.operators.bonds import heuristic_bonds

    assert rows(heuristic_bonds(scene.atoms), "a", "b") == want


def test_backbone_and_spans(scene):
    assert rows(scene.points, "segment", "point", "residue_idx")[:2] == [(0, 0, 0), (0, 1, 1)]
    assert rows(scene.spans, "kind", "start_residue", "end_residue") == [("helix", 0, 1)]


def test_warnings(scene):
    assert any("missing coordinates" in w for (w,) in rows(scene.warnings, "warning"))


def test_lookup_and_subset(scene):
    assert [r["members"] for r in lookup.csr(scene.atoms, "chain_idx", "atom_idx").orderBy("chain_idx").collect()] == [[0, 1, 2, 3, 4], [5], [6]]
    atoms, bonds = subset.subset_chains(scene.atoms, scene.bonds, scene.chains.filter("chain_id <> 'B'"))
    assert atoms.count() == 6 and {x for r in rows(bonds, "a", "b") for x in r} <= set(range(6))
    rays = scene.atoms.filter("atom_idx = 5").select("structure_id", F.lit(0).alias("ray"), (F.col("x") - 10).alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"))
    (hit,) = lookup.ray_hits(scene.atoms, rays).collect()
    assert hit["atom_idx"] == 5 and hit["t"] == pytest.approx(10 - 1.52, abs=1e-4)


@pytest.mark.parametrize("kind", ["vdw", "sas", "ses"])
def test_surface_has_faces(scene, kind):
    vertices, faces = surface.surface(scene.atoms, kind)
    assert vertices.count() > 0 and faces.count() > 0


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.pdb").write_text(TEXT.replace("\n", "\r\n"))
    (tmp_path / "in/deep/b.PDB").write_text(TEXT)
    (tmp_path / "in/c.txt").write_text(TEXT)
    found = read_structures(spark, str(tmp_path / "in"))
    assert found.select("structure_id").distinct().count() == 2 and found.filter("line like '%\r'").count() == 0
    assert Scene(found).atoms.groupBy("structure_id").count().select("count").distinct().collect()[0][0] == 7
    seen = []
    (tmp_path / "land").mkdir()
    (tmp_path / "land/x.pdb").write_text(TEXT)
    for _ in range(2):  # nothing is read again after a restart
        ingest(spark, str(tmp_path / "land"), str(tmp_path / "checkpoint"), lambda df, n: seen.append(Scene(df).atoms.count())).awaitTermination()
    assert sum(seen) == 7


def test_catalog(spark):
    ids = catalog.split_ids(spark.createDataFrame([("f", "1abc, 2xyz\n 3def,,1abc"), ("g", None)], "source string, text string"))
    assert rows(ids, "entry_id") == [("1abc",), ("1abc",), ("2xyz",), ("3def",)]
    universe = spark.range(1000).select(F.col("id").cast("string").alias("entry_id"))
    assert catalog.sample(universe, 10).count() == catalog.sample_size(1000, 10) == 100
    assert rows(catalog.sample(universe, 10, seed=1), "entry_id") == rows(catalog.sample(universe, 10, seed=1), "entry_id")
    assert catalog.top_up(universe, universe.limit(990)).count() == 10


def test_downloads_are_repeated_and_resumed(spark):
    from strandloom.operators import catalog

    ids = spark.createDataFrame([(0, " 1abc "), (1, ""), (2, "2xyz"), (3, "3gone")], "ord long, entry_id string")
    plan = catalog.download_plan(ids, "http://x/", "out", "PDB")
    assert rows(plan, "url") == [("http://x/1abc.pdb",), ("http://x/2xyz.pdb",), ("http://x/3gone.pdb",)]
    done = spark.createDataFrame([("out/2xyz.pdb", 5), ("out/1abc.pdb", 0)], "target string, size_bytes long")
    answers = lambda url: (404, b"", None) if "gone" in url else (200, b"text", None)
    events = catalog.download(plan, answers, lambda target, body: None, done)
    assert rows(events, "ord", "event", "attempts") == sorted([(0, "download_ok", 1), (2, "download_skip", None), (3, "download_error", 1)])
    assert [catalog.retry_delay(0, s, r) for s, r in ((429, "99"), (429, "soon"), (503, None), (404, None), (None, None))] == [15.0, 0.5, 0.5, None, 0.5]
    assert [catalog.parallel_tasks(x, 9) for x in ("auto", "3", "0", None, "-1")] == [4, 3, 4, 4, 4]


def test_enumeration_stops_at_an_empty_page(spark):
    import json

    from strandloom.operators import catalog

    body = lambda start, n: json.dumps({"result_set": [] if start == 20 else [{"identifier": f"e{k}"} for k in range(start, start + n)]})
    assert [r["entry_id"] for r in catalog.enumerate_entries(spark, 35, body, 10).orderBy("page", "ord").collect()] == [f"e{k}" for k in range(20)]
    assert catalog.enumerate_entries(spark, 15, body, 10).count() == 15


def test_selection_without_sorting(spark, monkeypatch):
    """Every size, with bins cut to the last digit, repeated ids and none."""
    import hashlib

    from strandloom.operators import catalog

    ids = [str(n) for n in range(400)] + ["7"] * 300 + [None, ""]
    df = spark.createDataFrame([(i,) for i in ids], "entry_id string").repartition(4).cache()
    order = sorted(ids, key=lambda i: (hashlib.md5(f"5:{i or ''}".encode()).hexdigest(), i is not None, i or ""))
    for edge in (2, 50, 4096):
        monkeypatch.setattr(catalog, "EDGE_ROWS", edge)
        for k in (0, 1, 3, 150, 401, 702, 5000):
            got = [r[0] for r in catalog.first_in_order(df, k, seed=5).collect()]
            assert sorted(map(str, got)) == sorted(map(str, order[:k])), (edge, k)


def test_fetching_exactly_tops_up_and_ends(spark):
    from strandloom.operators import catalog
    from strandloom.sources.store import kept

    universe = spark.createDataFrame([(str(n),) for n in range(100)] * 2, "entry_id string")
    event = F.when(F.col("entry_id").cast("int") % 3 != 0, "download_ok").otherwise("download_error")
    attempt = lambda ids: kept(ids.select(F.col("entry_id").alias("id"), event.alias("event")), "attempt")
    events = catalog.fetch_exactly(universe, 40, attempt)
    assert catalog.success_counts(events).first()["ok"] == 40 and events.select("id").distinct().count() == events.count()
    assert catalog.success_counts(catalog.fetch_exactly(universe, 90, attempt)).first().asDict() == {"ok": 66, "failed": 34}
