"""What steps of parsing and bonds must not do at size: move rows twice, sort for summaries, join bonds with atoms."""

from __future__ import annotations

import os
import time

from pyspark.sql import functions as F
from strandloom.functions.fields import number, numbers
from strandloom.operators import parsing, scan
from strandloom.sources.store import shared_folder


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_move_their_rows_once(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("n"))
    got = plan(scan.number(df, ["k"], "n", "place", block=8))
    assert "Join" not in got and got.count("Exchange hashpartitioning") == 3  # two of summaries, one of rows


def test_models_are_summed_up_without_a_sort_of_lines(spark):
    lines = spark.createDataFrame([("s", 1, "MODEL"), ("s", 2, "MODEL        7"), ("s", 3, "ENDMDL")], "structure_id string, line_no long, line string")
    assert "SortAggregate" not in plan(parsing.with_model(lines))
    text = [(1, "MODEL "), (2, "ATOM  1"), (3, "ENDMDL"), (4, "ATOM  2"), (5, "MODEL        7"), (6, "ATOM  3"), (7, "MODEL       -2"), (8, "ATOM  4")]
    lines = spark.createDataFrame([("s", n, t) for n, t in text], "structure_id string, line_no long, line string")
    got = parsing.with_model(lines).orderBy("line_no").collect()
    assert [r.model for r in got] == [1, 1, None, None, 7, 7, -2, -2] and {r.selected for r in got} == {1}
    assert [r.accepted for r in got] == [True, True, False, False, False, False, False, False]


def test_numbers_of_many_fields(spark):
    forms = ["12.5", " -3e2 ", "0x1F", "0X1f", "0b101", "0B2", "0o10", "0O78", "abc", "Infinity", "", "+.5", "1.", ".", "1d", "1e999", "-1e999", "00", "0x", "-0x1F", None]
    want = [12.5, -300.0, 31.0, 31.0, 5.0, None, 8.0, None, None, None, None, 0.5, 1.0, None, None, None, None, 0.0, None, None, None]
    df = spark.createDataFrame([(n, f) for n, f in enumerate(forms)], "n int, t string")
    got = df.select("n", number(F.col("t")).alias("one"), numbers(F.col("t"), F.lit("1"))[0].alias("many")).orderBy("n").collect()
    assert [r.one for r in got] == want and [r.many for r in got] == want


def test_bonds_carry_both_ends(spark, sf_dir):
    """Blocks of one cell and of many, tables of one block and of many, give the bonds of the union of both sources."""
    from strandloom.operators import bonds
    from strandloom.plans.queries import scene

    s = scene(spark, sf_dir)
    both = s.conect.withColumn("source", F.lit(0)).unionByName(bonds.heuristic_bonds(s.atoms).withColumn("source", F.lit(1)))
    both = both.groupBy("structure_id", "a", "b").agg(F.min_by("bond_order", "source").alias("bond_order"))
    for e in "ab":
        both = both.join(s.atoms.select("structure_id", F.col("atom_idx").alias(e), F.col("serial").alias(f"serial_{e}"), F.col("rgb").alias(f"rgb_{e}")), ["structure_id", e])
    columns = ["structure_id", "a", "b", "bond_order", "serial_a", "serial_b", "rgb_a", "rgb_b"]
    want = sorted(map(tuple, both.select(columns).collect()))
    assert len(want) > 1000
    for side, rows in ((16, 1 << 15), (1, 1 << 15), (2, 1)):
        got = bonds._block_bonds(s.conect, s.atoms, ["serial", "rgb"], side, rows)
        assert sorted(map(tuple, got.select(columns).collect())) == want
    assert sorted(map(tuple, bonds.bonds(s.conect, s.atoms, carry=["serial", "rgb"], crowd=6).select(columns).collect())) == want
    assert "Join" not in plan(s.ends("serial").drop("x")).split("MapInArrow")[0]


def test_kept_tables_leave_no_shuffle_files(spark):
    from strandloom.sources.store import drop, kept

    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle")}
    before = files()
    got = kept(spark.range(5000).repartition(4, "id"), "probe")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and got.count() == 5000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    drop(got)


def test_steps_of_kept_tables_are_deleted(spark, sf_dir):
    from strandloom.plans.scene import Scene, derived_lines

    s = Scene(derived_lines(spark, sf_dir))
    root = f"{shared_folder(spark).split(':', 1)[-1]}/strandloom"
    os.makedirs(root, exist_ok=True)
    folders = lambda: set(os.listdir(root))
    before = folders()
    want = s.atoms.count()
    assert want and {f.split("-")[0] for f in folders() - before} == {"records", "raw", "chains", "residues", "atoms"}
    assert s.spans.count() and s.segments.count() and s.points.count() and s.bonds.count() and s.atoms.count() == want
    assert {f.split("-")[0] for f in folders() - before} == {"records", "raw", "chains", "residues", "atoms", "spans", "segments", "points", "conect", "bonds"}
    s.release()
    assert folders() == before


def test_owners_of_vertices_move_no_vertices(spark, sf_dir):
    from strandloom.operators import surface, tiles
    from strandloom.plans.queries import QUERIES, _balls

    got = QUERIES["surface_vertex_owners"](spark, sf_dir)
    above = plan(got).split("FlatMapGroupsInArrow")[0]
    assert "Join" not in above and "Exchange" not in above
    placed, grid = _balls(spark, sf_dir)
    want = surface.placed_vertices(tiles.vertices(placed), grid).select("structure_id", "i", "j", "k", "atom_idx")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_bond_lists_are_moved_as_runs(spark):
    """Ends of runs of bond numbers travel, not the numbers: no list of longs meets the last shuffle."""
    from strandloom.operators import lookup

    pairs = [("s", a, b) for a in range(40) for b in range(a + 1, min(40, a + 1 + a % 5))] + [("t", 0, 1), ("t", 0, 7), ("t", 3, 7)]
    got = lookup.bonds_by(spark.createDataFrame(pairs, "structure_id string, a int, b int"), None, "atom_idx")
    of = {}
    for s in "st":
        for n, (_, a, b) in enumerate(sorted(p for p in pairs if p[0] == s)):
            for e in (a, b):
                of.setdefault((s, e), []).append(n)
    assert {(r.structure_id, r.atom_idx): r.bonds for r in got.collect()} == of
    assert "collect_list(run" in plan(got)


def test_subsets_of_spans_need_no_atoms(spark, sf_dir):
    from strandloom.operators import subset
    from strandloom.plans import queries

    queries._SCENES.pop(next((k for k in queries._SCENES if k == (spark.sparkContext.applicationId, sf_dir)), None), None)
    got = sorted(map(tuple, queries.QUERIES["subset_spans"](spark, sf_dir).collect()))
    s = queries.scene(spark, sf_dir)
    assert "atoms" not in vars(s)
    assert got and got == sorted(map(tuple, subset.subset_spans(s.spans, subset.kept_atoms(s.atoms, queries.keep_two(s))).collect()))


def test_bonds_of_subsets_are_made_from_their_atoms(spark, sf_dir):
    from strandloom.operators import subset
    from strandloom.plans.queries import keep_two, scene

    for policy in ("conect+heuristic", "heuristic-if-missing", "conect-only"):
        s = scene(spark, sf_dir, policy=policy)
        got, want = s.bonds_among(keep_two(s)), subset.subset_chains(s.atoms, s.bonds, keep_two(s))[1]
        rows = sorted(map(tuple, got.collect()))
        assert rows == sorted(map(tuple, want.collect())) and rows and got.dtypes == want.dtypes
    s = scene(spark, sf_dir)
    assert "Join" not in plan(s.bonds_among(keep_two(s))).split("MapInArrow")[0]


def test_selected_bonds_and_atoms_are_moved_once(spark, sf_dir):
    from strandloom.operators import lookup
    from strandloom.plans.queries import QUERIES, scene

    s = scene(spark, sf_dir)
    twice = lookup.atom_selections(s.atoms, s.chains, s.residues)
    assert sorted(map(str, s.selections.select(twice.columns).collect())) == sorted(map(str, twice.collect()))
    assert plan(s.selections).count("Join") == 1
    got = QUERIES["bond_selection"](spark, sf_dir)
    want = lookup.bond_selections(s.bonds, s.selections).select("structure_id", "a", "b", "bond_order", "atom_a.serial", "atom_b.serial", "atom_a.res_name", "atom_b.res_name")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns[4:] == ["serial_a", "serial_b", "res_a", "res_b"]
    assert "Join" not in plan(got).split("MapInArrow")[0]
