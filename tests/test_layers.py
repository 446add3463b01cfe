"""What layers, pairs and intervals over backbone points must not do at size: move rows twice, make what nobody asked for."""

from __future__ import annotations

from pyspark.sql import functions as F
from strandloom.operators import backbone


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_points_are_moved_once(spark):
    rows = [("s", 0, p, 0, 7) for p in range(7)] + [("s", 1, 7, None, None)] + [("s", 2, p, 8, 20) for p in range(8, 20) if p != 11] + [("t", 0, p, 0, 2) for p in range(2)]
    points = spark.createDataFrame([(*r, float(r[2]), 2.0 * r[2], 1.0) for r in rows], "structure_id string, segment int, point int, segment_start int, segment_end int, x double, y double, z double")
    known = points.filter("segment_start is not null")
    after = known.select("structure_id", "segment", (F.col("point") - 1).alias("point"), *[F.col(c).alias(f"next_{c}") for c in ("point", "x", "y", "z")])
    want = known.select("structure_id", "segment", "point", "x", "y", "z").join(after, ["structure_id", "segment", "point"])
    for block in (1, 4, None):
        got = backbone.backbone_pairs(points, *([block] if block else []))
        assert "Join" not in plan(got) and plan(got).count("Exchange") == 1
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == want.columns


def test_layers_make_bonds_with_their_ends(spark, sf_dir):
    from strandloom.operators import geometry
    from strandloom.plans import more_queries, queries  # noqa: F401  (registers its queries)
    from strandloom.plans.queries import QUERIES

    queries._SCENES.pop(next((k for k in queries._SCENES if k == (spark.sparkContext.applicationId, sf_dir)), None), None)
    got = QUERIES["scene_layers"](spark, sf_dir)
    s = queries.scene(spark, sf_dir)
    assert "spans" not in vars(s) and "bonds" not in vars(s)  # no layer asked for ribbons, and lines hold their bonds
    assert "Join" not in plan(got).split("MapInArrow")[0]
    assert {r.layer: r.n for r in got.collect()} == {"atoms": s.atoms.count(), "lines": 2 * s.bonds.count(), "backbone": backbone.backbone_pairs(s.points).count()}
    both = [geometry.scene(s.atoms, b, s.points, None, ("lines", "bonds")) for b in (s.bonds, s.ends(*geometry.ENDS))]
    for k in ("lines", "bonds"):
        one, two = (sorted(map(str, b[k].drop("pa", "pb").select(*both[0][k].columns).collect())) for b in both)
        assert one == two


def test_short_spans_take_few_levels(spark):
    from strandloom.operators import intervals

    points = spark.createDataFrame([("k", n) for n in range(-40, 700)], "k string, at int")
    spans = [("k", -7, 5), ("k", 0, 255), ("k", 16, 31), ("k", 9, 8), ("k", 3, 3)]
    for more, levels in (([], 2), ([("k", -30, 600)], 3), ([("k", 0, 90_000)], 4)):
        df = spark.createDataFrame(spans + more, "k string, s int, e int")
        assert intervals.levels_for(df, "s", "e") == levels
        want = sorted((n, a, b) for _, a, b in spans + more for n in range(-40, 700) if a <= n <= b)
        for n in (1, levels):
            assert sorted(map(tuple, intervals.within(points, df, ["k"], "at", "s", "e", n).select("at", "s", "e").collect())) == want
    assert intervals.levels_for(spark.createDataFrame([], "k string, s int, e int"), "s", "e") == 1


def test_events_are_stored_once_unless_a_ter_lacks_its_chain(spark, monkeypatch):
    from strandloom.plans.scene import Scene

    atom = "ATOM  {:>5}  CA  GLY {}{:>4}       1.000   2.000   3.000  1.00  0.00           C"
    text = [atom.format(1, "A", 1), atom.format(2, "A", 2), "TER                  A", atom.format(3, "B", 1), atom.format(4, "B", 5), "TER                  B", "TER                  C"]
    stored = []
    keep = backbone.kept
    monkeypatch.setattr(backbone, "kept", lambda df, label: stored.append(label) or keep(df, label))
    for lines, times in ((text, 1), ([t.replace("TER                  B", "TER   ") for t in text], 2)):
        stored.clear()
        s = Scene(spark.createDataFrame([("s", n, t) for n, t in enumerate(lines)], "structure_id string, line_no long, line string"))
        assert sorted(map(tuple, s.segments.drop("structure_id").collect())) == [(0, 0, 1, 2), (1, 2, 3, 5)]
        assert stored.count("events") == times
        s.release()
