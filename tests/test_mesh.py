import numpy as np
import pandas as pd
import pytest

from meshlens import queries as mesh
from meshlens.operators import faces, graph, segments
from meshlens.operators.tritri import intersect
from meshlens.plans import scoring


def grid(n, z=lambda x, y: 0.0, drop=(), first=0):
    v = [(1, first + i * (n + 1) + j, float(j), float(i), float(z(j, i))) for i in range(n + 1) for j in range(n + 1)]
    f, k = [], 0
    for i in range(n):
        for j in range(n):
            a = first + i * (n + 1) + j
            for t in ((a, a + 1, a + n + 1), (a + 1, a + n + 2, a + n + 1)):
                f.append((1, k, *t))
                k += 1
    return pd.DataFrame(v, columns=["segment_id", "vertex_id", "x", "y", "z"]), pd.DataFrame(f, columns=["segment_id", "face_id", "v0", "v1", "v2"])


def sheet_switch():
    step = lambda i: 1.5 if i == 40 else 3.5 if i == 41 else 5.0 if i > 41 else 0.0
    return grid(80, lambda x, y: 2 * np.sin(np.pi * x / 80) + step(y))


def crossing():
    a, b = grid(20), grid(20, lambda x, y: (y - 10) / 2, first=441)
    b[1]["face_id"] += 800
    return tuple(pd.concat(x, ignore_index=True) for x in zip(a, b))


def test_flat_plane_goldens():
    m = segments.Segment(*grid(50))
    assert m.triangle_quality()[0] == pytest.approx(1.0)
    assert m.topology()[0] == pytest.approx(0.992)
    assert m.normal_consistency()[0] == 1.0 and m.normal_consistency()[1]["n_pairs"] == 7400
    assert m.sheet_switching()[0] == 1.0
    assert m.noise()[0] == pytest.approx(0.980777, abs=1e-6)
    assert m.self_intersections()[0] == 1.0


def test_sheet_switch_goldens():
    m = segments.Segment(*sheet_switch())
    assert m.triangle_quality()[0] == pytest.approx(0.964493, abs=1e-6)
    assert m.topology()[0] == pytest.approx(0.995)
    assert m.normal_consistency()[0] == pytest.approx(0.991597, abs=1e-6)
    assert m.sheet_switching()[0] == pytest.approx(0.972223, abs=1e-6)
    assert m.noise()[0] == pytest.approx(0.980948, abs=1e-6)


def test_crossing_sheets():
    m = segments.Segment(*crossing())
    assert m.topology()[0] == pytest.approx(0.83)
    score, details, _ = m.self_intersections()
    assert score == pytest.approx(0.0) and details["fraction"] == pytest.approx(0.05)


def test_non_manifold():
    v = pd.DataFrame([(1, i, *p) for i, p in enumerate([(0, 0, 0), (1, 0, 0), (0.5, 1, 0), (0.5, -1, 0), (0.5, 0.5, 0)])], columns=["segment_id", "vertex_id", "x", "y", "z"])
    f = pd.DataFrame([(1, 0, 0, 1, 2), (1, 1, 0, 3, 1), (1, 2, 0, 4, 1)], columns=["segment_id", "face_id", "v0", "v1", "v2"])
    m = segments.Segment(v, f)
    assert m.topology()[0] == pytest.approx(0.5)
    assert m.normal_consistency()[0] == pytest.approx(1 / 3)


def test_cylinder_winding():
    rows, tri = [], []
    for i in range(41):
        for j in range(61):
            t = 1.5 * j / 60 + (np.radians(25) if i >= 20 else 0)
            rows.append((1, i * 61 + j, 100 * np.cos(t), 5.0 * i, 100 * np.sin(t)))
    for i in range(40):
        for j in range(60):
            a = i * 61 + j
            tri += [(1, len(tri), a, a + 1, a + 61), (1, len(tri) + 1, a + 1, a + 62, a + 61)]
    m = segments.Segment(pd.DataFrame(rows, columns=["segment_id", "vertex_id", "x", "y", "z"]), pd.DataFrame(tri, columns=["segment_id", "face_id", "v0", "v1", "v2"]))
    score, details, _ = m.winding(np.array([[0.0, 0.0, 0.0]]))
    assert score == pytest.approx(0.668493, abs=1e-6) and details["n_flagged"] == 121


def test_triangles_cross_and_touch():
    a = np.array([[[0, 0, 0], [2, 0, 0], [0, 2, 0]]] * 3, float)
    b = np.array([[[0.5, 0.5, -1], [0.5, 0.5, 1], [3, 3, 1]], [[0, 0, 1], [2, 0, 1], [0, 2, 1]], [[0.2, 0.2, 0], [1, 0.2, 0], [0.2, 1, 0]]], float)
    assert intersect(a, b).tolist() == [True, False, True]


def test_peaks():
    y = np.array([0, 1, 0, 2, 2, 2, 0, 0, 0, 0, 0, 0, 0, 3, 0, 5], float)
    assert segments.find_peaks(y, 1, 1).tolist() == [1, 4, 13]
    assert segments.find_peaks(y, 1, 8).tolist() == [4, 13]


def test_joins_agree_with_segment_step(spark, sf_dir):
    v, f = mesh.meshes(spark, sf_dir)
    g = faces.face_geometry(v, f)
    native = {r["segment_id"]: r["score"] for r in mesh._quality(g).collect()}
    measured = {r["segment_id"]: r["score"] for r in segments.measure(v, f, metrics=("triangle_quality",)).collect()}
    assert native.keys() == measured.keys() and all(abs(native[s] - measured[s]) < 1e-6 for s in native)
    pairs = graph.face_pairs(f)
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    one = f.filter("segment_id = 3")
    reach = graph.ring_pairs(pairs.filter("segment_id = 3"), one).count()
    m = segments.Segment(v.filter("segment_id = 3").toPandas(), one.toPandas())
    assert reach == segments.ring_sums(np.ones((len(m.tri), 1)), m.i, m.j, 8).sum()


def test_tiers_and_suppression(spark):
    assert scoring.tier(True, True) == "tier3" and scoring.tier(False, True) == "tier1"
    for table in scoring.TIER_WEIGHTS.values():
        assert sum(table.values()) == pytest.approx(1.0)
    rows = spark.createDataFrame([(1, "noise", 0.5, {"n_sampled": 10.0}, None, None), (1, "topology", 1.0, {"n_sampled": 90.0}, None, None)], segments.RESULT)
    got = {r["metric"]: r["weight"] for r in scoring.suppress(scoring.weigh(rows)).collect()}
    assert got == {"noise": 0.0, "topology": 1.0}


def test_ranking_keeps_failed_segments(spark):
    rows = spark.createDataFrame([(1, "noise", 0.5, {}, None, None)], segments.RESULT)
    got = scoring.ranking(scoring.weigh(rows), spark.createDataFrame([(1,), (2,)], "segment_id long")).collect()
    assert [(r["segment_id"], r["grade"]) for r in got] == [(2, "F"), (1, "D")]


def test_entry_and_guard(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rings_and_neighbours_equal_brute_force():
    r = np.random.default_rng(3)
    for n, k in ((1, 3), (7, 20), (60, 5), (400, 20)):
        points = np.round(r.normal(size=(n, 3)) * [1, 6, 0.2], 1)  # many ties
        d = np.round(sum((points[:, None, c] - points[None, :, c]) ** 2 for c in range(3)), 9)
        assert (segments.nearest(points, k)[0] == np.argsort(d, axis=1, kind="stable")[:, : min(k, n)]).all()
    n, a, b = 300, r.integers(0, 300, 500), r.integers(0, 300, 500)
    values, near = r.normal(size=(n, 3)), np.eye(n, dtype=bool)
    near[a, b] = near[b, a] = True
    reach = np.eye(n, dtype=bool)
    for _ in range(4):
        reach = (reach.astype(int) @ near.astype(int)) > 0
    assert np.allclose(segments.ring_sums(values, a, b, 4, 64), reach.astype(float) @ values)


def test_failed_segments_are_rows(spark):
    good = [(1, i, float(i % 2), float(i // 2), 0.0) for i in range(4)]
    v = spark.createDataFrame(good + [(2, i, 0.0, 0.0, 0.0) for i in range(3)], "segment_id long, vertex_id long, x double, y double, z double")
    f = spark.createDataFrame([(1, 0, 0, 1, 2), (1, 1, 1, 3, 2), (2, 0, 0, 1, 99)], "segment_id long, face_id long, v0 long, v1 long, v2 long")
    rows = {r["segment_id"]: r for r in scoring.ranking(scoring.weigh(segments.measure(v, f))).collect()}
    assert rows[1]["error"] is None and rows[1]["aggregate_score"] > 0 and rows[2]["grade"] == "F" and "IndexError" in rows[2]["error"]


def test_metric_registry(spark):
    segments.register("flatness", lambda m: (1.0 - float(np.ptp(m.xyz[:, 2])), {}, None))
    v = spark.createDataFrame([(1, i, float(i % 2), float(i // 2), 0.25 * i) for i in range(4)], "segment_id long, vertex_id long, x double, y double, z double")
    f = spark.createDataFrame([(1, 0, 0, 1, 2), (1, 1, 1, 3, 2)], "segment_id long, face_id long, v0 long, v1 long, v2 long")
    try:
        got = {r["metric"]: r["score"] for r in segments.measure(v, f, ("flatness", "topology")).collect()}
    finally:
        del segments.METRICS["flatness"]
    assert got["flatness"] == 0.25 and set(got) == {"flatness", "topology"}


def test_worst_metric_ties_go_by_report_order(spark):
    rows = spark.createDataFrame([(1, "noise", 0.5, {}, None, None), (1, "topology", 0.5, {}, None, None), (1, "layer_distance", 0.0, {}, None, None)], segments.RESULT)
    assert scoring.ranking(scoring.weigh(rows)).first()["worst_metric"] == "topology"


def test_pinched_vertices(spark, sf_dir):
    """Fans counted where a segment's faces meet equal the joins', and the lines are shuffled once."""
    from meshlens import queries
    from meshlens.operators import graph, segments
    from pyspark.sql import functions as F

    odd = [(1, 0, 0, 1, 2), (1, 1, 0, 3, 4), (1, 2, 0, 2, 3), (1, 3, 0, 5, 6), (2, 0, 5, 5, 6), (2, 1, 6, 5, 7), (2, 2, 9, 9, 9), (3, 0, 0, 1, 2), (3, 1, 0, 1, 3), (3, 2, 1, 0, 4)]
    drawn = spark.createDataFrame(odd, "segment_id long, face_id long, v0 long, v1 long, v2 long")
    for f in (drawn, queries.meshes(spark, sf_dir)[1]):
        want = graph.vertex_fans(f).groupBy("segment_id").agg(F.count_if(F.col("fans") > 1), F.count("*"))
        assert sorted(map(tuple, segments.pinched(f).collect())) == sorted(map(tuple, want.collect()))
    assert dict((r["segment_id"], r["n_pinched"]) for r in segments.pinched(drawn).collect()) == {1: 1, 2: 0, 3: 0}
    plan = queries.QUERIES["vertex_manifold"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
