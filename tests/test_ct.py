import json
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshlens.operators import ct
from meshlens.sources.volumes import formula_chunks, read_zarr


def test_normals_of_sheets():
    flat, tilted = np.zeros((32, 32, 32)), np.zeros((32, 32, 32))
    flat[14:18] = 1
    for i in range(32):
        z = int(16 + (i - 16) / 2)
        tilted[max(0, z - 2) : z + 2, i] = 1
    n, a = ct.centre_normals(np.stack((flat, tilted, np.zeros((32, 32, 32)))))
    assert abs(n[0, 0]) > 0.99 and a[0] > 0.5
    assert a[1] > 0.5 and abs(n[1, 0]) > 0.3 and abs(n[1, 1]) > 0.3
    assert a[2] < 0.1


def test_fiber_directions():
    rng = np.random.default_rng(42)
    wave = 50 * np.sin(np.arange(32) * np.pi / 4)
    x = rng.normal(100, 1, (32, 32, 32)) + wave[:, None, None] + wave[None, :, None]
    kind, along, sure = ct.fiber_directions(np.stack((x, x.transpose(2, 1, 0), np.ones((32, 32, 32)))))
    assert kind.tolist() == [1, 2, 0]
    assert abs(along[0, 0]) > 0.9 and abs(along[1, 2]) > 0.9 and (sure[:2] > 1).all() and sure[2] == 0


def test_cubes_and_values_across_chunks(spark):
    volume = lambda iz, iy, ix: iz * 10000.0 + iy * 100.0 + ix
    chunks = formula_chunks(spark, volume, (20, 20, 20), 8)
    spots = [(0, 8, 8, 8), (1, 1, 1, 1), (2, 19, 19, 19), (3, 100, 0, 0), (4, 10, 3, 17)]
    samples = spark.createDataFrame(spots, "sample_id long, iz int, iy int, ix int")
    full = np.pad(volume(*np.indices((20, 20, 20))), 4)
    got = {r["sample_id"]: np.frombuffer(r["body"], "<f4").reshape(8, 8, 8) for r in ct.cubes(samples, chunks, 4, 8).collect()}
    for k, *i in spots:
        want = full[tuple(slice(c, c + 8) for c in i)] if max(i) < 20 else np.zeros((8, 8, 8))
        assert (got[k] == want).all()
    for parts in (1, 3):
        values = {r["sample_id"]: r["value"] for r in ct.chunk_values(samples, chunks, 8, parts).collect()}
        assert values == {k: volume(*i) if max(i) < 20 else 0.0 for k, *i in spots}


@pytest.mark.parametrize("codec,sep", [(None, "."), ("zlib", "/")])
def test_zarr(spark, tmp_path, codec, sep):
    data = np.arange(5 * 6 * 7, dtype="<u2").reshape(5, 6, 7)
    root = tmp_path / "v.zarr" / "1"
    root.mkdir(parents=True)
    (tmp_path / "v.zarr" / ".zgroup").write_text('{"zarr_format": 2}')
    head = {"zarr_format": 2, "shape": [5, 6, 7], "chunks": [4, 4, 4], "dtype": "<u2", "order": "C", "fill_value": 0, "filters": None, "compressor": codec and {"id": codec}, "dimension_separator": sep}
    (root / ".zarray").write_text(json.dumps(head))
    wide = np.pad(data, ((0, 3), (0, 2), (0, 1)))
    for z in range(2):
        for y in range(2):
            for x in range(2):
                body = wide[4 * z : 4 * z + 4, 4 * y : 4 * y + 4, 4 * x : 4 * x + 4].tobytes()
                at = root / sep.join(map(str, (z, y, x)))
                at.parent.mkdir(parents=True, exist_ok=True)
                at.write_bytes(zlib.compress(body) if codec else body)
    chunks, info = read_zarr(spark, str(tmp_path / "v.zarr"), 1)
    assert info == {"shape": (5, 6, 7), "chunks": (4, 4, 4), "scale_factor": 2.0}
    out = np.zeros((5, 6, 7))
    for r in chunks.collect():
        z, y, x = (4 * r[c] for c in ("cz", "cy", "cx"))
        out[z : z + r["shape"][0], y : y + r["shape"][1], x : x + r["shape"][2]] = np.frombuffer(r["body"], "<f4").reshape(r["shape"])
    assert (out == data).all()


def strip(spark, n=40):
    rows = [(1, i, float(50 + i % 7), float(50 + i // 7), 50.0, 0.0, 0.0, 1.0) for i in range(n)]
    v = spark.createDataFrame(rows, "segment_id long, vertex_id long, x double, y double, z double, nx double, ny double, nz double")
    f = spark.createDataFrame([(1, i, i, i + 1, i + 2) for i in range(n - 2)], "segment_id long, face_id long, v0 long, v1 long, v2 long")
    s = v.selectExpr("vertex_id as sample_id", "*", "cast(z as int) iz", "cast(y as int) iy", "cast(x as int) ix")
    return spark.createDataFrame([(1,), (2,)], "segment_id long"), f, s


def test_layers(spark):
    seg, f, s = strip(spark)
    chunks = formula_chunks(spark, lambda z, y, x: np.where(z % 20 < 3, 200.0, 50.0), (100, 100, 100), 32)
    rows = {r["segment_id"]: r for r in ct.layer_distance(seg, f, s, chunks, 32, reach=45).collect()}
    assert rows[1]["score"] > 0.8 and rows[1]["details"]["mean_distance_voxels"] == pytest.approx(20)
    assert rows[2]["score"] == 0.0 and rows[2]["details"] == {"n_sampled": 0.0}
    flat = formula_chunks(spark, lambda z, y, x: np.full(z.shape, 100.0), (100, 100, 100), 32)
    assert ct.layer_distance(seg, f, s, flat, 32, reach=45).filter("segment_id = 1").first()["score"] == 0.0


def test_ct_switching(spark):
    seg, f, s = strip(spark)
    along = formula_chunks(spark, lambda z, y, x: np.where(np.abs(z - 50) < 3, 200.0, 0.0), (100, 100, 100), 32)
    across = formula_chunks(spark, lambda z, y, x: np.where(x % 9 < 3, 200.0, 0.0), (100, 100, 100), 32)
    good = {r["segment_id"]: r for r in ct.ct_sheet_switching(seg, f, s, along, 32, half=8).collect()}
    assert good[1]["score"] > 0.95 and good[1]["problem_faces"] is None and good[2]["score"] == 1.0
    bad = ct.ct_sheet_switching(seg, f, s, across, 32, half=8).filter("segment_id = 1").first()
    assert bad["score"] < 0.3 and len(bad["problem_faces"]) > 20
    table = ct.sweep(s, along, 32, halves=(4, 8), sigmas=(2.0,), floors=(0.0, 0.5)).collect()
    assert len(table) == 4 and all(r["median_angle"] < 20 for r in table)
    told = ct.alignment(s, (100, 100, 100), s.withColumn("value", F.lit(80.0)), s.withColumn("angle", F.lit(10.0))).first()
    assert told["verdict"] == "good" and told["over_50"] == 1.0 and told["over_100"] == 0.0


def test_fiber_metric(spark):
    seg, f, s = strip(spark)
    even = s.selectExpr("sample_id", "1 fiber_class", "1D dx", "0D dy", "0D dz", "1D confidence")
    mixed = s.selectExpr("sample_id", "1 + cast(sample_id % 2 as int) fiber_class", "cast(sample_id % 2 = 0 as double) dx", "0D dy", "cast(sample_id % 2 as double) dz", "1D confidence")
    got = {r["segment_id"]: r["score"] for r in ct.fiber_coherence(seg, f, s, even).collect()}
    assert got == {1: 1.0, 2: 0.0}  # segment 2 has no faces
    worst = ct.fiber_coherence(seg, f, s, mixed).filter("segment_id = 1").first()
    assert worst["score"] < 0.5 and len(worst["problem_faces"]) > 0
    classes = spark.createDataFrame(pd.DataFrame({"iz": [50], "iy": [50], "ix": [50], "fiber_class": [2]}))
    looked = {r["sample_id"]: r["fiber_class"] for r in ct.predicted_fibers(s, classes).collect()}
    assert looked[0] == 2 and looked[1] == 0


def test_texture(spark):
    v = spark.range(100).selectExpr("1L segment_id", "id vertex_id", "cast(id as double) value")
    shade = {r["vertex_id"]: r["shade"] for r in ct.texture(v).collect()}
    assert shade[0] == 0.0 and shade[99] == 1.0 and 0.4 < shade[50] < 0.6
    assert ct.texture(v.filter("vertex_id < 5")).first()["shade"] is None


def test_patches_and_inference(spark):
    """Patches are clipped and scaled, scored in batches by any function, and blended over the mask."""
    from pyspark.sql import functions as F

    from meshlens.operators import volume

    fragments = spark.createDataFrame([(1, 5, 5)], "fragment_id long, height int, width int")
    tiles = volume.tile_origins(fragments, 4, 2)
    px = spark.createDataFrame([(1, k, y, x, 100.0 * k + 300.0 * (y == 0)) for k in range(2) for y in range(5) for x in range(5)], "fragment_id long, layer int, y int, x int, value double")
    patches = volume.tile_patches(tiles, px, 4)
    got = patches.first()
    assert got["layers"] == 2 and len(got["pixels"]) == 32 and got["pixels"][0] == 1.0 and got["pixels"][16 + 4] == 0.5
    scored = volume.infer(patches, lambda p: 4 * p.mean(axis=1) - 2, batch=3)
    flat = scored.select("fragment_id", "y0", "x0", F.posexplode("values").alias("at", "value")).selectExpr("fragment_id", "cast(at div 4 as int) as ty", "cast(at % 4 as int) as tx", "y0 + cast(at div 4 as int) as y", "x0 + cast(at % 4 as int) as x", "value")
    cells = px.filter("layer = 0").selectExpr("fragment_id", "y", "x", "if(x = 1, 0D, 1D) as mask")
    out = {(r["y"], r["x"]): r["value"] for r in volume.blend(flat, 4, cells).collect()}
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    assert abs(out[0, 0] - sigmoid(2)) < 1e-9 and abs(out[2, 2] - sigmoid(-1)) < 1e-9 and out[2, 1] == 0.0 and out[4, 4] == 0.0
    masks = spark.createDataFrame([(1, 255.0), (1, 0.0), (2, 1.0)], "fragment_id long, value double")
    assert sorted((r["fragment_id"], r["value"]) for r in volume.scaled_mask(masks).collect()) == [(1, 0.0), (1, 1.0), (2, 1.0)]


def test_peaks_of_rows():
    """All rows at once give what ``find_peaks`` gives for each: flat tops, ties, distances."""
    from meshlens.operators.segments import find_peaks, peak_rows

    y = np.random.default_rng(3).integers(0, 6, (300, 40)).astype(float)
    y[0], y[1, :5], y[2, -5:] = 2.0, 9.0, 9.0
    for distance in (1, 3, 8):
        row, at = peak_rows(y, np.median(y, axis=1), distance)
        for k in range(len(y)):
            assert at[row == k].tolist() == find_peaks(y[k], float(np.median(y[k])), distance).tolist()
    assert [len(x) for x in peak_rows(np.zeros((0, 5)), np.zeros(0), 8)] == [0, 0]


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def metric_rows(df) -> dict:
    return {r["segment_id"]: (round(r["score"], 6), r["problem_faces"]) for r in df.collect()}


def test_held_layers(spark, sf_dir):
    """Segments scored beside a held volume equal the joins with its chunks, and move the lines only."""
    from meshlens import queries

    parts = queries._segments(spark, sf_dir), queries.meshes(spark, sf_dir)[1], queries._samples(spark, sf_dir, 300), queries._chunks(spark), 16
    held = metric_rows(queries._on_segments(spark, sf_dir, ct.held_layers(reach=40), ct.SCORED, 300))
    assert held == metric_rows(ct.layer_distance(*parts, reach=40)) and any(faces for _, faces in held.values())
    assert exchanges(queries.QUERIES["ct_layer_distance"](spark, sf_dir)) <= 2
    assert ct.held(queries._chunks(spark), 16, most=1000) is None


def pixel_plan(name: str, spark, sf_dir) -> str:
    """The plan of a query of pixels: no join, no broadcast, and a shuffle of the fragments only."""
    from meshlens import queries

    df = queries.QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan and plan.count("Exchange ") == plan.count("REPARTITION_BY_NUM") > 0
    return plan


def test_masked_blend_stays_in_place(spark, sf_dir):
    """A fragment's pixels are never broadcast or shuffled; each asked one gives a row, whatever the tiles cover."""
    from meshlens.operators import volume

    pixel_plan("masked_blend", spark, sf_dir)
    px = spark.createDataFrame([(1, 0, 0, 0, 0, 0, 0, 0.5), (1, 0, 0, 0, 1, 0, 1, 0.25)], "fragment_id long, y0 int, x0 int, ty int, tx int, y int, x int, value double")
    cells = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 0, 1.0), (1, 0, 1, None), (1, 5, 5, 1.0), (2, 0, 0, 1.0)], "fragment_id long, y int, x int, mask double")
    got = sorted(tuple(r) for r in volume.blend(px, 2, cells).fillna(-1.0).collect())
    assert got == [(1, 0, 0, 0.5), (1, 0, 0, 0.5), (1, 0, 1, -1.0), (1, 5, 5, 0.0), (2, 0, 0, 0.0)]


def test_training_loss_stays_in_place(spark, sf_dir):
    """Losses of the masked blend need neither a join nor a shuffle of pixels."""
    assert "HashAggregate" in pixel_plan("training_loss", spark, sf_dir)


def test_fragments_of_a_task_are_bounded(spark, tmp_path):
    """More fragments go to more tasks: what a task holds doesn't grow with their number."""
    from meshlens import queries

    spark.range(20_000).withColumnRenamed("id", "s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    for name in ("training_loss", "masked_blend", "tile_coverage"):
        plan = queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("REPARTITION_BY_NUM") == plan.count(", 313), REPARTITION_BY_NUM") > 0
    assert queries._fragments(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 96


def test_tile_coverage_stays_in_place(spark, sf_dir):
    """Tiles meet the mask without a join; tiles without a mask, and missing pixels, as before."""
    from meshlens.operators import volume

    pixel_plan("tile_coverage", spark, sf_dir)
    tiles = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (2, 0, 0)], "fragment_id long, y0 int, x0 int")
    mask = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 1.0), (1, 1, 1, 1.0), (1, 1, 2, None), (3, 0, 0, 1.0)], "fragment_id long, y int, x int, mask double")
    assert [tuple(r) for r in volume.covered_tiles(tiles, mask, 2).collect()] == [(1, 0, 0, 0.75)]


def rough(spark):
    """A volume of noise with faint layers, held and as chunks."""
    chunks = formula_chunks(spark, lambda z, y, x: (z * 7 + (z * 7919 + y * 104729 + x * 1299709) * (z + 3 * y + 5 * x) % 211).astype(float), (48, 48, 48), 16)
    return chunks, ct.held(chunks, 16)


def test_held_alignment(spark, sf_dir):
    """Figures of segments beside a held volume equal those of the joins with its chunks."""
    from meshlens import queries

    chunks, volume = rough(spark)
    s = queries._samples(spark, sf_dir, 60)
    angles = ct.normal_angles(s, ct.cube_normals(ct.cubes(s, chunks, 4, 16), 4, 2.0))
    want = ct.alignment(s, (48, 48, 48), ct.chunk_values(s.select("segment_id", "iz", "iy", "ix"), chunks, 16, parts=4), angles)
    got = ct.on_segments(*queries.meshes(spark, sf_dir), volume, queries._place, ct.held_alignment(4, 2.0), ct.ALIGNED, 60)
    assert got.dtypes == want.dtypes
    for a, b in zip(*(sorted(map(tuple, x.collect())) for x in (got, want)), strict=True):
        assert a[0] == b[0] and a[-1] == b[-1] and a[1:-1] == pytest.approx(b[1:-1], abs=1e-9)
    assert exchanges(queries.QUERIES["ct_alignment"](spark, sf_dir)) <= 2
    far = spark.createDataFrame([(1, 0, 900.0, 0.0, 0.0)], "segment_id long, vertex_id long, x double, y double, z double")
    none = queries.meshes(spark, sf_dir)[1].filter("false")
    assert ct.on_segments(far, none, volume, queries._place, ct.held_alignment(4, 2.0), ct.ALIGNED).collect() == []


def test_held_switching(spark, sf_dir):
    from meshlens import queries

    chunks, volume = rough(spark)
    v, f = queries.meshes(spark, sf_dir)
    got = metric_rows(ct.on_segments(v, f, volume, queries._place, ct.held_switching(4, 2.0), ct.SCORED))
    want = metric_rows(ct.ct_sheet_switching(queries._segments(spark, sf_dir), f, queries._samples(spark, sf_dir), chunks, 16, half=4, sigma=2.0))
    assert got == want and any(faces for _, faces in got.values())
    bare = metric_rows(ct.on_segments(v, f.filter("segment_id > 3"), volume, queries._place, ct.held_switching(4, 2.0), ct.SCORED))
    assert bare[1] == (1.0, None) and bare[5] == got[5]
    assert exchanges(queries.QUERIES["ct_sheet_switching"](spark, sf_dir)) <= 2


def test_held_coherence(spark, sf_dir):
    from meshlens import queries

    chunks, volume = rough(spark)
    v, f = queries.meshes(spark, sf_dir)
    for n in (80, 8):
        s = queries._samples(spark, sf_dir, n)
        want = metric_rows(ct.fiber_coherence(queries._segments(spark, sf_dir), f, s, ct.cube_fibers(ct.cubes(s, chunks, 4, 16), 4)))
        got = metric_rows(ct.on_segments(v, f, volume, queries._place, ct.held_coherence(4), ct.SCORED, n))
        assert got == want and any(faces for _, faces in got.values())
    assert {score for score, _ in got.values()} == {1.0}
    bare = metric_rows(ct.on_segments(v, f.filter("segment_id > 3"), volume, queries._place, ct.held_coherence(4), ct.SCORED, 80))
    assert bare[2] == (0.0, None)
    assert exchanges(queries.QUERIES["fiber_coherence"](spark, sf_dir)) <= 2
