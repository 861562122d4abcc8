from meshlens.plans.derive import meshes
from meshlens.sources import meshfiles
from meshlens.streaming.watch import watch


def test_obj_discovery_and_ply(spark, tmp_path):
    (tmp_path / "paths/20231001000000").mkdir(parents=True)
    body = "v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\n# c\nf 1/1 2/2 3/3 4/4\nf -4 -3 -2\n"
    (tmp_path / "paths/20231001000000/mesh.obj").write_text(body)
    (tmp_path / "flat.obj").write_text(body)
    found = {r["segment_id"] for r in meshfiles.discover_segments(spark, str(tmp_path)).collect()}
    assert found == {"20231001000000", "flat"}
    v, f = meshfiles.read_obj(spark, str(tmp_path))
    assert v.count() == 8 and {(r["v0"], r["v1"], r["v2"]) for r in f.filter("segment_id = 'flat'").collect()} == {(0, 1, 2), (0, 2, 3)}
    lines = [r["line"] for r in meshfiles.ply_lines(v, f, "flat").collect()]
    assert lines[0] == "ply" and lines[-1] == "3 0 1 2" and len(lines) == 9 + 4 + 3


def test_axis_and_settings(spark, tmp_path):
    (tmp_path / "axis.txt").write_text("# x y z\n10 0 20\n10 100 20 # end\n")
    assert [tuple(r) for r in meshfiles.read_axis(spark, str(tmp_path / "axis.txt")).collect()] == [(10, 0, 20), (10, 100, 20)]
    (tmp_path / "s.json").write_text('{\n"scroll_name": "A",\n"umbilicus_simple": [1, 2]\n}')
    assert meshfiles.read_settings(spark, str(tmp_path / "s.json")).first()["scroll_name"] == "A"


def test_watch_scores_new_segments(spark, sf_dir, tmp_path):
    v, f = meshes(spark, sf_dir)
    v.filter("segment_id < 3").write.parquet(str(tmp_path / "v"))
    f.filter("segment_id < 3").write.parquet(str(tmp_path / "f"))
    q = watch(spark, str(tmp_path / "v"), str(tmp_path / "f"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
