import json
import struct

from meshlens.__main__ import axis_of, main
from meshlens.operators.segments import GEOMETRY
from meshlens.sources import meshfiles
from meshlens.sources.meshbytes import parse_ply, parse_stl

TRIANGLES = [((0, 0, 0), (1, 0, 0), (1, 1, 0)), ((0, 0, 0), (1, 1, 0), (0, 1, 0))]


def test_ply_and_stl(spark, tmp_path):
    head = "ply\nformat {} 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    corners = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)]
    plain = head.format("ascii").encode() + b"".join(b"%d %d %d\n" % c for c in corners) + b"4 0 1 2 3\n"
    for kind, order in (("binary_little_endian", "<"), ("binary_big_endian", ">")):
        body = head.format(kind).encode() + b"".join(struct.pack(order + "3f", *c) for c in corners) + struct.pack(order + "B4i", 4, 0, 1, 2, 3)
        xyz, tri = parse_ply(body)
        assert xyz.tolist() == [list(map(float, c)) for c in corners] and tri.tolist() == [[0, 1, 2], [0, 2, 3]]
    assert parse_ply(plain)[1].tolist() == [[0, 1, 2], [0, 2, 3]]
    binary = bytes(80) + struct.pack("<I", 2) + b"".join(struct.pack("<12fH", 0, 0, 1, *sum(t, ()), 0) for t in TRIANGLES)
    text = "solid a\n" + "".join("facet normal 0 0 1\nouter loop\n" + "".join("vertex %d %d %d\n" % p for p in t) + "endloop\nendfacet\n" for t in TRIANGLES)
    for body in (binary, text.encode()):
        xyz, tri = parse_stl(body)
        assert xyz.tolist() == [list(map(float, c)) for c in corners] and tri.tolist() == [[0, 1, 2], [0, 2, 3]]
    (tmp_path / "a.ply").write_bytes(plain)
    (tmp_path / "b.stl").write_bytes(binary)
    for kind, name in (("ply", "a"), ("stl", "b")):
        v, f = meshfiles.read_meshes(spark, str(tmp_path), kind)
        assert v.count() == 4 and {(r["segment_id"], r["v0"], r["v1"], r["v2"]) for r in f.collect()} == {(name, 0, 1, 2), (name, 0, 2, 3)}


def test_axis(tmp_path):
    assert axis_of("50,30") == [(0.0, 50.0, 30.0)] and axis_of(None) is None
    (tmp_path / "a.txt").write_text("# x y z\n10 0 20\n10 100 20\n")
    assert axis_of(str(tmp_path / "a.txt")) == [(0.0, 10.0, 20.0), (100.0, 10.0, 20.0)]


def test_score_and_batch(spark, tmp_path, capsys):
    n = 6
    body = "".join(f"v {x} {y} 0\n" for y in range(n) for x in range(n))
    body += "".join(f"f {a} {a + 1} {a + n}\nf {a + 1} {a + n + 1} {a + n}\n" for y in range(n - 1) for a in range(y * n + 1, y * n + n))
    (tmp_path / "flat.obj").write_text(body)
    page = tmp_path / "review.html"
    assert main(["score", str(tmp_path), "--format", "json", "--review", str(page)]) == 0
    report = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert report["segment_id"] == "flat" and set(report["metrics"]) == set(GEOMETRY)
    assert report["mesh_stats"] == {"n_vertices": 36, "n_faces": 50} and report["file"].endswith("flat.obj")
    (tmp_path / "broken.obj").write_text("v 0 0 x\nf 1 2 3\n")
    assert "<title>flat</title>" in page.read_text() and "sheet_switching" in page.read_text()
    assert main(["batch", str(tmp_path), "-o", str(tmp_path / "out")]) == 0
    rows = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert [r["segment_id"] for r in rows] == ["broken", "flat"] and rows[1]["grade"] in "ABCDF" and rows[1]["n_faces"] == "50"
    assert rows[0]["grade"] == "F" and "ValueError" in rows[0]["error"] and rows[0]["obj_path"].endswith("broken.obj")
    assert main(["score", str(tmp_path / "none")]) == 1
