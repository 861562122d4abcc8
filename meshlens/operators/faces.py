"""Per-face and per-vertex geometry of triangle meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """faces with the corners' coordinates a, b, c: three equi joins on (segment, vertex)."""
    out = faces
    for k, name in enumerate("abc"):
        v = vertices.select("segment_id", F.col("vertex_id").alias(f"v{k}"), *(F.col(c).alias(f"{name}{c}") for c in "xyz"))
        out = out.join(v, ["segment_id", f"v{k}"])
    return out


def face_geometry(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Edge lengths, aspect (null: infinite), smallest angle, area, centroid, unit normal (null: none)."""
    a, b, c = (G.vector(p) for p in "abc")
    e0, e1, e2 = G.minus(b, a), G.minus(c, b), G.minus(a, c)
    back = lambda e: tuple(-x for x in e)
    t = corners(vertices, faces).withColumns({"l0": G.norm(e0), "l1": G.norm(e1), "l2": G.norm(e2), **dict(zip(("px", "py", "pz"), G.cross(e0, back(e2))))})
    low, high = F.least("l0", "l1", "l2"), F.greatest("l0", "l1", "l2")
    p = G.vector("p")
    n = G.unit(p)
    return t.select(
        "segment_id", "face_id", "v0", "v1", "v2", "l0", "l1", "l2",
        F.when(low > 0, high / low).alias("aspect"),
        F.least(G.angle(e0, back(e2)), G.angle(back(e0), e1), G.angle(back(e1), e2)).alias("min_angle"),
        (0.5 * G.norm(p)).alias("area"),
        *((F.col(f"a{x}") + F.col(f"b{x}") + F.col(f"c{x}")).__truediv__(3).alias(f"c{x}") for x in "xyz"),
        "px", "py", "pz", n[0].alias("nx"), n[1].alias("ny"), n[2].alias("nz"),
    )


def vertex_normals(geometry: DataFrame) -> DataFrame:
    """Area-weighted normals: incident face products summed and normalised."""
    each = geometry.select("segment_id", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"), "px", "py", "pz")
    s = each.groupBy("segment_id", "vertex_id").agg(*(F.sum(f"p{c}").alias(f"p{c}") for c in "xyz"))
    n = G.unit(G.vector("p"))
    return s.select("segment_id", "vertex_id", *(x.alias(f"n{c}") for x, c in zip(n, "xyz")))


def incidence_average(faces: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """A face value averaged over the faces around each vertex."""
    each = faces.join(values, ["segment_id", "face_id"]).select("segment_id", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"), value)
    return each.groupBy("segment_id", "vertex_id").agg(F.avg(value).alias(value))


def bad_faces(geometry: DataFrame) -> DataFrame:
    return geometry.filter("coalesce(aspect, 1e300) >= 5 or min_angle <= 15").select("segment_id", "face_id")


def faces_touching(faces: DataFrame, flagged: DataFrame) -> DataFrame:
    """Faces with a flagged vertex: an equi semi join on the exploded corners."""
    each = faces.select("segment_id", "face_id", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"))
    return each.join(flagged.select("segment_id", "vertex_id"), ["segment_id", "vertex_id"], "left_semi").select("segment_id", "face_id").distinct()


def grid_cells(faces: DataFrame, cells: int = 8) -> DataFrame:
    """Cell of each face's centroid in a regular grid over the segment's bounding box."""
    box = faces.groupBy("segment_id").agg(*(f(c).alias(f"{n}_{c}") for c in ("cx", "cy", "cz") for f, n in ((F.min, "lo"), (F.max, "hi"))))
    out = faces.join(box, "segment_id")

    def cell(c: str):
        extent = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        return F.least(F.lit(cells - 1), F.greatest(F.lit(0), F.floor((F.col(c) - F.col(f"lo_{c}")) / F.when(extent == 0, 1.0).otherwise(extent) * (cells - 1e-9)).cast("int")))

    return out.select("segment_id", "face_id", cell("cx").alias("ix"), cell("cy").alias("iy"), cell("cz").alias("iz"))


def edge_gradient(vertices: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """segment_id, u, w, gradient: change of a vertex column along edges (segment_id, u, w) by their length, of 1e-12 at least."""
    end = lambda k: vertices.select("segment_id", F.col("vertex_id").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("x", "y", "z")), F.col(value).alias(f"{k}_v"))
    length = F.sqrt(sum((F.col(f"u_{c}") - F.col(f"w_{c}")) ** 2 for c in "xyz"))
    both = edges.join(end("u"), ["segment_id", "u"]).join(end("w"), ["segment_id", "w"])
    return both.select("segment_id", "u", "w", (F.abs(F.col("u_v") - F.col("w_v")) / F.greatest(length, F.lit(1e-12))).alias("gradient"))


def decimate(vertices: DataFrame, faces: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """Vertices of one grid cell become one (the smallest id, at their mean place); faces that collapse or repeat go.

    An approximation of quadric decimation by vertex clustering.
    """
    cell = [F.floor(F.col(c) / size).alias(f"c{c}") for c in "xyz"]
    placed = vertices.select("segment_id", "vertex_id", "x", "y", "z", *cell)
    kept = placed.groupBy("segment_id", "cx", "cy", "cz").agg(F.min("vertex_id").alias("to"), *(F.avg(c).alias(c) for c in "xyz"))
    moved = placed.select("segment_id", "vertex_id", "cx", "cy", "cz").join(kept.select("segment_id", "cx", "cy", "cz", "to"), ["segment_id", "cx", "cy", "cz"])
    out = faces
    for k in ("v0", "v1", "v2"):
        out = out.join(moved.select("segment_id", F.col("vertex_id").alias(k), F.col("to").alias(f"n{k}")), ["segment_id", k])
    whole = out.filter("nv0 <> nv1 and nv1 <> nv2 and nv2 <> nv0")
    corners = F.sort_array(F.array("nv0", "nv1", "nv2"))
    one = whole.groupBy("segment_id", corners.alias("corners")).agg(F.min(F.struct("face_id", "nv0", "nv1", "nv2")).alias("f"))
    return kept.select("segment_id", F.col("to").alias("vertex_id"), "x", "y", "z"), one.select("segment_id", "f.face_id", F.col("f.nv0").alias("v0"), F.col("f.nv1").alias("v1"), F.col("f.nv2").alias("v2"))
