"""Edges, adjacency, components and rings of meshes as joins over edge keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored


def half_edges(faces: DataFrame) -> DataFrame:
    """segment_id, face_id, u < w for the three sides of each face."""
    sides = F.array(*(F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("w")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))
    return faces.select("segment_id", "face_id", F.explode(sides).alias("s")).select("segment_id", "face_id", "s.u", "s.w")


def edge_multiplicity(faces: DataFrame) -> DataFrame:
    return half_edges(faces).groupBy("segment_id", "u", "w").agg(F.count("*").alias("faces"))


def boundary_edges(faces: DataFrame) -> DataFrame:
    return edge_multiplicity(faces).filter("faces = 1").select("segment_id", "u", "w")


def face_pairs(faces: DataFrame) -> DataFrame:
    """Neighbours i, j along each edge: the next face and, with three or more, the one after."""
    w = Window.partitionBy("segment_id", "u", "w").orderBy("face_id")
    nexts = half_edges(faces).select("segment_id", F.col("face_id").alias("i"), F.array(F.lead("face_id", 1).over(w), F.lead("face_id", 2).over(w)).alias("js"))
    return nexts.select("segment_id", "i", F.explode("js").alias("j")).filter("j is not null")


def vertex_edges(faces: DataFrame) -> DataFrame:
    """segment_id, u < w, distinct, without loops."""
    return half_edges(faces).filter("u < w").select("segment_id", "u", "w").distinct()


def components(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """Smallest node id reachable (``label``) for each (segment_id, node).

    Labels spread along edges and jump to their label's label each round, so
    the rounds grow with the logarithm of a component's extent; each round is
    a written table in the shared folder.
    """
    edges = stored(edges.select("segment_id", "i", "j").filter("i <> j").distinct(), "edges")
    both = edges.toDF("segment_id", "a", "b").union(edges.select("segment_id", "j", "i"))
    now = nodes.select("segment_id", F.col(node).alias("a"), F.col(node).alias("label"))
    before = None
    while True:
        seen = both.join(now.select("segment_id", F.col("a").alias("b"), "label"), ["segment_id", "b"]).groupBy("segment_id", "a").agg(F.min("label").alias("least"))
        spread = now.join(seen, ["segment_id", "a"], "left").select("segment_id", "a", F.least("label", "least").alias("label"))
        jump = spread.select("segment_id", F.col("a").alias("label"), F.col("label").alias("far"))
        now = stored(spread.join(jump, ["segment_id", "label"]).select("segment_id", "a", F.col("far").alias("label")), "labels")
        mark = now.agg(F.sum(F.xxhash64("label").cast("decimal(38,0)"))).first()[0]
        if mark == before:
            return now.select("segment_id", F.col("a").alias(node), "label")
        before = mark


def boundary_ring(faces: DataFrame, hops: int = 3) -> DataFrame:
    """Vertices at most ``hops`` edges away from a boundary edge."""
    both = F.explode(F.array(F.struct("u", "w"), F.struct(F.col("w").alias("u"), F.col("u").alias("w")), F.struct("u", F.col("u").alias("w")), F.struct(F.col("w").alias("u"), "w")))
    steps = stored(vertex_edges(faces).select("segment_id", both.alias("s")).select("segment_id", F.col("s.u").alias("vertex_id"), F.col("s.w").alias("next")).distinct(), "steps")
    rim = boundary_edges(faces)
    ring = rim.select("segment_id", F.explode(F.array("u", "w")).alias("vertex_id")).distinct()
    for _ in range(hops):  # each vertex is a step from itself, so a hop names the ring before it once
        ring = ring.join(steps, ["segment_id", "vertex_id"]).select("segment_id", F.col("next").alias("vertex_id")).distinct()
    return ring


def ring_pairs(pairs: DataFrame, faces: DataFrame, doublings: int = 3) -> DataFrame:
    """(i, j) within 2**doublings steps of face adjacency: repeated squaring by self joins.

    For segments of any size; ``segments.smooth`` is the shorter way where a
    segment fits one task.
    """
    reach = pairs.select("segment_id", "i", "j").union(pairs.select("segment_id", F.col("j").alias("i"), F.col("i").alias("j"))).union(faces.select("segment_id", F.col("face_id").alias("i"), F.col("face_id").alias("j"))).distinct()
    for _ in range(doublings):
        onward = reach.select("segment_id", F.col("i").alias("j"), F.col("j").alias("k"))
        reach = stored(reach.join(onward, ["segment_id", "j"]).select("segment_id", "i", F.col("k").alias("j")).distinct(), "rings")
    return reach


def vertex_fans(faces: DataFrame) -> DataFrame:
    """segment_id, vertex_id, fans: edge-connected groups of the faces around a vertex."""
    corner = faces.select("segment_id", "face_id", F.posexplode(F.array("v0", "v1", "v2")).alias("k", "vertex_id"), "v0", "v1", "v2")
    inc = corner.select("segment_id", "vertex_id", "face_id").distinct()
    # a fan is linked by the edges at the vertex: a graph of (vertex, face) nodes
    ends = half_edges(faces).select("segment_id", "face_id", F.explode(F.array("u", "w")).alias("vertex_id"), F.struct("u", "w").alias("edge"))
    w = Window.partitionBy("segment_id", "vertex_id", "edge").orderBy("face_id")
    links = ends.distinct().select("segment_id", "vertex_id", "face_id", F.lead("face_id").over(w).alias("next")).filter("next is not null")
    key = lambda f: F.struct(F.col("vertex_id"), F.col(f).alias("face_id"))
    found = components(inc.select("segment_id", key("face_id").alias("id")), links.select("segment_id", key("face_id").alias("i"), key("next").alias("j")))
    return found.groupBy("segment_id", F.col("id.vertex_id").alias("vertex_id")).agg(F.countDistinct("label").alias("fans"))
