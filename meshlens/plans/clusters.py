"""Problem clusters of a segment: flagged faces grouped, merged over sources, described.

Faces that a metric flags are grouped by shared edges; groups of different
metrics that have a face in common become one cluster.  The largest clusters
get figures from the faces around them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.storage import stored

#: Metrics that give clusters, and their tags.
SOURCES = {"sheet_switching": "GEOM", "fiber_coherence": "FIBER", "winding_angle": "WINDING"}


def cluster_faces(results: DataFrame, faces: DataFrame, least: int = 5) -> DataFrame:
    """segment_id, cluster, source, face_id: members of clusters whose groups have ``least`` faces or more."""
    order = {m: i for i, m in enumerate(SOURCES)}
    source = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))[F.col("metric")]
    flagged = results.filter(F.col("metric").isin(*SOURCES)).select("segment_id", source.alias("source"), F.explode("problem_faces").alias("face_id")).distinct()
    nodes = flagged.withColumn("id", F.struct("source", "face_id"))
    side = lambda k: nodes.select("segment_id", "source", F.col("face_id").alias(k), F.col("id").alias(f"{k}d"))
    links = graph.face_pairs(faces).join(side("i"), ["segment_id", "i"]).join(side("j"), ["segment_id", "source", "j"]).select("segment_id", F.col("id").alias("i"), F.col("jd").alias("j"))
    grouped = nodes.join(graph.components(nodes.select("segment_id", "id"), links), ["segment_id", "id"])
    size = F.count("*").over(Window.partitionBy("segment_id", "label"))
    large = stored(grouped.withColumn("n", size).filter(F.col("n") >= least).drop("n"), "clusters")
    same = F.min("id").over(Window.partitionBy("segment_id", "face_id"))
    joined = large.select("segment_id", F.col("label").alias("i"), F.col("id").alias("j")).union(large.select("segment_id", same.alias("i"), "id"))
    merged = graph.components(large.select("segment_id", "id"), joined).withColumnRenamed("label", "cluster")
    return stored(large.join(merged, ["segment_id", "id"]).select("segment_id", "cluster", "source", "face_id"), "members")


def describe(members: DataFrame, geometry: DataFrame, faces: DataFrame, deviations: DataFrame, keep: int = 30, around: int = 500) -> DataFrame:
    """One row for each of a segment's ``keep`` first clusters, by sources and faces.

    centroid, mean and largest deviation, share of faces on a boundary edge,
    and z_jump: the distance of the median heights of flagged and other faces
    among the ``around`` nearest to the centroid.
    """
    tags = F.create_map(*(F.lit(x) for i, t in enumerate(SOURCES.values()) for x in (i, t)))
    once = members.groupBy("segment_id", "cluster", "face_id").agg(F.collect_set("source").alias("sources"))
    half, rim = graph.half_edges(faces), graph.boundary_edges(faces)
    rim_faces = half.join(rim, ["segment_id", "u", "w"], "left_semi").select("segment_id", "face_id").distinct().withColumn("rim", F.lit(1.0))
    at = geometry.select("segment_id", "face_id", "cx", "cy", "cz")
    full = once.join(at, ["segment_id", "face_id"]).join(deviations, ["segment_id", "face_id"]).join(rim_faces, ["segment_id", "face_id"], "left")
    head = full.groupBy("segment_id", "cluster").agg(
        F.count("*").alias("face_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
        *(F.avg(c).alias(f"m{c[1]}") for c in ("cx", "cy", "cz")),
        F.round(F.avg("deviation"), 1).alias("mean_dev"), F.round(F.max("deviation"), 1).alias("max_dev"),
        F.round(F.sum(F.coalesce("rim", F.lit(0.0))) / F.count("*"), 2).alias("boundary_frac"),
    )
    best = Window.partitionBy("segment_id").orderBy(F.size("sources").desc(), F.col("face_count").desc(), "cluster")
    top = head.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep)
    d2 = F.round((F.col("cx") - F.col("mx")) ** 2 + (F.col("cy") - F.col("my")) ** 2 + (F.col("cz") - F.col("mz")) ** 2, 9)
    near = Window.partitionBy("segment_id", "cluster").orderBy(d2, "face_id")
    seen = top.select("segment_id", "cluster", "mx", "my", "mz").join(at, "segment_id").withColumn("nth", F.row_number().over(near)).filter(F.col("nth") <= around)
    seen = seen.join(once.select("segment_id", "face_id").distinct().withColumn("bad", F.lit(True)), ["segment_id", "face_id"], "left")
    z = lambda c: F.percentile(F.when(c, F.col("cz")), 0.5)
    jump = seen.groupBy("segment_id", "cluster").agg(F.coalesce(F.round(F.abs(z(F.col("bad")) - z(F.col("bad").isNull())), 1), F.lit(0.0)).alias("z_jump"))
    out = top.join(jump, ["segment_id", "cluster"])
    badge = F.when(F.col("boundary_frac") > 0.3, "BOUNDARY").when(F.col("z_jump") > 50, "Z-JUMP")
    return out.select("segment_id", "rank", "face_count", F.transform("sources", lambda s: tags[s]).alias("sources"), "mx", "my", "mz", "mean_dev", "max_dev", "boundary_frac", "z_jump", badge.alias("badge"))


def cross_section(top: DataFrame, geometry: DataFrame, members: DataFrame, around: int = 500, points: int = 200) -> DataFrame:
    """segment_id, rank, nth, x, y, z, flagged: every so many-th of the faces nearest to each cluster."""
    at = geometry.select("segment_id", "face_id", "cx", "cy", "cz")
    d2 = F.round((F.col("cx") - F.col("mx")) ** 2 + (F.col("cy") - F.col("my")) ** 2 + (F.col("cz") - F.col("mz")) ** 2, 9)
    own = Window.partitionBy("segment_id", "rank")
    near = top.select("segment_id", "rank", "mx", "my", "mz").join(at, "segment_id").withColumn("nth", F.row_number().over(own.orderBy(d2, "face_id")) - 1).filter(F.col("nth") < around)
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(own) / points))
    kept = near.withColumn("step", step).filter("nth % step = 0")
    bad = members.select("segment_id", "face_id").distinct().withColumn("flagged", F.lit(True))
    return kept.join(bad, ["segment_id", "face_id"], "left").select("segment_id", "rank", "nth", F.round("cx", 1).alias("x"), F.round("cy", 1).alias("y"), F.round("cz", 1).alias("z"), F.coalesce("flagged", F.lit(False)).alias("flagged"))
