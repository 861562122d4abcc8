"""Tiers, weights, suppression, aggregate, grade and ranking of metric rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import letter_grade

#: Weight of each metric by tier.
TIER_WEIGHTS = {
    "tier1": {"triangle_quality": 0.10, "topology": 0.10, "normal_consistency": 0.10, "sheet_switching": 0.30, "self_intersections": 0.25, "noise": 0.15},
    "tier2": {"triangle_quality": 0.10, "topology": 0.10, "normal_consistency": 0.10, "sheet_switching": 0.20, "self_intersections": 0.20, "noise": 0.10, "ct_sheet_switching": 0.00, "fiber_coherence": 0.10, "layer_distance": 0.10},
    "tier3": {"triangle_quality": 0.05, "topology": 0.10, "normal_consistency": 0.05, "sheet_switching": 0.15, "self_intersections": 0.15, "noise": 0.05, "ct_sheet_switching": 0.00, "fiber_coherence": 0.10, "layer_distance": 0.10, "winding_angle": 0.25},
}
#: Weight where the tier's table lacks the metric.
DEFAULT_WEIGHTS = {"winding_angle": 0.15, "fiber_coherence": 0.10, "layer_distance": 0.10, "ct_sheet_switching": 0.10}


def tier(has_volume: bool, has_axis: bool) -> str:
    return "tier3" if has_volume and has_axis else "tier2" if has_volume else "tier1"


def weigh(results: DataFrame, name: str = "tier1", overrides: dict[str, float] | None = None) -> DataFrame:
    """results with their weight; a small constant table, so a map literal and no join."""
    table = DEFAULT_WEIGHTS | TIER_WEIGHTS[name] | (overrides or {})
    weights = F.create_map(*(F.lit(x) for kv in table.items() for x in (kv[0], float(kv[1]))))
    return results.withColumn("weight", F.coalesce(weights[F.col("metric")], F.lit(0.0)))


def suppress(weighted: DataFrame, approximate_fiber: bool = False) -> DataFrame:
    """Weight 0 for metrics with under 50 samples (and CT and fiber if the fiber field is approximate); then rescale sums in (0, 1)."""
    few = F.coalesce(F.col("details")["n_sampled"] < 50, F.lit(False))
    if approximate_fiber:
        few = few | F.col("metric").isin("ct_sheet_switching", "fiber_coherence")
    cut = weighted.withColumn("weight", F.when(few, 0.0).otherwise(F.col("weight")))
    total = F.sum("weight").over(Window.partitionBy("segment_id"))
    return cut.withColumn("_t", total).withColumn("weight", F.when((F.col("_t") > 0) & (F.col("_t") < 1), F.col("weight") / F.col("_t")).otherwise(F.col("weight"))).drop("_t")


def aggregate(weighted: DataFrame) -> DataFrame:
    total = F.sum("weight")
    score = F.when(total > 0, F.sum(F.col("score") * F.col("weight")) / total).otherwise(0.0)
    return weighted.groupBy("segment_id").agg(score.alias("aggregate_score")).withColumn("grade", letter_grade(F.col("aggregate_score")))


#: The order of metrics in reports, which settles ties.
ORDER = tuple(TIER_WEIGHTS["tier3"])


def worst(score: str = "score", metric: str = "metric"):
    """Aggregate: the metric with the lowest score under 1, the first in report order among equals."""
    place = F.coalesce(*(F.when(F.col(metric) == m, i) for i, m in enumerate(ORDER)), F.lit(len(ORDER)))
    return F.min(F.when((F.col(score) < 1.0) & ~F.col(metric).isin("layer_distance", "error"), F.struct(F.col(score), place, F.col(metric).alias("metric"))))["metric"]


def ranking(weighted: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """One row per segment, worst first: aggregate, grade, worst metric, scores by metric, error.

    Failed segments, and those of ``segments`` without results, get score 0 and
    grade F.  Other columns of ``segments`` (obj_path, n_vertices, n_faces, an
    error of reading) go into the rows.
    """
    total, failed = F.sum("weight"), F.max("error")
    # one aggregate: the metrics are computed once
    out = weighted.groupBy("segment_id").agg(
        F.when((total > 0) & failed.isNull(), F.sum(F.col("score") * F.col("weight")) / total).otherwise(0.0).alias("aggregate_score"),
        worst().alias("worst_metric"),
        *(F.round(F.max(F.when(F.col("metric") == m, F.col("score"))), 4).alias(m) for m in ORDER),
        failed.alias("error"),
    )
    names = [*ORDER, "error"]
    if segments is not None:
        more = [c for c in segments.columns if c not in ("segment_id", "error")]
        own = segments.withColumn("_error", F.col("error") if "error" in segments.columns else F.lit(None).cast("string")).drop("error")
        out = own.join(out, "segment_id", "left").withColumn("error", F.coalesce("_error", "error", F.when(F.col("aggregate_score").isNull(), F.lit("no results"))))
        out = out.withColumn("aggregate_score", F.when(F.col("error").isNull(), F.col("aggregate_score")).otherwise(0.0))
        names = [*ORDER, *more, "error"]
    out = out.withColumn("grade", letter_grade(F.col("aggregate_score"))).select("segment_id", "aggregate_score", "grade", "worst_metric", *names)
    return out.withColumn("aggregate_score", F.round("aggregate_score", 4)).orderBy("aggregate_score", "segment_id")


def json_reports(weighted: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """segment_id and one JSON document: scroll, file, mesh figures, aggregate, grade and metrics by name.

    ``segments``: scroll_id, file, n_vertices, n_faces by segment_id, all optional.
    """
    faces = F.when(F.col("problem_faces").isNotNull(), F.size("problem_faces"))
    item = F.struct(F.round("score", 4).alias("score"), "weight", F.round(F.col("score") * F.col("weight"), 4).alias("weighted_score"), faces.alias("n_problem_faces"), F.map_entries("details").alias("details"))
    total = F.sum("weight")
    # one aggregate for the metrics and their sum, so that the metrics are computed once
    each = weighted.groupBy("segment_id").agg(F.sort_array(F.collect_list(F.struct("metric", item.alias("item")))).alias("m"), F.when(total > 0, F.sum(F.col("score") * F.col("weight")) / total).otherwise(0.0).alias("aggregate_score"))
    named = F.map_from_entries(F.transform("m", lambda x: F.struct(x["metric"], x["item"].withField("details", F.map_from_entries(x["item"]["details"])))))
    each = each.withColumn("grade", letter_grade(F.col("aggregate_score")))
    if segments is not None:
        each = each.join(segments, "segment_id", "left")
    have = lambda c, kind: F.col(c) if segments is not None and c in segments.columns else F.lit(None).cast(kind)
    stats = F.struct(have("n_vertices", "long").alias("n_vertices"), have("n_faces", "long").alias("n_faces"))
    doc = F.struct(F.lit("1.0").alias("schema_version"), have("scroll_id", "string").alias("scroll_id"), "segment_id", have("file", "string").alias("file"), stats.alias("mesh_stats"), F.round("aggregate_score", 4).alias("aggregate_score"), "grade", named.alias("metrics"))
    return each.select("segment_id", F.to_json(doc).alias("report"))


def paint(weighted: DataFrame) -> DataFrame:
    """segment_id, face_id, metric: of the metrics that flag a face the one with the highest weight."""
    order = {m: i for i, m in enumerate(DEFAULT_WEIGHTS | TIER_WEIGHTS["tier3"])}
    rank = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))[F.col("metric")]
    flagged = weighted.filter("weight > 0").select("segment_id", F.explode("problem_faces").alias("face_id"), "metric", "weight")
    return flagged.groupBy("segment_id", "face_id").agg(F.min(F.struct(-F.col("weight"), rank, F.col("metric")))["metric"].alias("metric"))


def text_report(weighted: DataFrame) -> DataFrame:
    """One line per metric: score, weight, weighted score and details up to 80 characters."""
    details = F.array_join(F.transform(F.map_entries("details"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4g", e["value"]))), ", ")
    line = F.format_string("%-20s %5.3f %5.2f %5.3f %s", "metric", "score", "weight", F.col("score") * F.col("weight"), F.left(F.coalesce(details, F.lit("")), F.lit(80)))
    return weighted.select("segment_id", "metric", line.alias("line"))


def write_csv(ranked: DataFrame, path: str) -> None:
    """The ranking in one CSV file with a header; it has one row per segment."""
    ranked.coalesce(1).sortWithinPartitions("aggregate_score", "segment_id").write.mode("overwrite").option("header", True).csv(path)
