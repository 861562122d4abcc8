"""Score segments as their files arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.segments import measure
from ..plans.scoring import aggregate, suppress, weigh


def watch(spark: SparkSession, vertices_dir: str, faces_dir: str, out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of new faces is scored with its segments' vertices and appended to ``out``.

    A segment's files must be complete, vertices first, when its faces arrive.
    """
    faces = spark.readStream.schema("segment_id long, face_id long, v0 long, v1 long, v2 long").parquet(faces_dir)

    def score(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        vertices = spark.read.parquet(vertices_dir).join(batch.select("segment_id").distinct(), "segment_id", "left_semi")
        aggregate(suppress(weigh(measure(vertices, batch)))).write.mode("append").parquet(out)
        batch.unpersist()

    return faces.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
