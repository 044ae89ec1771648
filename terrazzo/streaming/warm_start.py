"""Segmenting a stream of frames, each from the centres of the one before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrazzo.operators.segment import CLUSTERS, Slic


def last_clusters(spark: SparkSession, folder: str, before: int) -> DataFrame | None:
    """The clusters that the last batch before ``before`` left, if any."""
    try:
        known = spark.read.parquet(folder)
    except AnalysisException:  # no batch has left any yet
        return None
    last = known.where(F.col("batch") < before).agg(F.max("batch")).first()[0]
    return None if last is None else known.where(F.col("batch") == last).select(*CLUSTERS)


def segment_stream(frames: DataFrame, model: Slic, sink: Callable[[DataFrame, int], None], checkpoint: str, max_iter: int = 10) -> StreamingQuery:
    """Run ``model`` over a stream of pixels with a column ``frame``, in the order of frames within each batch.

    ``sink(assignment with frame, batch)`` gets each frame's labels. Centres go on from frame to frame. Each batch leaves
    them beside the stream's own checkpoint, in the shared folder ``checkpoint``, and begins with those of the batch
    before, so that a stream that is started anew, or a batch that is run again, goes on as if nothing had happened. The
    model's own clusters are those of the first batch.
    """
    spark, folder, first = frames.sparkSession, f"{checkpoint}/clusters", model.clusters

    def batch(df: DataFrame, number: int) -> None:
        known = last_clusters(spark, folder, number)
        model.clusters = first if known is None else known
        df = df.persist()
        for row in df.select("frame").distinct().orderBy("frame").collect():  # the frames of one batch
            own = df.where(F.col("frame") == row.frame).drop("frame")
            sink(model.iterate(own, max_iter).withColumn("frame", F.lit(row.frame)), number)
        df.unpersist()
        if model.clusters is not None:
            model.clusters.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return frames.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
