"""Keeping a counted relation up to date from a stream of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from treeline.sources.catalog import relation


def append_stream(stream: DataFrame, left: str, right: str, path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's counted pairs under its own number; a batch run again replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        relation(batch, left, right).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, path: str) -> DataFrame:
    """The relation so far: multiplicities add up over batches."""
    return spark.read.parquet(path).groupBy("l", "r").agg(F.sum("mult").alias("mult"))


def unmerged(spark, path: str) -> DataFrame:
    """``(epoch, l, r, mult)``: what each micro-batch wrote that :func:`compact` hasn't merged yet, batch 0 first."""
    return spark.read.parquet(path).select(F.col("epoch").cast("long").alias("epoch"), "l", "r", "mult")


def compact(spark, path: str, to: str) -> DataFrame:
    """Merge all batches into one counted relation at *to*."""
    current(spark, path).write.mode("overwrite").parquet(to)
    return spark.read.parquet(to)
