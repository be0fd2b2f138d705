"""Shared folder, session settings and small helpers of the corpus operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.sources import storage

#: Bounds on one Arrow batch, so that a worker's memory doesn't depend on text lengths.
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20


#: Settings the operators need: bounded Arrow batches, shuffle files freed when the query that made them ends.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
    "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
#: What the session had of them before.
_before: dict[str, str | None] = {}


def prepare(spark: SparkSession) -> None:
    """Set ``SETTINGS``.  Results are computed when their caller reads them, so they stay until :func:`release`."""
    for k, v in SETTINGS.items():
        if k not in _before:
            _before[k] = spark.conf.get(k, None)
        spark.conf.set(k, v)


def release(spark: SparkSession) -> None:
    """Once results have been written elsewhere: give the session its settings back and delete all staged tables."""
    for k, v in _before.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)
    _before.clear()
    storage.release(spark)


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write *df* to the shared folder and read it back: cuts lineage, survives lost executors.

    What isn't dropped is deleted by :func:`release` or at the end of the process."""
    path = storage.scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete what :func:`stage` wrote for *frames*."""
    storage.delete(spark, *(df._staged_path for df in frames if hasattr(df, "_staged_path")))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """The two columns most operators need; extra columns never clash with theirs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_key(text: str = "text"):
    """Stand-in for a row's text in keys: rows equal in doc_id and this are one document."""
    return F.coalesce(F.xxhash64(text), F.lit(0))


def map_rows(df: DataFrame, fn: Callable[[list[pa.RecordBatch]], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` of a function on single batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file."""
    root = os.environ.get("PUBLIC_TOKENIZERS")
    if root:
        return os.path.join(root, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def fresh(docs: DataFrame, name: str) -> str:
    """*name*, or that with underscores put before it, such that *docs* has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
