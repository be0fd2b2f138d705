"""Tables in the session's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


#: Folders made by :func:`scratch_path` and not deleted yet.
_made: dict[str, None] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where a session on one machine leaves it unset."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that all machines of {master} share")
        found = tempfile.mkdtemp(prefix="treeline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; it lives until :func:`delete`, :func:`release` or the end of the process."""
    if not _made:
        atexit.register(_at_exit)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = None
    return path


def _remove(jvm, conf, path: str) -> None:
    own = jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(conf).delete(own, True)
    _made.pop(path, None)


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        _remove(spark._jvm, spark._jsc.hadoopConfiguration(), path)


def release(spark: SparkSession) -> None:
    """Delete all scratch folders; results that read them, and weren't written elsewhere, are gone."""
    delete(spark, *_made)


def _at_exit() -> None:
    gateway = SparkContext._gateway
    with contextlib.suppress(Exception):  # the JVM may have ended first
        for path in list(_made):
            _remove(gateway.jvm, gateway.jvm.org.apache.hadoop.conf.Configuration(), path)


def write_table(df: DataFrame, path: str, order: list[str] | None = None, mode: str = "overwrite") -> DataFrame:
    """Write *df* as Parquet, rows clustered by the first column of *order* and sorted by all, and read it back.

    The rows of a frequent value are split over several tasks.
    """
    spark = df.sparkSession
    if order:
        df = df.hint("rebalance", order[0]).sortWithinPartitions(*order)
    df.write.mode(mode).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, path: str | None = None, order: list[str] | None = None) -> DataFrame:
    """Bucketed by *keys* and sorted by *order* (default: the keys): later joins on them need no exchange on this side."""
    writer = df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*(order or keys)).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def check_schema(df: DataFrame, expected: StructType) -> DataFrame:
    """Raise ``ValueError`` unless names and types agree (nullability aside)."""
    found = [(f.name, f.dataType) for f in df.schema]
    wanted = [(f.name, f.dataType) for f in expected]
    if found != wanted:
        raise ValueError(f"schema {found} is not {wanted}")
    return df


def append_csv(df: DataFrame, path: str) -> None:
    """Append rows to a folder of CSV files with a header."""
    df.coalesce(1).write.mode("append").option("header", True).csv(path)
