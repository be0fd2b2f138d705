"""Connected components of a large graph by repeated contraction, and what stays of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import drop, stage, text_key


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of *edges* (``a``, ``b``, long); one root a component.

    Each round sends every node to its least neighbour (or itself) in an order drawn by a hash,
    so the expected number of nodes falls by a constant factor; the round's map is kept, and the
    maps are chained at the end.  All states are tables in the shared folder.
    """
    edges = stage(spark, edges.select("a", "b").where("a <> b").distinct(), "cc-edges")
    maps: list[DataFrame] = []
    salt = 0
    while not edges.isEmpty():
        salt += 1
        key = F.struct(F.xxhash64("b", F.lit(salt)).alias("h"), F.col("b").alias("v"))
        both = edges.union(edges.select("b", "a")).union(edges.select("a", "a")).union(edges.select("b", "b")).toDF("a", "b")
        least = stage(spark, both.groupBy("a").agg(F.min(key).alias("m")).select(F.col("a").alias("node"), F.col("m.v").alias("to")), "cc-map")
        left = edges.join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b").where("x <> y")
        less = stage(spark, left.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "cc-edges")
        drop(spark, edges)
        edges = less
        maps.append(least)
    drop(spark, edges)
    if not maps:
        return spark.createDataFrame([], "node long, root long")
    out = maps[0].toDF("node", "root")
    for step in maps[1:]:
        out = out.join(step.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    out = stage(spark, out, "cc-roots")
    drop(spark, *maps)
    return out


def keep_first(spark: SparkSession, rows: DataFrame, row: str, named: DataFrame) -> DataFrame:
    """The rows of *rows* (doc_id, text, the row number *row* and others) that come first in their group, all columns but *row*.

    *named* has ``row`` and ``root``, the row's group.  First is the least doc_id (null last), then a hash of the text,
    then the row number, so exactly one row of a group stays whatever repeats.
    """
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), text_key(), F.col(row)).alias("place")
    both = stage(spark, named.join(rows.select(F.col(row).alias("row"), place), "row"), "group-rows")
    first = stage(spark, both.groupBy("root").agg(F.min("place").alias("first"), F.count("*").alias("times")).where("times > 1").select("root", "first"), "group-firsts")
    gone = stage(spark, both.join(first, "root").where("place <> first").select(F.col("row").alias(row)), "group-gone")
    drop(spark, both, first)
    return rows.join(gone, row, "left_anti").drop(row)
