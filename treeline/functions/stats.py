"""Fan-outs of relations, measured and estimated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def measured_fanout(pairs: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: distinct pairs, lefts and rights of ``(l, r)`` and the average fan-out each way.

    Pairs are made distinct once and then grouped from either side, each group partly where it is read;
    *approximate* counts by sketches instead of exactly.
    """
    if approximate:
        count = F.approx_count_distinct
        row = pairs.agg(count(F.struct("l", "r")).alias("pairs"), count(F.col("l")).alias("lefts"), count(F.col("r")).alias("rights"))
    else:
        once = pairs.select("l", "r").distinct()
        rights = once.groupBy("r").agg(F.lit(1).alias("one")).agg(F.count("*"))
        row = once.groupBy("l").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.count("*").alias("lefts")).select("*", rights.scalar().alias("rights"))
    return row.select("*", (F.col("pairs") / F.nullif(F.col("lefts"), F.lit(0))).alias("n_rgl"), (F.col("pairs") / F.nullif(F.col("rights"), F.lit(0))).alias("n_lgr"))


def estimated_fanout(tuples: float, lefts: float, rights: float) -> float:
    """Expected distinct rights of a left when *tuples* pairs are drawn uniformly with replacement."""
    return rights * (1 - (1 - 1 / rights) ** (tuples / lefts))


def estimated_fanout_column(tuples, lefts, rights):
    """The same over columns."""
    return rights * (1 - F.pow(1 - 1 / rights, tuples / lefts))


def min_max_normalised(df: DataFrame, column: str) -> DataFrame:
    """*column* mapped to 0..1; null where all values are equal."""
    low, high = (df.agg(end(column)).scalar() for end in (F.min, F.max))
    return df.withColumn(column, (F.col(column) - low) / F.nullif(high - low, F.lit(0)))


def sample_index(u: Column, weights: list[float]) -> Column:
    """The index drawn by *u* (0 to 1) from a multinomial with *weights*, which need not sum to 1."""
    total, upto, out = sum(weights), 0.0, None
    for k, w in enumerate(weights[:-1]):
        upto += w / total
        out = F.when(u < F.lit(upto), F.lit(k)) if out is None else out.when(u < F.lit(upto), F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(len(weights) - 1))
