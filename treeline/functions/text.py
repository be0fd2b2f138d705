"""Text functions and the inverted index, all built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """Trim white space and turn runs of it into one blank."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s{2,}", " ")


def split_literal(c: Column, delimiter: str) -> Column:
    """Split at a literal delimiter; empty pieces stay."""
    return F.split(c, re.escape(delimiter))


def keep_rule_characters(c: Column) -> Column:
    """Only letters, underscores, parentheses and commas."""
    return F.regexp_replace(c, r"[^A-Za-z_(),]", "")


def tokens(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``(k, d, p)``: token, document and 0-based position.  Null texts have none."""
    return docs.select(F.col(doc).alias("d"), F.posexplode(F.split(clean(F.col(text)), r"\s")).alias("p", "k")).select("k", "d", F.col("p").cast("long").alias("p"))


def inverted_index(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(k, d, p, mult)`` with multiplicities, for documents given more than once.

    Texts are dealt by document, which is all the grouping of their tokens needs: the one exchange moves texts, not tokens."""
    return tokens(docs.select(doc, text).repartition(F.col(doc)), doc, text).groupBy("k", "d", "p").agg(F.count("*").alias("mult"))


def tags(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(d, tag, value)`` of every ``#tag{value}``."""
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(#\w+\{[^}]*\})"), 1))
    one = docs.select(F.col(doc).alias("d"), found.alias("m"))
    return one.select("d", F.regexp_extract("m", r"#(\w+)\{([^}]*)\}", 1).alias("tag"), F.regexp_extract("m", r"#(\w+)\{([^}]*)\}", 2).alias("value"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, text)``: one line, one document, numbered from 1 in the order of files (by path) and lines.

    Files are read in splits; the lines of each are counted, and a line's number is its place in its split
    after the lines of all splits before.  An empty line is an empty document.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    # A row for each split.
    splits = splits.select("file", "block", "first", (F.sum("n").over(Window.orderBy("file", "block")) - F.col("n")).alias("before"))
    return lines.join(splits, ["file", "block"]).select((F.col("before") + F.col("at") - F.col("first") + 1).alias("doc_id"), F.col("value").alias("text"))


def normalise(weights: list[float]) -> list[float]:
    """Non-negative weights scaled to sum 1."""
    total = sum(weights)
    if total < 1e-5 or min(weights) < 0:
        raise ValueError("weights need a positive sum and no negative value")
    return [w / total for w in weights]
