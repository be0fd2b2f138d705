"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept.  All but
the last return the columns of ``documents``.  Between stages the documents are a Parquet table in
the session's shared folder.  Rows without a doc_id and repeated rows go through every stage as
the operators' docstrings say; an empty table yields no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import decontam, langid, linededup, neardup, packing
from treeline.llm.common import drop, prepare, read, stage, vocabulary
from treeline.llm.queries import WORD_VOCABULARY


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labelled documents; those too far from every language go."""
    return langid.keep(spark, docs, langid.fit(spark, docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that came before go; n_chars follows the text."""
    out = linededup.dedup_lines(spark, docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by a similarity of 0.8 of five-word shingles stays, the one with the smallest doc_id."""
    return neardup.keep_one(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.keep(spark, docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their ids, the sources in proportion in every window."""
    return packing.pack(spark, docs, vocabulary(WORD_VOCABULARY), end_id=1)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack_sequences),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of *sf_dir*."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        after = stage(spark, function(spark, docs, sf_dir), name)
        drop(spark, docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
