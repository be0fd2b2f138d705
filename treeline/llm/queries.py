"""Registered queries of the corpus operators: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import decontam, huffman, langid, linededup, packing, prefixcount, quality, secretscan, simhash, substring
from treeline.llm.common import read, vocabulary
from treeline.sources.storage import scratch_path

WORD_VOCABULARY = "word_bpe_49k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    huffman.write_ids(spark, read(spark, sf_dir, "documents"), path, vocabulary(WORD_VOCABULARY), end_id=2)
    return huffman.read_ids(spark, path, digest=True)


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(spark, read(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(spark, read(spark, sf_dir, "documents"), digest=True)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = langid.fit(spark, docs.where(~held_out))
    return langid.predict(spark, docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op7_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(spark, read(spark, sf_dir, "documents"))


def op8_drr_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, read(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY), end_id=1, digest=True)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(spark, docs, linededup.free_chunks).select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def op10_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixcount.count_tokens(spark, read(spark, sf_dir, "documents"), vocabulary(PIECE_VOCABULARY), limit=4096)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_huffman_ids, op3_simhash_groups, op4_secret_spans, op5_substring_dedup, op6_language_id, op7_quality_bands, op8_drr_packing, op9_line_dedup, op10_prefix_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op5_substring_dedup": substring.ORACLE, "op9_line_dedup": linededup.ORACLE}
