"""Language ID by nearest centroid over TF-IDF vectors of hashed byte trigrams.

``fit`` learns from a bounded sample: about ``SAMPLE`` labelled rows in all, dealt evenly over the
languages and chosen by a hash, but ``LEAST`` of each language.  Every language has its place in the model, however many
there are.  Each gets up to ``CLUSTERS`` centroids by spherical k-means, one for every ``LEAST // 2`` rows at most, so the model that
is broadcast has at most as many vectors of ``FEATURES`` floats.  A text takes the language of the centroid with the largest cosine.  The text is rejected if its
distance to it is beyond what training texts show: cosine under ``SLACK`` times the language's
first percentile, scaled down for texts with few trigrams.

Cases: a null text or one without a letter (a character of Unicode's letter categories; number signs are none) is ``und`` and rejected; texts are read whole; ties
go to the first centroid in order of language; repeated rows are predicted alike; an empty
training table yields a model that says ``und`` to everything; columns besides doc_id, text and
lang are ignored by ``predict`` and kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import drop, id_text, prepare, stage

FEATURES = 8192
SAMPLE = 1600
LEAST = 16
CLUSTERS = 4
SLACK = 0.4
SHORT = 60
#: Bytes that are not letters become blanks; UTF-8 lead and continuation bytes stay.
FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed trigrams over lower-cased UTF-8, (texts, FEATURES)."""
    raws = [b"  " + t.lower().encode("utf-8", "replace") + b"  " for t in texts]
    data = FOLD[np.frombuffer(b"".join(raws), np.uint8)].astype(np.uint32)
    row = np.repeat(np.arange(len(raws)), [len(r) for r in raws])
    # The two blanks at each end keep trigrams that span texts down to blanks in the middle.
    code = (data[:-2] * 40503 ^ data[1:-1] * 12289 ^ data[2:] * 271) * np.uint32(2654435761) >> np.uint32(19)
    ok = data[1:-1] != 32
    return np.bincount(row[1:-1][ok] * FEATURES + code[ok], minlength=len(raws) * FEATURES).reshape(len(raws), FEATURES).astype(np.float32)


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floors: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected) of each text."""
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        if not self.languages:
            return out
        live = [i for i, t in enumerate(texts) if has_letter(t)]
        for at in range(0, len(live), 128):
            part = live[at : at + 128]
            counts = trigram_counts([texts[i] for i in part])
            cosines = tfidf(counts, self.idf) @ self.centroids.T
            best = cosines.argmax(axis=1)
            sizes = counts.sum(axis=1)
            for i, b, c, n in zip(part, best, cosines[np.arange(len(part)), best], sizes):
                lang = self.owner[b]
                # Rounded, as the last bits depend on which texts share a batch.
                score = round(min(1.0, max(0.0, float(c))), 5)
                out[i] = (self.languages[lang], score, score < self.floors[lang] * float(np.sqrt(n / (n + SHORT))))
        return out


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; deterministic."""
    seeds = [int((x @ x.mean(axis=0)).argmax())]
    while len(seeds) < k:
        seeds.append(int((x @ x[seeds].T).max(axis=1).argmin()))
    c = x[seeds]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def fit(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS) -> Model:
    """Learn from the text and non-null lang of *docs*: about *sample* rows, ``LEAST`` a language at least."""
    prepare(spark)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id")).where("text is not null and lang is not null")
    sizes = stage(spark, rows.groupBy("lang").count(), "languages")
    share = F.lit(max(LEAST, sample // max(1, sizes.count()))) / F.col("count")
    roll = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = rows.join(sizes, "lang").where(roll < share)
    empty = Model([], np.zeros(FEATURES, np.float32), np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(0))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                counts = trigram_counts(part.column(0).to_pylist())
                packed = [(np.flatnonzero(c).astype("<u2").tobytes(), c[c > 0].astype("<u4").tobytes()) for c in counts]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())], ["lang", "at", "n"])

    # Rows that repeat count once: else the sample would grow with their number.
    chosen = chosen.dropDuplicates(["lang", "doc_id", "text"]).select("text", "lang")
    got = sorted((tuple(r) for r in chosen.mapInArrow(features, "lang string, at binary, n binary").collect()), key=lambda r: (r[0], bytes(r[1]), bytes(r[2])))
    drop(spark, sizes)
    got = [(lang, np.frombuffer(at, "<u2"), np.frombuffer(n, "<u4")) for lang, at, n in got if at]
    if not got:
        return empty
    held = np.zeros(FEATURES, np.int64)
    by_lang: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for lang, at, n in got:
        held[at] += 1
        by_lang.setdefault(lang, []).append((at, n))
    idf = (np.log((1 + len(got)) / (1 + held)) + 1).astype(np.float32)
    languages, centroids, owner, floors = list(by_lang), [], [], []
    for i, texts in enumerate(by_lang.values()):
        counts = np.zeros((len(texts), FEATURES), np.float32)
        for k, (at, n) in enumerate(texts):
            counts[k, at] = n
        own, size = tfidf(counts, idf), counts.sum(axis=1)
        c = _kmeans(own, max(1, min(clusters, 2 * len(own) // LEAST)))
        floors.append(SLACK * float(np.percentile((own @ c.T).max(axis=1) / np.sqrt(size / (size + SHORT)), 1)))
        centroids.append(c.astype(np.float32))
        owner += [i] * len(c)
    return Model(languages, idf, np.concatenate(centroids), np.array(owner), np.array(floors))


def predict(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # CLUSTERS vectors of FEATURES floats a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = shared.value.predict(batch.column(1).to_pylist())
            columns = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "lang_pred", "score", "rejected"])

    return id_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """The rows of *docs* that are not rejected, all columns as they are."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = shared.value.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([not g[2] for g in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
