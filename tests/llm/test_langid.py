import math
import zlib
from collections import Counter

import numpy as np

from treeline.llm import langid
from treeline.llm.queries import op6_language_id


def test_held_out_accuracy(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").collect()}
    got = op6_language_id(spark, sf_dir.replace("sf0.001", "sf0.01")).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)
    assert sum(r.rejected for r in got) <= 0.02 * len(got)


def test_awkward_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(spark, docs)
    german = docs.where("lang = 'de' and length(text) > 400").orderBy("doc_id").first().text
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "the "), (5, german * 200), (5, german * 200), (None, "日本語" * 50), (6, "zqx jkv wvq " * 30)]
    extra = spark.createDataFrame([(a, b, "x", True) for a, b in rows], "doc_id long, text string, lang_pred string, rejected boolean")
    got = {r.doc_id: r for r in langid.predict(spark, extra, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].rejected
    assert got[5].lang_pred == "de" and got[4].lang_pred == "en"
    assert got[None].rejected and got[6].rejected and not got[5].rejected
    kept = langid.keep(spark, extra, model)
    assert kept.columns == extra.columns and {r.doc_id for r in kept.collect()} == {4, 5}
    assert langid.predict(spark, extra.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = langid.fit(spark, docs)
    assert [tuple(r) for r in langid.predict(spark, docs, model).collect()] == [(1, "und", 0.0, True)]


def brute_vector(text, idf):
    """TF-IDF of hashed byte trigrams, unit length, one trigram at a time."""
    raw = [b if b >= 128 or chr(b).isalpha() else 32 for b in b"  " + text.lower().encode("utf-8", "replace") + b"  "]
    counts = Counter()
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        if b != 32:
            counts[((a * 40503 ^ b * 12289 ^ c * 271) * 2654435761 % 2**32) >> 19] += 1
    vector = {k: math.log(1 + n) * float(idf[k]) for k, n in counts.items()}
    length = math.sqrt(sum(v * v for v in vector.values()))
    return {k: v / length for k, v in vector.items()}, sum(counts.values())


def test_verdicts_against_brute_force(spark, sf_dir):
    """Cosine with every centroid, nearest one, rejection by distance."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(spark, docs)
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-4) and max(Counter(model.owner.tolist()).values()) <= langid.CLUSTERS
    texts = [r.text for r in docs.orderBy("doc_id").limit(120).collect()] + ["a", "zq zq", "Ωμέγα " * 9, "x" * 5000]
    for text, (lang, score, rejected) in zip(texts, model.predict(texts)):
        vector, n = brute_vector(text, model.idf)
        cosines = [sum(float(c[k]) * v for k, v in vector.items()) for c in model.centroids]
        best = max(cosines)
        assert abs(score - best) < 1e-4
        near = [i for i, c in enumerate(cosines) if c > best - 1e-5]
        own = [(model.languages[model.owner[i]], model.floors[model.owner[i]] * math.sqrt(n / (n + langid.SHORT))) for i in near]
        assert any(lang == x for x, _ in own)
        if all(abs(best - floor) > 1e-4 for _, floor in own):
            assert any(lang == x and rejected == (best < floor) for x, floor in own)


def test_model_against_brute_force(spark, sf_dir):
    """Document frequencies of the sample, here all rows, and the centroid of a language with one cluster."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null and length(text) > 0").orderBy("doc_id").limit(60)
    model = langid.fit(spark, docs, sample=10**6, clusters=1)
    rows = [(r.lang, r.text) for r in docs.collect()]
    flat = np.ones(langid.FEATURES)
    held = Counter(k for _, t in rows for k in brute_vector(t, flat)[0])
    idf = {k: math.log((1 + len(rows)) / (1 + n)) + 1 for k, n in held.items()}
    assert all(abs(model.idf[k] - v) < 1e-4 for k, v in idf.items()) and model.languages == sorted({x for x, _ in rows})
    for lang, centroid in zip(model.languages, model.centroids):
        total = np.zeros(langid.FEATURES)
        for own, text in rows:
            if own == lang:
                for k, v in brute_vector(text, model.idf)[0].items():
                    total[k] += v
        assert np.allclose(centroid, total / np.linalg.norm(total), atol=1e-4)


def test_number_signs_are_no_letters(spark, sf_dir):
    model = langid.fit(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert [p[0] for p in model.predict(["½ ² ①", "Ⅷ", "12_3", "٣", "", None])] == ["und"] * 6
    assert model.predict(["½ é"])[0][0] != "und"


def test_every_language_is_learned_and_ties_go_to_the_first(spark):
    rows = [(k, " ".join("abcdefghij"[int(c)] * 3 for c in f"{k:04d}") * 6, f"l{k:04d}") for k in range(2000)]
    docs = spark.createDataFrame(rows + [(9000 + i, "same text here", x) for i, x in enumerate(("zb", "za"))], "doc_id long, text string, lang string")
    model = langid.fit(spark, docs)
    assert model.languages == sorted({r[2] for r in rows} | {"za", "zb"})
    assert model.predict(["same text here"])[0][0] == "za"
    got = model.predict([r[1] for r in rows[1990:]])
    assert sum(g[0] == r[2] for g, r in zip(got, rows[1990:])) >= 5


def test_repeated_rows_are_sampled_once(spark):
    docs = spark.createDataFrame([(1, "le chat noir", "fr")] * 500 + [(2, "the black cat", "en")], "doc_id long, text string, lang string")
    once = langid.fit(spark, docs.distinct(), sample=10**6)
    assert np.array_equal(langid.fit(spark, docs, sample=10**6).centroids, once.centroids)
