from collections import defaultdict

import numpy as np

import corpus_pipeline
from tests.llm.test_decontam import brute_find, index_of
from tests.llm.test_linededup import brute
from tests.llm.test_neardup import brute_kept
from tests.llm.test_packing import check_layout
from treeline.llm import langid
from treeline.llm.common import vocabulary
from treeline.llm.queries import WORD_VOCABULARY

STAGES = dict(corpus_pipeline.STAGES)


def test_each_stage_against_brute_force(spark, sf_dir, tmp_path):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    whole = {r.doc_id: r for r in docs.collect()}

    def next_stage(name):
        nonlocal docs
        STAGES[name](spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        return docs.collect()

    got = next_stage("language_id")
    model = langid.fit(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert docs.columns == columns
    assert {r.doc_id for r in got} == {d for d, r in whole.items() if not model.predict([r.text])[0][2]}

    before = got
    got = next_stage("line_dedup")
    assert docs.columns == columns and {r.doc_id: r.text for r in got} == brute([(r.doc_id, r.text) for r in before])
    assert all(r.n_chars == len(r.text) for r in got)

    before = got
    got = next_stage("near_dedup")
    want = brute_kept([(r.doc_id, r.text) for r in before])
    assert docs.columns == columns and sorted(r.doc_id for r in got) == sorted(before[i].doc_id for i in want)

    before = got
    got = next_stage("decontamination")
    index = index_of([tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()])
    assert docs.columns == columns and {r.doc_id for r in got} == {r.doc_id for r in before if not brute_find(index, r.text)}
    assert len(got) > 0.5 * len(whole)

    before = got
    got = next_stage("packing")
    check_layout(got, 2048)
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(vocabulary(WORD_VOCABULARY)), defaultdict(list)
    for p in got:
        own[p.doc_id].append(p)
    for r in before:
        ids = b"".join(bytes(p.ids) for p in sorted(own.pop(r.doc_id), key=lambda p: p.start))
        assert np.frombuffer(ids, "<u4").tolist() == [*library.encode(r.text, add_special_tokens=False).ids, 1]
    assert not own

    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, got))


def test_nulls_and_empty_tables(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, "text without an id", "en", "a", 3), (2, "", "en", None, 0), (2, "", "en", None, 0)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, function in corpus_pipeline.STAGES:
            docs = function(spark, docs, sf_dir)
            docs.collect()


def test_long_texts_ties_and_clashing_columns(spark, sf_dir):
    """Columns with the names the operators use inside, a very long text, equal rows and ids: every stage runs and keeps the columns."""
    taken = "_kept_id _row _rank _key _cuts row node root place first fp hash n keys band a b queue part before base ids rank key cuts body lang_pred score rejected n_lines item_id value doc".split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in taken)
    clean = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en' and length(text) > 300").orderBy("doc_id").limit(12).collect()]
    rows = [(k % 9, t, "en", "a" if k % 3 else None, len(t)) for k, t in enumerate(clean)] + [(3, clean[0], "en", "a", 5)] * 3
    rows += [(50, " ".join(clean) * 40, "en", "b", 1), (None, clean[1], "en", "b", 1), (51, "line\nline\n" * 3000 + clean[2], "en", "a", 0)]
    docs = spark.createDataFrame([(*r, *taken) for r in rows], schema)
    columns = docs.columns
    for name, function in corpus_pipeline.STAGES:
        before = docs.count()
        docs = spark.createDataFrame(function(spark, docs, sf_dir).collect(), function(spark, docs, sf_dir).schema)
        if name != "packing":
            assert docs.columns == columns and 0 < docs.count() <= before
            assert all(tuple(r)[5:] == tuple(taken) for r in docs.collect())
    assert docs.count()
