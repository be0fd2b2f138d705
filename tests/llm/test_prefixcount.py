import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from treeline.llm.common import vocabulary
from treeline.llm.prefixcount import PrefixCounter, answer, count_tokens, counts_of, fitting, prefix_tables, total_of
from treeline.llm.queries import PIECE_VOCABULARY, op10_prefix_token_counts

MODEL = vocabulary(PIECE_VOCABULARY)


@pytest.fixture(scope="module")
def own():
    return PrefixCounter(MODEL)


def test_whole_table_matches_the_library(spark, sf_dir, own):
    docs = {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = op10_prefix_token_counts(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        n = len(own.library.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)


TEXT = st.text(st.one_of(st.sampled_from(" \n\t▁abcestnhré日😀0<>"), st.characters(codec="utf-8")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_every_prefix(own, text):
    table = counts_of(own.steps(text))
    assert len(table) == len(text) + 1 and total_of(own.steps(text)) == table[-1]
    for i in range(len(text) + 1):
        assert table[i] == len(own.library.encode(text[:i]))


@settings(max_examples=300, deadline=None)
@given(st.one_of(TEXT, st.lists(st.sampled_from(["there", "\nthan", "日本", "x😀y", "ations"]), max_size=8).map(" ".join)), st.integers(0, 30))
def test_longest_fitting_prefix(own, text, budget):
    assert fitting(own.steps(text), budget) == max(i for i in range(len(text) + 1) if len(own.library.encode(text[:i])) <= budget)


def test_tables_of_real_texts(spark, sf_dir, own):
    """Stored tables at places all over each text; they answer every budget without the texts."""
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = prefix_tables(spark, docs, MODEL)
    for r in tables.collect():
        text, counts = texts[r.doc_id], counts_of(r.steps)
        assert len(counts) == len(text) + 1 and r.n_bytes == len(text.encode())
        for i in {0, 1, len(text) // 3, len(text) // 2, len(text) - 1, len(text)}:
            assert counts[i] == len(own.library.encode(text[:i]))
    for limit in (50, 700):
        for r in answer(spark, tables, limit).collect():
            text = texts[r.doc_id]
            assert r.over_limit == (r.n_tokens > limit) and len(own.library.encode(text[: r.fit_chars])) <= limit
            assert r.over_limit or r.fit_chars == len(text)


def test_awkward_rows(spark, own):
    rows = [(1, None), (2, ""), (3, "  <s> </s> <unk>\n\n  x "), (4, "ab" * 40000), (5, "a b " * 5000), (5, "a b " * 5000), (None, "x")]
    docs = spark.createDataFrame([(a, b, 3) for a, b in rows], "doc_id long, text string, n_tokens int")
    got = count_tokens(spark, docs, MODEL, 100).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(a), len(own.library.encode(b or ""))) for a, b in rows)
    for r in got:
        text = next(b or "" for a, b in rows if a == r.doc_id)
        assert len(own.library.encode(text[: r.fit_chars])) <= 100
        assert r.fit_chars == len(text) or len(own.library.encode(text[: r.fit_chars + 1])) > 100
    assert counts_of(prefix_tables(spark, docs.where("doc_id = 3"), MODEL).first().steps)[-1] == len(own.library.encode(rows[2][1]))
    assert count_tokens(spark, docs.limit(0), MODEL, 5).count() == 0
