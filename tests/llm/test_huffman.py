import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from treeline.llm import huffman
from treeline.llm.common import vocabulary
from treeline.llm.queries import WORD_VOCABULARY, op2_huffman_ids


def expected(rows):
    from tokenizers import Tokenizer

    library, out, start = Tokenizer.from_file(vocabulary(WORD_VOCABULARY)), [], 0
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table_matches_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert sorted(map(tuple, op2_huffman_ids(spark, sf_dir).collect())) == sorted(expected(docs))


def test_awkward_rows(spark, tmp_path):
    rows = [(5, None), (3, ""), (9, "a <|endoftext|> b\tc d\x1ce  é ́x\n\nIt's 12 ΣΑΣ"), (4, "word " * 30000), (None, "no id"), (7, "日本" * 500)]
    docs = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, ids int, start string")
    huffman.write_ids(spark, docs, str(tmp_path / "set"), vocabulary(WORD_VOCABULARY), 2)
    got = sorted((r.start, r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in huffman.read_ids(spark, str(tmp_path / "set")).collect())
    want = expected(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert got == [(s, d, n, c) for d, s, n, c in want]


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    huffman.write_ids(spark, docs, str(tmp_path / "set"), vocabulary(WORD_VOCABULARY), 2)
    assert huffman.read_ids(spark, str(tmp_path / "set")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=3000), st.integers(9, 20))
def test_code_round_trip(ids, limit):
    ids = np.array(ids) ** 2 // 400
    lengths = huffman.code_lengths(np.bincount(ids), limit)
    assert lengths.max() <= limit and (0.5 ** lengths[lengths > 0].astype(float)).sum() <= 1
    payload, starts = huffman.pack_bits(ids, huffman.canonical(lengths), lengths)
    (back,) = huffman.unpack_bits([payload], [starts[:: huffman.CHECKPOINT]], [len(ids)], huffman.decode_table(lengths))
    assert back.tolist() == ids.tolist()


def test_lengths_are_optimal_without_a_tight_limit():
    import heapq

    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 0, 4])
    heap, cost = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert int((huffman.code_lengths(counts, 20) * counts).sum()) == cost


def test_repeated_rows_and_many_files(spark, tmp_path):
    rows = [(1, "same text")] * 400 + [(1, "other")] * 3 + [(None, "none"), (2, "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    huffman.write_ids(spark, docs, str(tmp_path / "set"), vocabulary(WORD_VOCABULARY), 2)
    got = sorted(huffman.read_ids(spark, str(tmp_path / "set"), digest=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] + [1] * 403 + [2]
    want = {(d, n, c) for d, _, n, c in expected(rows)}
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    codes = {r.id: r.n for r in spark.read.parquet(str(tmp_path / "set/codes")).collect()}
    assert sum(codes.values()) == at
