import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from treeline.llm import substring
from treeline.llm.queries import op5_substring_dedup
from treeline.llm.substring import SuffixAutomaton, anchors, covered, dedup_substrings


def brute(rows):
    """(doc_id, n_words, n_removed, kept) of rows with unique ids; null ids last."""
    seen, out = set(), []
    for d, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(window)
        out.append((d, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def test_whole_table(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, op5_substring_dedup(spark, sf_dir).collect()))
    assert got == [(d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in brute(docs)]
    assert sum(r[2] for r in got) > 0
    duckdb.sql(f"create or replace view documents as select * from '{sf_dir}/documents.parquet'")
    assert duckdb.sql(f"select doc_id, n_words, n_removed, kept_sha256 from ({substring.ORACLE}) order by doc_id").fetchall() == got


def test_awkward_rows(spark, monkeypatch):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(90)) for _ in range(n))
    one, two = text(60), text(45)
    loop = "a b c " * 4000
    rows = [(9, one), (3, f"{text(5)} {one} {text(9)} {two}"), (4, f"{one} {one}\n{two}"), (5, None), (6, " \t\n"), (7, loop), (8, loop + one), (1, " ".join(one.split()[:19])), (2, " ".join(one.split()[7:27])), (None, two + " x"), (10, "É\x1c " * 25), (11, "É\x1c " * 30)]
    docs = spark.createDataFrame([(a, b, 1, "k", "r") for a, b in rows], "doc_id long, text string, n_words int, key string, rank string")
    want = sorted(brute(rows), key=str)
    assert sorted(map(tuple, dedup_substrings(spark, docs).collect()), key=str) == want
    twice = docs.where("doc_id = 9").union(docs.where("doc_id = 9"))
    assert [(r.n_words, r.n_removed, r.kept) for r in dedup_substrings(spark, twice).collect()] == [(60, 0, one)] * 2
    assert dedup_substrings(spark, docs.limit(0)).count() == 0
    monkeypatch.setattr(substring, "SHARD_WORDS", 30)
    monkeypatch.setattr(substring, "SPAN", 3)
    assert sorted(map(tuple, dedup_substrings(spark, docs).collect()), key=str) == want


def test_many_documents_share_a_passage(spark):
    rng = random.Random(4)
    word = lambda: "w" + str(rng.randrange(400))
    passage = [word() for _ in range(50)]
    rows = []
    for d in range(300):
        own = [word() for _ in range(rng.randrange(60))]
        at = rng.randrange(len(own) + 1)
        part = passage[rng.randrange(6) : 50 - rng.randrange(6)] if d % 3 == 0 else []
        rows.append((d, " ".join(own[:at] + part + own[at:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, dedup_substrings(spark, docs).collect())) == brute(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.lists(st.sampled_from("abc"), max_size=60), st.integers(1, 8))
def test_automaton_finds_first_places(reference, text, least):
    automaton = SuffixAutomaton()
    automaton.extend(reference, 0)
    first = {}
    for i in range(len(reference) - least + 1):
        first.setdefault(tuple(reference[i : i + least]), i + least - 1)
    want = [(i + least - 1, first[tuple(text[i : i + least])]) for i in range(len(text) - least + 1) if tuple(text[i : i + least]) in first]
    assert list(automaton.matches(text, least)) == want


def test_equal_windows_have_equal_anchors():
    rng = random.Random(1)
    words = [b"%d" % rng.randrange(50) for _ in range(100)]
    assert anchors([b"x", b"y", *words])[0][2:].tolist() == anchors(words)[0].tolist()
    gone = covered([(5, words)], [(1 << 8, words[10:40])], 8)[5]
    assert gone.tolist() == [10 <= i < 40 for i in range(100)]


def test_window_hashes_are_those_of_the_words_alone():
    rng = random.Random(7)
    words = [b"%d" % rng.randrange(9) for _ in range(200)]
    own = substring.word_hashes(words)
    for n in (1, 5, 6, 20):
        for shifts in (substring.SHIFTS, substring.CHECKS):
            whole = substring.rolled(own, n, shifts)
            assert len(whole) == 200 - n + 1
            assert all(np.array_equal(substring.rolled(own[i : i + n], n, shifts), whole[i : i + 1]) for i in range(len(whole)))
    assert not np.array_equal(substring.rolled(own, 20), substring.rolled(own, 20, substring.CHECKS))


def test_windows_that_share_a_hash_are_told_apart(spark):
    rng = random.Random(9)
    word = lambda: "w" + str(rng.randrange(300))
    passages = [[word() for _ in range(30)] for _ in range(20)]
    rows = []
    for d in range(80):
        own = [word() for _ in range(rng.randrange(40))]
        for part in rng.sample(passages, 2):
            at = rng.randrange(len(own) + 1)
            own[at:at] = part[rng.randrange(5) :]
        rows.append((d, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(d, g, k) for d, _, g, k in brute(rows) if g}
    for hash_bits in (64, 6):
        got = {(r["rank"], r.n_removed, r.kept) for r in substring.repeated_words(spark, docs, hash_bits).collect() if r.n_removed}
        assert got == want


def test_a_batch_hashes_each_word_once(monkeypatch):
    asked = []

    class Counting:
        @staticmethod
        def xxh64_intdigest(word, seed):
            asked.append(word)
            return xxhash.xxh64_intdigest(word, seed)

    monkeypatch.setattr(substring, "xxhash", Counting)
    words = [f"{k:03}" * 30 for k in range(40)]  # longer than what a cache would keep
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([0, 0, 0]), pa.array([" ".join(words), " ".join(words[::-1]), None])], ["rank", "key", "text"])
    (out,) = substring._anchor_runs(iter([batch]))
    assert len(asked) == 40
    assert {r["rank"] for r in out.to_pylist()} == {1, 2}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from("abß日 \t\n\v\f\r\x1c\x85\xa0"), max_size=30), max_size=6))
def test_hashes_of_a_batch(texts):
    batch = pa.array(["x y", *texts, " z"], pa.string())
    for given_as, of in ((batch, ["x y", *texts, " z"]), (batch.slice(1, len(texts)), texts)):
        got = substring.text_hashes(given_as)
        assert [h.tolist() for h in got] == [substring.word_hashes(substring.split(t)).tolist() for t in of]
