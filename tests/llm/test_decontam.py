import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from treeline.llm.decontam import ItemIndex, build_indexes, contaminated, finder, keep, stride_of, word_hash
from treeline.llm.queries import op1_decontamination

OUTER = string.punctuation + "«»“”‘’„…–—¿¡"


def words_of(text):
    return [w for w in (x.lower().strip(OUTER) for x in (text or "").split()) if w]


def halves(text):
    """Question and answer: the last sentence, or of one sentence the last quarter."""
    parts = [w for w in map(words_of, re.split(r"(?<=[.!?])\s+", text or "")) if w]
    if len(parts) > 1:
        return sum(parts[:-1], []), parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - max(1, len(words) // 4)
    return words[:cut] or words, words[cut:]


def grams(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


class Brute:
    """BM25 by its formula, every passage against every item, no index and no bound."""

    def __init__(self, items):
        self.items = [(i, *halves(t)) for i, t in items if words_of(t)]
        every = [q if q == a else q + a for _, q, a in self.items]
        df = Counter(w for own in every for w in set(own))
        n, average = len(every), sum(map(len, every)) / max(1, len(every))
        self.weights, self.strides = [], []
        for own in every:
            idf = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for w in own}
            bm25 = {w: idf[w] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / average)) for w, tf in Counter(own).items()}
            self.weights.append({w: v / sum(bm25.values()) for w, v in bm25.items()})
            stride = 64
            while stride < len(own):
                stride *= 2
            self.strides.append(stride)
        self.holders = {}
        for k, weights in enumerate(self.weights):
            for w in weights:
                self.holders.setdefault(w, []).append(k)

    def find(self, text):
        words, best = words_of(text), {}
        for stride in set(self.strides):
            for at in range(0, len(words), stride):
                part = words[at : at + 2 * stride]
                scores = Counter()
                for w in set(part):
                    for k in self.holders.get(w, ()):
                        if self.strides[k] == stride:
                            scores[k] += self.weights[k][w]
                for k, score in scores.items():
                    score = round(score, 9)
                    if score >= 0.6:
                        overlaps = []
                        for own in self.items[k][1:]:
                            n = min(3, len(own))
                            overlaps.append(len(grams(own, n) & grams(part, n)) / len(grams(own, n)))
                        if min(overlaps) >= 0.5:
                            best[k] = max(best.get(k, (0,)), (score, *overlaps))
        return sorted(((self.items[k][0], *(round(x, 6) for x in v)) for k, v in best.items()), key=str)


def brute_find(brute, text):
    return {x[0] for x in brute.find(text)}


def index_of(items):
    """For other tests: what finds the items of a text by brute force."""
    return Brute(items)


def built(items):
    words = [w for w in (words_of(t) for _, t in items) if w]
    df = Counter(word_hash(w) for own in words for w in set(own))
    return ItemIndex(items, df, len(words), sum(map(len, words)) / max(1, len(words)))


class Shared:
    def __init__(self, value):
        self.value = value


def found(frame):
    return sorted((str(r.doc_id), str(r.item_id), round(r.score, 6), round(r.question_overlap, 6), round(r.answer_overlap, 6)) for r in frame.collect())


def wanted(brute, rows):
    return sorted((str(d), str(x[0]), *x[1:]) for d, t in rows for x in brute.find(t))


def test_whole_table(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = found(op1_decontamination(spark, sf_dir))
    assert got == wanted(Brute(items), docs)
    squashed = {d: " ".join((t or "").split()) for d, t in docs}
    assert {(str(d), str(i)) for d, t in squashed.items() for i, x in items if " ".join(x.split()) in t} <= {x[:2] for x in got}
    assert 0 < len({x[0] for x in got}) < 0.2 * len(docs)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.floats(0.05, 0.95))
def test_wand_retrieves_all_above_the_threshold(seed, threshold):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice((3, 9, 25, 70))))) for i in range(80)]
    index, brute = built(items), Brute(items)
    words = rng.sample(vocabulary, 30)
    terms = index.terms_of(np.array([word_hash(w) for w in words]))
    got = {index.items[i]: s for i, s in index.wand(np.unique(terms[terms >= 0]), None, threshold)}
    want = {brute.items[k][0]: sum(own.get(w, 0) for w in words) for k, own in enumerate(brute.weights)}
    assert {i for i, s in want.items() if s >= threshold + 1e-8} <= set(got) <= {i for i, s in want.items() if s >= threshold - 1e-8}
    assert all(abs(want[i] - s) < 1e-8 for i, s in got.items())


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.booleans())
def test_search_equals_brute_force(seed, sparse):
    """Items of several strides, texts that hold parts of them, all texts in one go."""
    from treeline.llm import decontam

    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(900)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, f"{text(rng.choice((4, 12, 40, 90, 200)))}. {text(rng.randint(1, 12))}.") for i in range(60)]
    texts = []
    for _ in range(25):
        own = [text(rng.randint(0, 150))]
        for _, t in rng.sample(items, 2):
            words = t.split()
            at = rng.randint(0, len(words) // 3)
            own += [" ".join(words[at : len(words) - rng.randint(0, len(words) // 4)]), text(rng.randint(0, 60))]
        texts.append(" ".join(own))
    texts += ["", None, "...", "w1"]
    brute, cells = Brute(items), decontam.CELLS
    decontam.CELLS = 1 if sparse else cells
    try:
        got = finder([Shared(built(items))])(texts)
    finally:
        decontam.CELLS = cells
    assert [sorted(((x[0], *(round(v, 6) for v in x[1:])) for x in own), key=str) for own in got] == [brute.find(t) for t in texts]


AWKWARD_WORDS = random.Random(5)
VOCABULARY = ["".join(AWKWARD_WORDS.choices("abcdefghij", k=5)) for _ in range(3000)]


def awkward():
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choices(VOCABULARY, k=n))
    items = [(i, f"{text(25)}. {text(8)}.") for i in range(40)] + [(90, None), (91, "..."), (92, "One"), (None, text(30)), (95, text(700) + ". " + text(9))]
    items += [items[7], (96, items[8][1])]
    question_only = items[4][1].split(". ")[0]
    rows = [(1, None), (2, ""), (3, text(400)), (4, text(301) + " " + items[7][1].upper() + text(9000)), (5, items[7][1]), (5, items[7][1]), (6, question_only + " " + text(90)), (None, items[9][1]), (7, text(60) + items[3][1] + text(40) + " " + items[5][1]), (8, items[8][1] + " one"), (9, text(300) + items[44][1]), (10, items[43][1])]
    return items, rows


def test_awkward_rows(spark):
    items, rows = awkward()
    docs = spark.createDataFrame([(a, b, "x", 1.0) for a, b in rows], "doc_id long, text string, item_id string, score double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = wanted(Brute(items), rows)
    pairs = [x[:2] for x in want]
    assert pairs.count(("4", "7")) == 2 and pairs.count(("5", "7")) == 4 and ("None", "9") in pairs and ("9", "95") in pairs and ("10", "None") in pairs and not any(d in "1236" for d, _ in pairs)
    assert found(contaminated(spark, docs, bench)) == want
    kept = keep(spark, docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 6]
    assert contaminated(spark, docs, bench.limit(0)).count() == 0 and contaminated(spark, docs.limit(0), bench).count() == 0
    assert keep(spark, docs, bench.limit(0)).count() == len(rows)


def test_shards_change_nothing(spark):
    items, rows = awkward()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    total = sum(len(words_of(t)) for _, t in items)
    assert len(list(build_indexes(spark, bench, -(-total // 7)))) == 7
    want = wanted(Brute(items), rows)
    for words in (-(-total // 7), 40):
        assert found(contaminated(spark, docs, bench, words)) == want
        assert sorted(r.doc_id for r in keep(spark, docs, bench, words).collect()) == [1, 2, 3, 6]


@pytest.mark.parametrize("others", [[], [40_000], [900, 70, 3]])
def test_what_is_found_does_not_hang_on_other_items(others):
    """One long item beside a short one once made the passages, and so the answer, another."""
    rng = random.Random(1)
    item = " ".join(rng.choices(VOCABULARY, k=30))
    words = item.split()
    text = " ".join(rng.choices(VOCABULARY, k=5000) + words[:22] + rng.choices(VOCABULARY, k=200) + words[22:] + rng.choices(VOCABULARY, k=5000))
    items = [(1, item)] + [(k, " ".join(f"{k}x{rng.randrange(9**6)}" for _ in range(n))) for k, n in enumerate(others, 2)]
    got = finder([Shared(built(items))])([text, item])
    assert [[x[0] for x in own] for own in got] == [[], [1]] and not brute_find(Brute(items), text)
    assert [stride_of(n) for n in (1, 64, 65, 128, 129, 40_000)] == [64, 64, 128, 128, 256, 65536]
