"""Benchmark decontamination: a BM25 index of the test items, searched by block-max WAND.

Every passage of every training text is a query against the items.  An item of n words is sought in passages of 2 s words
that begin every s words, s being the least power of two from ``STRIDE`` on that is n or more: it fits whole into one
of them, and which passages it meets follows from the item alone.  An item's BM25 weights are divided by their sum,
so a passage scores the share of the item's weight that its words carry, and ``THRESHOLD`` means the same for all items.

Items lie in blocks of ``BLOCK`` of like length.  An item's rarest terms that carry ``ESSENTIAL`` of its weight are essential; a term's list
has the blocks in which it is that, with its largest weight there.  A passage can reach the threshold only in blocks where these
maxima and the largest weight left to other terms do so together; blocks on no list of its words are never looked at.
In the blocks that remain, WAND goes through the postings of all the passage's terms, from pivot to pivot.  Every item found is
verified: the passage must hold ``OVERLAP`` of the word trigrams of its question and of its answer (its last
sentence or, with one sentence only, its last quarter).

Words are 64-bit hashes.  Items are dealt into shards of about ``SHARD_WORDS`` words, which bounds what is broadcast and
what a worker or the driver holds at a time; a text is split once and meets all shards in one pass.  Document frequencies are those of
the whole benchmark, so how it is sharded changes no result.

Cases: null or empty texts and items without words match nothing; words are lower-cased and stripped of
outer punctuation; an empty benchmark finds nothing; repeated items are each reported, repeated
documents each; an item's id may be null; documents of any length are searched whole; other columns are ignored, by ``keep`` kept.
"""

from __future__ import annotations

import math
import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.cache import Cache
from treeline.llm.common import drop, id_text, prepare, stage

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.5
STRIDE = 64
BLOCK = 4
ESSENTIAL = 0.8
#: Rounding of the bounds' sums.
SLACK = 1e-4
SHARD_WORDS = 2_000_000
#: Words and half passages that are looked at together, and sums that are held as a table for them.
CHUNK_WORDS, HALVES, CELLS = 1 << 18, 1 << 12, 1 << 22
#: Words in one of the two generations of a worker's cache of hashes.
CACHE_WORDS = 100_000
OUTER = string.punctuation + "«»“”‘’„…–—¿¡"
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def normal(word: str) -> str:
    return word.lower().strip(OUTER)


def words_of(text: str | None) -> list[str]:
    return [w for w in map(normal, (text or "").split()) if w]


def word_hash(word: str) -> int:
    """Hash of a word as it is written, signed; 0 if it is but punctuation."""
    if not (word := normal(word)):
        return 0
    h = xxhash.xxh64_intdigest(word.encode("utf-8", "replace")) or 1
    return h - (1 << 64) if h >> 63 else h


def question_answer(text: str | None) -> tuple[list[str], list[str]]:
    """Words of an item's question and of its answer."""
    parts = [w for w in map(words_of, SENTENCE.split(text or "")) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - max(1, len(words) // 4)
    return words[:cut] or words, words[cut:]


def item_words(question: list, answer: list) -> list:
    """All words of an item; one of one word is its own question and answer."""
    return question if question == answer else question + answer


def stride_of(n: int) -> int:
    """Words between the passages in which an item of *n* words is sought."""
    return max(STRIDE, 1 << (n - 1).bit_length())


def grams(ids: list[int], n: int) -> set[tuple[int, ...]]:
    return {tuple(ids[i : i + n]) for i in range(len(ids) - n + 1)}


@dataclass
class Level:
    """Essential lists of the blocks from *first* on, whose items have one stride: term t has entries at[t] to at[t + 1]."""

    stride: int
    first: int
    rest: np.ndarray
    at: np.ndarray
    block: np.ndarray
    most: np.ndarray

    def candidates(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(text, begin, end, blocks) of the passages that may hold an item; *ids* of several texts (-1: no term)."""
        at = np.flatnonzero(ids >= 0)
        at = at[self.at[ids[at] + 1] > self.at[ids[at]]]
        if not len(at):
            return
        known, text = ids[at], np.searchsorted(starts, at, side="right") - 1
        # Half passages are numbered through all texts, with a spare one after each.
        spans = -(-sizes // self.stride) + 1
        base = np.cumsum(spans) - spans
        half = base[text] + (at - starts[text]) // self.stride
        # Where each word stood last: only its first place in a passage counts.
        order = np.argsort(known, kind="stable")
        last = np.full(len(at), -2)
        same = known[order[1:]] == known[order[:-1]]
        last[order[1:][same]] = half[order[:-1][same]]
        own, lead = last < half, (last < half - 1) & (half > base[text])
        for begun in range(0, int(half[-1]) + 1, HALVES):
            a, c, b = np.searchsorted(half, (begun, begun + HALVES, begun + HALVES + 1))
            mine = a + np.flatnonzero(own[a:c])
            next_ = a + np.flatnonzero(lead[a:b])
            next_ = next_[half[next_] > begun]
            row = np.concatenate([half[mine], half[next_] - 1]) - begun
            passages, blocks = self._reaching(row, np.concatenate([known[mine], known[next_]]))
            for p in np.unique(passages).tolist():
                doc = int(np.searchsorted(base, begun + p, side="right")) - 1
                first = int(starts[doc] + (begun + p - base[doc]) * self.stride)
                yield doc, first, min(first + 2 * self.stride, int(starts[doc] + sizes[doc])), self.first + blocks[passages == p]

    def _reaching(self, row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) whose bound reaches the threshold, from the distinct *term* of each passage *row*."""
        begun, n = self.at[term], self.at[term + 1] - self.at[term]
        at = np.repeat(begun - np.cumsum(n) + n, n) + np.arange(n.sum())
        width, goal = len(self.rest), THRESHOLD - SLACK
        key = np.repeat(row, n) * width + self.block[at]
        if HALVES * width <= CELLS:
            bound = np.bincount(key, self.most[at], HALVES * width).reshape(HALVES, width)
            return np.nonzero(bound + self.rest >= goal)
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
        bound = np.add.reduceat(self.most[at][order], heads) if len(key) else key
        key = key[heads]
        key = key[bound + self.rest[key % width] >= goal]
        return key // width, key % width


class ItemIndex:
    """Index of one shard of items; *frequency* (by word hash), *count* and *average* describe the whole benchmark."""

    def __init__(self, items: list[tuple[int | None, str]], frequency: dict[int, int], count: int, average: float):
        split = [(i, *([word_hash(w) for w in part] for part in question_answer(t))) for i, t in items]
        split = sorted((x for x in split if x[2]), key=lambda x: (len(item_words(x[1], x[2])), x[0] is not None, x[0] or 0))
        self.items = [x[0] for x in split]
        words = [item_words(q, a) for _, q, a in split]
        self.vocabulary = np.array(sorted({w for own in words for w in own}), np.int64)
        number = {w: k for k, w in enumerate(self.vocabulary.tolist())}
        self.part = np.array([number[w] for _, q, a in split for w in (*q, *a)], np.int32)
        self.part_at = np.cumsum([0, *(len(x) for _, q, a in split for x in (q, a))])

        terms, weights, shown = [], [], []  # of all items: term, weight, whether it is essential
        self.item_at, rest = [0], []
        for own in words:
            norm = K1 * (1 - B + B * len(own) / average)
            weight = {}
            for w, tf in Counter(own).items():
                df = frequency[w]
                weight[w] = math.log(1 + (count - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + norm)
            total, held = sum(weight.values()), 0.0
            essential = set()
            for w in sorted(weight, key=lambda w: (frequency[w], w)):
                if held >= ESSENTIAL:
                    break
                held += weight[w] / total
                essential.add(w)
            rest.append(max(0.0, 1 - held))
            for w in sorted(weight):
                terms.append(number[w])
                weights.append(weight[w] / total)
                shown.append(w in essential)
            self.item_at.append(len(terms))
        self.item_at = np.array(self.item_at)
        self.term, self.weight = np.array(terms, np.int32), np.array(weights)
        self.owner = np.repeat(np.arange(len(words)), np.diff(self.item_at))

        # Blocks hold items of one stride.
        strides = np.array([stride_of(len(own)) for own in words], np.int64)
        self.block_at, self.levels = [], []
        for stride in np.unique(strides).tolist():
            a, b = np.searchsorted(strides, (stride, stride + 1)).tolist()
            first, heads = len(self.block_at), list(range(a, b, BLOCK))
            self.block_at += heads
            rows = np.arange(self.item_at[a], self.item_at[b])
            rows = rows[np.array(shown, bool)[rows]]
            key = self.term[rows].astype(np.int64) * len(heads) + (self.owner[rows] - a) // BLOCK
            order = np.lexsort((-self.weight[rows], key))
            key, most = key[order], self.weight[rows][order]
            top = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, most = key[top], most[top]
            at = np.searchsorted(key // len(heads), np.arange(len(self.vocabulary) + 1))
            left = np.maximum.reduceat(np.array(rest[a:b]), np.array(heads) - a)
            self.levels.append(Level(stride, first, left, at, key % len(heads), most))
        self.block_at = np.array([*self.block_at, len(words)])

    def parts(self, item: int) -> tuple[list[int], list[int]]:
        """Question and answer of an item, as terms."""
        a, b, c = self.part_at[2 * item : 2 * item + 3].tolist()
        return self.part[a:b].tolist(), self.part[b:c].tolist()

    def terms_of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def wand(self, terms: np.ndarray, blocks: np.ndarray | None = None, threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """Items of *blocks* (ascending; default: all) whose score over *terms* (ascending, distinct) reaches *threshold*."""
        blocks = np.arange(len(self.block_at) - 1) if blocks is None else blocks
        if not len(blocks) or not len(terms):
            return []
        rows = np.concatenate([np.arange(self.item_at[self.block_at[b]], self.item_at[self.block_at[b + 1]]) for b in blocks.tolist()])
        own = self.term[rows]
        rows = rows[terms[np.minimum(np.searchsorted(terms, own), len(terms) - 1)] == own]
        # A term's postings in these blocks: items, weights, and by block the largest weight.
        postings: dict[int, tuple[list[int], list[float], dict[int, float]]] = {}
        owners = self.owner[rows]
        of_block = np.searchsorted(self.block_at, owners, side="right") - 1
        for t, i, w, b in zip(self.term[rows].tolist(), owners.tolist(), self.weight[rows].tolist(), of_block.tolist()):
            places, weights, most = postings.setdefault(t, ([], [], {}))
            places.append(i)
            weights.append(w)
            most[b] = max(most.get(b, 0.0), w)
        cursors = [[0, places, weights, most, max(weights)] for places, weights, most in postings.values()]
        goal, found = threshold - SLACK, []
        while cursors:
            cursors.sort(key=lambda c: c[1][c[0]])
            bound = 0.0
            for pivot, c in enumerate(cursors):
                bound += c[4]
                if bound >= goal:
                    break
            else:
                break
            item = cursors[pivot][1][cursors[pivot][0]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][1][cursors[pivot + 1][0]] == item:
                pivot += 1
            upto = cursors[: pivot + 1]
            block = int(np.searchsorted(self.block_at, item, side="right")) - 1
            if sum(c[3].get(block, 0.0) for c in upto) >= goal:
                target = item
                if upto[0][1][upto[0][0]] == item:
                    score = round(sum(c[2][c[0]] for c in upto), 9)  # the same in whatever order it is summed
                    if score >= threshold:
                        found.append((item, score))
                    target = item + 1
            else:
                # No item of this block can reach the threshold with these terms; the next one's
                # cursor may stand inside it, so go no further than that.
                target = int(self.block_at[block + 1])
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][1][cursors[pivot + 1][0]])
            for c in upto:
                c[0] = bisect_left(c[1], target, c[0])
            cursors = [c for c in cursors if c[0] < len(c[1])]
        return found

    def find(self, hashes: np.ndarray, sizes: list[int]) -> list[list[tuple]]:
        """For each of several texts, whose words follow each other, (item, score, question overlap, answer overlap) of
        verified items, the best passage of each."""
        ids, sizes = self.terms_of(hashes), np.array(sizes, np.int64)
        starts = np.cumsum(sizes) - sizes
        best: list[dict[int, tuple]] = [{} for _ in sizes]
        for level in self.levels:
            for text, a, b, blocks in level.candidates(ids, starts, sizes):
                part = ids[a:b]
                got = self.wand(np.unique(part[part >= 0]), blocks)
                words = part.tolist() if got else []
                held: dict[int, set] = {}
                for item, score in got:
                    overlaps = []
                    for own in self.parts(item):
                        n = min(3, len(own))
                        if n not in held:
                            held[n] = grams(words, n)
                        wanted = grams(own, n)
                        overlaps.append(len(wanted & held[n]) / len(wanted))
                    if min(overlaps) >= OVERLAP:
                        best[text][item] = max(best[text].get(item, (0.0, 0.0, 0.0)), (score, *overlaps))
        return [[(self.items[i], *v) for i, v in sorted(x.items())] for x in best]


def build_indexes(spark: SparkSession, benchmark: DataFrame, shard_words: int = SHARD_WORDS) -> Iterator[ItemIndex]:
    """One index a shard; the driver holds one shard's items at a time."""
    prepare(spark)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [[word_hash(w) for w in words_of(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(h) for h in hashes], pa.int64()), pa.array([sorted(set(h)) for h in hashes], pa.list_(pa.int64()))], ["deal", "n", "terms"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.withColumn("deal", F.xxhash64("item_id", "text"))
    terms = stage(spark, items.select("deal", "text").mapInArrow(split, "deal long, n long, terms array<long>").where("n > 0"), "item-terms")
    count, total = terms.agg(F.count("*"), F.sum("n")).first()
    if count:
        frequency = stage(spark, terms.select(F.explode("terms").alias("term")).groupBy("term").count(), "item-frequencies")
        shards = -(-total // shard_words)
        for k in range(shards):
            mine = F.pmod("deal", F.lit(shards)) == k
            wanted = terms.where(mine).select(F.explode("terms").alias("term")).distinct()
            known = dict(map(tuple, frequency.join(wanted, "term", "left_semi").collect()))
            yield ItemIndex([tuple(r) for r in items.where(mine).select("item_id", "text").collect()], known, count, total / count)
        drop(spark, frequency)
    drop(spark, terms)


def finder(shards: list[Broadcast]) -> Callable[[list[str | None]], list[list[tuple]]]:
    """A worker's search of texts in all shards: for each text what :meth:`ItemIndex.find` says."""
    hash_of = Cache(word_hash, CACHE_WORDS).__getitem__

    def find(texts: list[str | None]) -> list[list[tuple]]:
        chunks: list[tuple[int, list[np.ndarray]]] = []
        size = 0
        for k, text in enumerate(texts):
            words = (text or "").split()
            own = np.fromiter(map(hash_of, words), np.int64, len(words))
            own = own[own != 0]
            if not chunks or size + len(own) > CHUNK_WORDS:
                chunks.append((k, []))
                size = 0
            chunks[-1][1].append(own)
            size += len(own)
        out: list[list[tuple]] = [[] for _ in texts]
        for shared in shards:
            index = shared.value
            for first, hashes in chunks:
                for k, found in enumerate(index.find(np.concatenate(hashes), [len(h) for h in hashes]), first):
                    out[k] += found
            if len(shards) > 1:
                del index
                vars(shared).pop("_value", None)  # a worker holds one shard at a time
        return out

    return find


def _shared(spark: SparkSession, benchmark: DataFrame, shard_words: int) -> list[Broadcast]:
    return [spark.sparkContext.broadcast(index) for index in build_indexes(spark, benchmark, shard_words)]


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: a row for each item in a document."""
    shards = _shared(spark, benchmark, shard_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(shards)
        for batch in batches:
            rows = [(d, *f) for d, found in zip(batch.column(0).to_pylist(), find(batch.column(1).to_pylist())) for f in found]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.float64()) for k, c in enumerate(columns)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return id_text(docs).mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")


def keep(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of *docs* that hold no item, all columns as they are."""
    at = docs.columns.index("text")
    shards = _shared(spark, benchmark, shard_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(shards)
        for batch in batches:
            yield batch.filter(pa.array([not found for found in find(batch.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
