"""Substring dedup by suffix automata of reference shards and matching statistics.

A window is ``WINDOW`` words of one document; a word goes if some window over it has the words of
a window that starts earlier (smaller doc_id, or earlier in the same document).

Streaming every document past an automaton of the whole corpus would take time in the square of the corpus, so the
corpus is first narrowed to what can repeat, by hashes.  Anchors can only let too much pass.  Windows that differ and share their 96 bits
could hide a repeat behind an earlier window; in 1e13 windows there is one such pair with probability 0.0006.

1. Every window has an anchor, the least hash among the ``GRAM``-word grams in it; equal windows have equal
   anchors.  Only documents with anchors that occur twice go on, with their runs of such windows.
2. Of those windows, the hashes that occur twice are found with their first places.
3. The words around the first places are the reference.  It is dealt into shards: documents with later
   places are dealt into buckets, and a bucket's shard holds just the reference passages its documents ask for,
   about ``SHARD_WORDS`` words.  The task of a bucket builds the shard's suffix automaton and streams
   the bucket's documents through it.  Where the matching statistic reaches the window's length, the automaton
   gives the place in the reference; if that is earlier, the window's words go.  Words, not hashes, decide.

Places are numbers: a document's rank times ``2 ** bits`` plus the word's position.

Cases: null and blank texts have no words; texts of any length are read whole; null doc_ids come
last; rows with the same doc_id are ordered by a hash of the text, rows equal in both are one document;
an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm.common import drop, prepare, stage, text_key

WINDOW = 20
GRAM = 6
SHARD_WORDS = 40_000
LAST = (1 << 63) - 1
#: What so many buckets ask of one document is listed together.
SPAN = 64
#: By a run's length: what its predecessor's hash is multiplied by; the second kind is for windows' check bits.
SHIFTS, CHECKS = ({1 << k: np.uint64(pow(m, 1 << k, 1 << 64)) for k in range(12)} for m in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))


def split(text: str | None) -> list[bytes]:
    """Words, which ASCII white space parts."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(7)), np.uint64, len(words))


def text_hashes(texts: pa.Array) -> list[np.ndarray]:
    """``word_hashes(split(text))`` of every text, each distinct word of the batch hashed once."""
    trimmed = pc.ascii_trim_whitespace(texts)
    # A null has no words, while an empty text would have an empty one.
    words = pc.ascii_split_whitespace(pc.if_else(pc.equal(trimmed, ""), pa.scalar(None, trimmed.type), trimmed))
    coded = words.flatten().dictionary_encode()
    own = word_hashes(coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
    ends = words.offsets.to_numpy().tolist()
    return [own[a:b] for a, b in zip(ends, ends[1:])]


def rolled(words: np.ndarray, n: int, shifts: dict[int, np.uint64] = SHIFTS) -> np.ndarray:
    """Hashes of all runs of *n* words from the words' hashes, by doubling: a run's hash follows from those of its parts."""
    power = words  # of runs of 1, 2, 4, ... words
    size, done, out = 1, 0, None
    while size <= n:
        if n & size:
            if out is None:
                out = power
            else:
                count = len(words) - done - size + 1
                out = out[: max(0, count)] * shifts[size] + power[done : done + max(0, count)]
            done += size
        if 2 * size <= n:
            power = power[:-size] * shifts[size] + power[size:]
        size *= 2
    out = out[: max(0, len(words) - n + 1)]
    out = out ^ (out >> np.uint64(29))
    return out * np.uint64(0xBF58476D1CE4E5B9)


def anchors(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of every window, and the hashes of grams that the text holds twice."""
    return hash_anchors(word_hashes(words), window, gram)


def hash_anchors(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """:func:`anchors` from the words' hashes."""
    grams = rolled(hashes, gram)
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    least, have, want = grams, 1, window - gram + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least, twice


def runs_of(values: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of the runs in which *values* (and *more*) stay the same."""
    change = np.ones(len(values), bool)
    change[1:] = values[1:] != values[:-1]
    for v in more:
        change[1:] |= v[1:] != v[:-1]
    begun = np.flatnonzero(change)
    return begun, np.diff(np.append(begun, len(values)))


class SuffixAutomaton:
    """Automaton of a sequence of words; ``first[state]`` is where its words first end."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first, self.last = [-1], [0], [-1], 0

    def extend(self, words: list, at: int) -> None:
        nxt, link, length, first, last = self.next, self.link, self.length, self.first, self.last
        for at, w in enumerate(words, at):
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            first.append(at)
            link.append(0)
            p = last
            while p >= 0 and w not in (own := nxt[p]):
                own[w] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    first.append(first[q])
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(w) == q:
                        nxt[p][w] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        self.last = last

    def matches(self, words: list, least: int) -> Iterator[tuple[int, int]]:
        """(end, where it first ends in the automaton) of every match of *least* words."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        state = have = 0
        for at, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                have = length[state]
            to = nxt[state].get(w)
            if to is None:
                continue
            state, have = to, have + 1
            if have >= least:
                # Longer matches are cut back to the window: that keeps the state of its words.
                while length[link[state]] >= least:
                    state = link[state]
                have = least
                yield at, first[state]


def covered(docs: list[tuple[int, list[bytes]]], passages: list[tuple[int, list[bytes]]], bits: int, window: int = WINDOW) -> dict[int, np.ndarray]:
    """Which words go of each document of a bucket, by matching statistics against its *passages*."""
    marks = {d: np.zeros(len(w) + 1, np.int32) for d, w in docs}
    passages.sort(key=lambda p: p[0])
    merged: list[tuple[int, list[bytes]]] = []
    for place, words in passages:
        # All windows of both are first places, so passages that overlap by a window less one word join.
        if merged and place <= merged[-1][0] + len(merged[-1][1]) - window + 1 and place >> bits == merged[-1][0] >> bits:
            merged[-1][1].extend(words[merged[-1][0] + len(merged[-1][1]) - place :])
        else:
            merged.append((place, list(words)))
    at = 0
    while at < len(merged):
        automaton, places, size = SuffixAutomaton(), [], 0
        while at < len(merged) and (not size or size + len(merged[at][1]) <= 2 * SHARD_WORDS):
            place, words = merged[at]
            # A separator that no text holds keeps passages apart.
            automaton.extend([*words, at], size)
            places += range(place, place + len(words) + 1)
            size, at = size + len(words) + 1, at + 1
        for d, words in docs:
            mark, base = marks[d], d << bits
            for end, where in automaton.matches(words, window):
                begin = end - window + 1
                if places[where - window + 1] < base + begin:
                    mark[begin] += 1
                    mark[end + 1] -= 1
    return {d: np.cumsum(m[:-1]) > 0 for d, m in marks.items()}


def _anchor_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["value", "rank", "key", "start", "n", "times"]
    for batch in batches:
        parts: list[list] = [[] for _ in names]
        for rank, key, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_hashes(batch.column(2))):
            if len(words) < WINDOW:
                continue
            values, twice = hash_anchors(words)
            begun, sizes = runs_of(values)
            # Windows of one run can be equal to each other if its anchor stands at two places.
            times = 1 + np.isin(values[begun], twice) if len(twice) else np.ones(len(begun))
            for part, v in zip(parts, (values[begun].view(np.int64), np.full(len(begun), rank), np.full(len(begun), key), begun, sizes, times)):
                part.append(v)
        if parts[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p).astype(np.int64)) for p in parts], names)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part)), pa.array(np.arange(at, at + n))], [*batch.schema.names, "part", "place"])
        at += n


def _windows(bits: int, hash_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, checks, places = [], [], []
            lists = batch.column(2).offsets.to_numpy()
            runs = batch.column(2).values
            starts, sizes = (runs.field(k).to_numpy() for k in ("start", "n"))
            for doc, words, a, b in zip(batch.column(0).to_pylist(), text_hashes(batch.column(1)), lists, lists[1:]):
                own, check = rolled(words, WINDOW).view(np.int64), rolled(words, WINDOW, CHECKS)
                change = np.zeros(len(own) + 1, np.int32)
                np.add.at(change, starts[a:b], 1)
                np.add.at(change, starts[a:b] + sizes[a:b], -1)
                at = np.flatnonzero(np.cumsum(change[:-1]))
                hashes.append(own[at] >> (64 - hash_bits))
                checks.append((check[at] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                places.append((doc << bits) + at)
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hashes, checks, places)], ["hash", "check", "place"])

    return run


def _later_runs(bits: int):
    """(place, first) sorted by place -> runs in which both go up together: doc, source, source_start, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, first = (c.to_numpy() for c in batch.columns)
            if not len(place):
                continue
            begun, sizes = runs_of(place - np.arange(len(place)), first - place, place >> bits, first >> bits)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (place[begun] >> bits, first[begun] >> bits, first[begun] & ((1 << bits) - 1), sizes)], ["doc", "source", "start", "n"])

    return run


def _merged(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of windows (start, n) with those that meet or overlap put together."""
    begin = end = -1
    for start, n in sorted(spans):
        if start > end:
            if end > begin:
                yield begin, end - begin
            begin = start
        end = max(end, start + n)
    if end > begin:
        yield begin, end - begin


def _passages(bits: int):
    def batch_of(out: list[tuple[int, int, str]]) -> pa.RecordBatch:
        buckets, places, texts = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array([0] * len(out), pa.int32()), pa.array(places, pa.int64()), pa.array(texts, pa.string())], ["bucket", "kind", "id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            # Row by row: what is asked of a hot source is long.
            for k in range(batch.num_rows):
                source, text, wants = (c[k].as_py() for c in batch.columns)
                words, asked = split(text), {}
                for w in wants:
                    asked.setdefault(w["bucket"], []).append((w["start"], w["n"]))
                for bucket, spans in asked.items():
                    for start, n in _merged(spans):
                        out.append((bucket, (source << bits) + start, b" ".join(words[start : start + n + WINDOW - 1]).decode("utf-8", "surrogatepass")))
                        size += len(out[-1][2])
                        if size > 1 << 21:
                            yield batch_of(out)
                            out, size = [], 0
        if out:
            yield batch_of(out)

    return run


def _decide(bits: int):
    def decided(passages, docs):
        gone = covered(docs, passages, bits)
        rows = []
        for d, words in docs:
            own = gone[d]
            rows.append((d, int(own.sum()), b" ".join([w for w, g in zip(words, own.tolist()) if not g]).decode("utf-8", "surrogatepass")))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))], ["doc", "n_removed", "kept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, passages, docs = None, [], {}
        for batch in batches:
            for b, kind, i, text in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket:
                    if docs:
                        yield decided(passages, list(docs.items()))
                    bucket, passages, docs = b, [], {}
                if kind:
                    docs[i] = split(text)
                else:
                    passages.append((i, split(text)))
        if docs:
            yield decided(passages, list(docs.items()))

    return run


def repeated_words(spark: SparkSession, docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """rank, key, n_removed and kept (text) of the documents that lose words; fewer *hash_bits* change no result."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("rank"), text_key().alias("key"), F.col("text").cast("string").alias("text"))
    found = stage(spark, rows.mapInArrow(_anchor_runs, "value long, rank long, key long, start long, n long, times long"), "anchors")
    again = found.groupBy("value").agg(F.sum("times").alias("times")).where("times > 1").select("value")
    again = stage(spark, again, "anchors-again")  # as a table, so that a frequent anchor's rows are split over tasks of the join
    runs = found.join(again, "value").groupBy("rank", "key").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs = stage(spark, runs, "anchor-runs")
    ordered = stage(spark, runs.select("rank", "key").repartitionByRange(ranges, "rank", "key").sortWithinPartitions("rank", "key").mapInArrow(_number, "rank long, key long, part long, place long"), "doc-places")
    sizes = ordered.groupBy("part").count()
    bases = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("base"))  # a row for each range
    numbers = stage(spark, ordered.join(F.broadcast(bases), "part").select("rank", "key", (F.col("base") + F.col("place")).alias("doc")), "doc-numbers")
    longest = runs.select(F.explode("runs").alias("r")).agg(F.max(F.col("r.start") + F.col("r.n"))).first()[0]
    bits = max(8, int(longest or 0).bit_length() + 1)
    texts = rows.join(runs.join(numbers, ["rank", "key"]), ["rank", "key"]).dropDuplicates(["rank", "key"])
    texts = stage(spark, texts.select("doc", "text", "runs"), "repeat-texts")
    drop(spark, found, again, runs, ordered)

    windows = stage(spark, texts.select("doc", "text", "runs").mapInArrow(_windows(bits, hash_bits), "hash long, check int, place long"), "windows")
    firsts = windows.groupBy("hash").agg(F.min("place").alias("first"), F.max("place").alias("final"), F.min("check").alias("low"), F.max("check").alias("high")).where("first <> final")
    # As a table, so that the join's skewed side can be split.
    firsts = stage(spark, firsts.select("hash", "first", (F.col("low") != F.col("high")).alias("mixed")), "first-windows")
    later = windows.select("hash", "place").join(firsts.where("not mixed").select("hash", "first"), "hash").where("place <> first").select("place", "first")
    mixed = firsts.where("mixed").select("hash")
    if not mixed.isEmpty():  # windows that differ have one hash: their check bits tell them apart
        apart = windows.join(mixed, "hash", "left_semi")
        own = stage(spark, apart.groupBy("hash", "check").agg(F.min("place").alias("first")), "mixed-windows")
        later = later.union(apart.join(own, ["hash", "check"]).where("place <> first").select("place", "first"))
    later = later.withColumn("doc", F.shiftright("place", bits))
    later = later.repartition("doc").sortWithinPartitions("place").select("place", "first").mapInArrow(_later_runs(bits), "doc long, source long, start long, n long")
    later = stage(spark, later, "later-runs")
    drop(spark, windows, firsts)

    total = later.agg(F.sum(F.col("n") + WINDOW - 1)).first()[0] or 0
    buckets = max(1, -(-int(total) // SHARD_WORDS))
    bucket = F.pmod(F.xxhash64("doc"), F.lit(buckets))
    wants = later.select("source", bucket.alias("bucket"), "start", "n").groupBy("source", F.floor(F.col("bucket") / SPAN).alias("span")).agg(F.collect_set(F.struct("bucket", "start", "n")).alias("wants"))
    passages = wants.withColumnRenamed("source", "doc").join(texts.select("doc", "text"), "doc").select("doc", "text", "wants").mapInArrow(_passages(bits), "bucket long, kind int, id long, text string")
    asking = texts.join(later.select("doc").distinct(), "doc").select(bucket.alias("bucket"), F.lit(1).alias("kind"), F.col("doc").alias("id"), "text")
    dealt = passages.union(asking).repartition("bucket").sortWithinPartitions("bucket", "kind", "id")
    done = stage(spark, dealt.mapInArrow(_decide(bits), "doc long, n_removed long, kept string"), "repeat-decisions")
    out = done.join(numbers, "doc").select("rank", "key", "n_removed", "kept")
    drop(spark, texts, later)
    return out


def dedup_substrings(spark: SparkSession, docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by blanks) or with *digest* its sha256."""
    prepare(spark)
    changed = repeated_words(spark, docs)
    name = "kept_sha256" if digest else "kept"
    value = F.sha2("kept", 256) if digest else F.col("kept")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split_texts = [split(t) for t in batch.column(3).to_pylist()]
            joined = [b" ".join(w) for w in split_texts]
            values = [hashlib.sha256(j).hexdigest() for j in joined] if digest else [j.decode("utf-8", "surrogatepass") for j in joined]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(w) for w in split_texts], pa.int64()), pa.array(values, pa.string())], ["doc_id", "rank", "key", "n_words", "own"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("rank"), text_key().alias("key"), F.col("text").cast("string").alias("text"))
    whole = rows.mapInArrow(words, "doc_id long, rank long, key long, n_words long, own string")
    joined = whole.join(changed.select("rank", "key", "n_removed", value.alias("other")), ["rank", "key"], "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("other", "own").alias(name))


#: Every window as a list of words; the first of equal ones stays.
ORACLE = r"""
with d as (select doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] as w from documents),
w as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d),
g as (select *, list(word) over (partition by doc_id order by i rows between current row and 19 following) as win from w),
r as (select doc_id, i, word, len(win) = 20 and row_number() over (partition by win order by doc_id, i) > 1 as again from g),
c as (select *, bool_or(again) over (partition by doc_id order by i rows between 19 preceding and current row) as gone from r)
select d.doc_id, count(c.i) as n_words, count(*) filter (where gone) as n_removed,
       sha256(coalesce(string_agg(word, ' ' order by i) filter (where not gone), '')) as kept_sha256
from d left join c on d.doc_id = c.doc_id group by d.doc_id
"""
