"""SimHash near-duplicates through a Gray-order hierarchical index.

Distinct fingerprints within ``RADIUS`` bits agree in one of ``RADIUS + 1`` blocks of bits (pigeonhole),
so each goes to one bucket a block; a bucket with over ``HOT`` fingerprints is dealt again by
blocks of the bits its members don't share by construction.  Inside a bucket the fingerprints are sorted by Gray
rank, which puts those with few differing bits side by side.  Runs of them form nodes; a node
keeps the bits all its members share (mask and pattern), and runs of nodes form upper nodes.  Two
nodes are compared by the differences accumulated on bits both have fixed; beyond the radius the whole
pair of groups is pruned.  A bucket yields a spanning forest of its links, never all pairs.

Cases: a null text has no words; no words give fingerprint zero, linked like any other; words
are split at ASCII white space and only A-Z is lower-cased; repeated rows share a fingerprint; a null
doc_id takes part and gets the component's id (null only if all are); an empty table gives no
rows; columns other than doc_id and text are ignored, by ``keep_one`` kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import drop, fresh, id_text, prepare, stage
from treeline.llm.components import components, keep_first

RADIUS = 2
SHINGLE = 3
SEED = 42
HOT = 4096
FANOUT = 16
#: Bits of the nine pieces; a block is three of them, a block within a bucket is two of the other six.
PIECES = (8, 7, 7, 7, 7, 7, 7, 7, 7)
SHIFTS = tuple(sum(PIECES[:k]) for k in range(9))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority of the bits of the XXH64 of all word shingles, as an unsigned integer."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    stops = ends[k - 1 :].tolist()
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return id_text(docs).mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each unsigned 64-bit code in Gray order."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


def bit_count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


class GrayIndex:
    """Hierarchical index of several buckets of fingerprints; *bucket* is sorted.  ``order`` has the given places of ``fps``."""

    def __init__(self, bucket: np.ndarray, fps: np.ndarray):
        self.order = order = np.lexsort((gray_rank(fps), bucket))
        self.fps, bucket = fps[order], bucket[order]
        # Level 0 are the fingerprints: all bits fixed.  (mask, pattern, first child, end of children, bucket)
        full = np.full(len(fps), ~np.uint64(0))
        self.levels = [(full, self.fps, None, None)]
        while True:
            mask, pattern, _, _ = self.levels[-1]
            begun = starts(bucket)
            at = np.arange(len(bucket)) - np.repeat(begun, np.diff(np.append(begun, len(bucket))))
            heads = np.flatnonzero(at % FANOUT == 0)
            ends = np.append(heads[1:], len(bucket))
            ones = np.bitwise_and.reduceat(mask & pattern, heads)
            zeros = np.bitwise_and.reduceat(mask & ~pattern, heads)
            self.levels.append((ones | zeros, ones, heads, ends))
            bucket = bucket[heads]
            if len(starts(bucket)) == len(bucket):
                break

    def links(self, radius: int = RADIUS, most: int = 1 << 18, across: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions in ``self.fps`` of one bucket within *radius*, in pieces of bounded size;
        or, *across*, pairs of one position in the first bucket and one in the second."""
        roots = np.arange(len(self.levels[-1][0]))
        stack = [(len(self.levels) - 1, *((roots[:1], roots[1:2]) if across else (roots, roots)))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > most // FANOUT:
                half = len(a) // 2
                stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            mask, pattern, heads, ends = self.levels[level]
            below_mask, below, _, _ = self.levels[level - 1]
            na, nb = ends[a] - heads[a], ends[b] - heads[b]
            sizes = na * nb
            pair = np.repeat(np.arange(len(a)), sizes)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            x, y = heads[a][pair] + at // nb[pair], heads[b][pair] + at % nb[pair]
            ok = (x < y) if level == 1 else (x <= y)
            x, y = x[ok], y[ok]
            near = bit_count((below[x] ^ below[y]) & below_mask[x] & below_mask[y]) <= radius
            x, y = x[near], y[near]
            if level == 1:
                yield x, y
            elif len(x):
                stack.append((level - 1, x, y))

    def forest(self, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, its group's first fingerprint) for all that link to another."""
        parent: dict[int, int] = {}

        def find(i: int) -> int:
            while (p := parent.setdefault(i, i)) != i:
                parent[i] = i = parent[p]
            return i

        for xs, ys in self.links(radius):
            for x, y in zip(xs.tolist(), ys.tolist()):
                a, b = find(x), find(y)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = [i for i in parent if find(i) != i]
        return self.fps[np.array(nodes, np.int64)], self.fps[np.array([find(i) for i in nodes], np.int64)]


def _piece(k: int):
    return F.shiftrightunsigned("fp", SHIFTS[k]).bitwiseAND(F.lit((1 << PIECES[k]) - 1))


def _key(tag: int, pieces: tuple[int, ...]):
    """A bucket's key: which pieces agree, and their values."""
    out = F.lit(tag)
    for k in pieces:
        out = F.shiftleft(out, PIECES[k]).bitwiseOR(_piece(k))
    return out.cast("long")


BLOCKS = ((0, 1, 2), (3, 4, 5), (6, 7, 8))


def _inner_blocks(block: int) -> list[tuple[int, ...]]:
    rest = [k for k in range(9) if k not in BLOCKS[block]]
    return [(*BLOCKS[block], *rest[2 * j : 2 * j + 2]) for j in range(3)]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key; whole buckets are indexed together, the last waits for more."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def index(keys: np.ndarray, fps: np.ndarray):
        # A bucket of one has no pair in it.
        begun = starts(keys)
        sizes = np.repeat(np.diff(np.append(begun, len(keys))), np.diff(np.append(begun, len(keys))))
        keys, fps = keys[sizes > 1], fps[sizes > 1]
        if len(keys):
            a, b = GrayIndex(keys, fps.view(np.uint64)).forest()
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        rows += batch.num_rows
        if rows < 1 << 16 or held[0][0][0] == held[-1][0][-1]:
            continue
        keys, fps = (np.concatenate(x) for x in zip(*held))
        cut = int(np.searchsorted(keys, keys[-1]))
        yield from index(keys[:cut], fps[:cut])
        held, rows = [(keys[cut:], fps[cut:])], len(keys) - cut
    if held:
        yield from index(*(np.concatenate(x) for x in zip(*held)))


def link_components(spark: SparkSession, distinct: DataFrame) -> DataFrame:
    """``(fp, root)`` of all linked fingerprints among *distinct* (column fp)."""
    first = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(b).alias("block"), _key(b + 1, BLOCKS[b]).alias("key")) for b in range(3)])).alias("k")).select("fp", "k.block", "k.key")
    first = stage(spark, first, "buckets")
    hot = stage(spark, first.groupBy("key").count().where(F.col("count") > HOT).select("key"), "hot-buckets")
    keyed = first.select("key", "fp")
    if not hot.isEmpty():
        inner = F.array(*[F.struct(F.lit(b).alias("own"), _key(16 + 4 * b + j, p).alias("sub")) for b in range(3) for j, p in enumerate(_inner_blocks(b))])
        again = first.join(hot, "key").select("fp", "block", F.explode(inner).alias("k")).where("k.own = block").select(F.col("k.sub").alias("key"), "fp")
        keyed = first.join(hot, "key", "left_anti").select("key", "fp").union(again)
    # Fewer keys than rows matter only where two meet, so both sides are dealt by key once.
    edges = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_forests, "a long, b long")
    roots = components(spark, edges)
    drop(spark, first, hot)
    return roots.select(F.col("node").alias("fp"), "root")


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable over links, for every row."""
    prepare(spark)
    fps = stage(spark, fingerprints(docs, shingle), "fingerprints")
    least = stage(spark, fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fps")
    roots = link_components(spark, least.select("fp"))
    linked = least.join(roots, "fp")
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(ids, "root").select("fp", "component_id")
    # A table, so that the rows of a frequent fingerprint are split over tasks of the last join.
    names = stage(spark, least.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "fp-names")
    drop(spark, least)
    return fps.join(names, "fp").select("doc_id", "fp", "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Exactly one row of *docs* for each component: the least by doc_id (null last), hash of the text and row."""
    prepare(spark)
    row = fresh(docs, "_row")
    rows = stage(spark, docs.withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    fps = stage(spark, fingerprints(rows.select(F.col(row).alias("doc_id"), "text"), shingle).toDF("row", "fp"), "fingerprints")
    roots = link_components(spark, fps.select("fp").distinct())
    named = fps.join(roots, "fp", "left").select("row", F.coalesce("root", "fp").alias("root"))
    out = keep_first(spark, rows, row, named)
    drop(spark, fps, roots)
    return out
