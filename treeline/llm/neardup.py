"""Near-duplicates of the pipeline: Jaccard similarity of word shingles, verified exactly.

A 64-bit SimHash of texts at similarity 0.8 differs in some ten bits, up to twenty, too many for blocks of
bits that agree.  Buckets are therefore bands of a MinHash signature: ``BANDS`` keys of ``ROWS`` minima each, one
of which two texts at similarity s share with probability ``1 - (1 - s ** ROWS) ** BANDS`` (0.9998 at 0.8).
Inside a small bucket, and between two parts of a large one, the Gray-order index (:class:`GrayIndex`) finds the pairs within
``RADIUS`` bits of their SimHash; those of too different sizes are left out.  The members of all buckets
are sorted by Gray rank, which every band turns by other bits, and dealt by ranges of that order; in a bucket of over ``SMALL`` each first meets only
the one before it and the first of its range.  One candidate a text is verified first; of
the others only those that would still join two components are.  That makes one component of most large buckets. In those
that still hold several, all pairs of members of different components are compared (:func:`open_links`), so no link is lost.

Cases: texts are split at ASCII white space and only A-Z is lower-cased; a text under ``SHINGLE``
words is one shingle; texts without words, null ones included, are copies of each other; of each component exactly
one row stays, the least by doc_id (null last), hash of the text and row; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm.common import drop, fresh, prepare, stage
from treeline.llm.components import components, keep_first
from treeline.llm.simhash import GrayIndex, starts

SHINGLE = 5
#: Least similarity of a link, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 16, 4
RADIUS = 20
SMALL = 8
#: Members of a large bucket are dealt into parts of about so many, and of so many shingles; two parts are compared at a time.
PART, PART_SHINGLES = 2048, 1 << 21
SEED = 42
MULTIPLIERS = np.array([xxhash.xxh64_intdigest(str(k), SEED) | 1 for k in range(BANDS * ROWS)], np.uint64)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the distinct word shingles, sorted."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.array([], np.uint64)
    joined, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    stops, starts = ends[k - 1 :].tolist(), [0, *(ends[: len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def signature(hashes: np.ndarray) -> tuple[int, list[int]]:
    """SimHash and the keys of all bands, as signed longs; *hashes* is not empty."""
    least, ones = np.full(BANDS * ROWS, ~np.uint64(0)), np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 12):
        part = hashes[at : at + (1 << 12)]
        least = np.minimum(least, (part[None, :] * MULTIPLIERS[:, None]).min(axis=1))
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    fp = np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")
    keys = [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return int(fp[0]), np.array(keys, np.uint64).view(np.int64).tolist()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for text in batch.column(1).to_pylist():
            hashes = shingle_hashes(text)
            fp, keys = signature(hashes) if len(hashes) else (0, [])
            node = np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).astype(np.int64)
            for column, v in zip(out, (int(node), fp, len(hashes), keys)):
                column.append(v)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types))], ["row", "node", "fp", "n", "keys"])


def _bucket_pairs(bucket: np.ndarray, node: np.ndarray, fp: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of whole small buckets by their Gray-order index, lesser node first; *bucket* is sorted."""
    begun = starts(bucket)
    sizes = np.diff(np.append(begun, len(bucket)))
    several = np.repeat(sizes > 1, sizes)
    found = [(node[:0], node[:0])]
    if several.any():
        node, n, index = node[several], n[several], GrayIndex(bucket[several], fp[several].view(np.uint64))
        for x, y in index.links(RADIUS):
            x, y = index.order[x], index.order[y]
            ok = _like_sizes(n[x], n[y]) & (node[x] != node[y])
            found.append((np.minimum(node[x], node[y])[ok], np.maximum(node[x], node[y])[ok]))
    a, b = (np.concatenate(side) for side in zip(*found))
    return a, b


def _like_sizes(size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which pairs can be similar, by their numbers of shingles."""
    return SIMILAR[1] * np.minimum(size, other) >= SIMILAR[0] * np.maximum(size, other)


def _near(fp: np.ndarray, other: np.ndarray, size: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Which pairs can be similar at all, by SimHash and number of shingles."""
    return (np.bitwise_count(fp ^ other) <= RADIUS) & _like_sizes(size, other_size)


def _chain_pairs(bucket: np.ndarray, node: np.ndarray, fp: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of large buckets, or of ranges of them, in Gray order: each member with the first and the one before, lesser node first."""
    begun = starts(bucket)
    first, at = np.repeat(begun, np.diff(np.append(begun, len(bucket)))), np.arange(len(bucket))
    x, y = np.concatenate([first[at > first], at[at > first] - 1]), np.tile(at[at > first], 2)
    fp = fp.view(np.uint64)
    ok = _near(fp[x], fp[y], n[x], n[y]) & (node[x] != node[y])
    x, y = node[x[ok]], node[y[ok]]
    return np.minimum(x, y), np.maximum(x, y)


#: Columns of what :func:`_candidates` yields: pairs (the rest null), or members of buckets that may go on in other ranges (a and b null).
MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("band", pa.int32()), ("key", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("many", pa.bool_())])
#: A task holds on to about so many rows; of a bucket that is larger still, to the last row.
HELD = 1 << 16


def _candidates(batches: Iterator[pa.RecordBatch], small: int, most: int = HELD) -> Iterator[pa.RecordBatch]:
    """One range of the rows (band, key, node, fp, n), sorted by band, key and Gray order.

    The range's first and last bucket may have members in other ranges: of these all members, if they are at most *small*, or else the first one,
    are handed on to :func:`_cut_candidates`."""
    held: list[pa.RecordBatch] = []
    rows, opening, most = 0, None, max(most, small + 1)

    def met(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, rows, opening
        table = pa.Table.from_batches(held).combine_chunks()
        band, key, node, fp, n = (table.column(k).to_numpy() for k in range(5))
        edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (band[1:] != band[:-1])]))
        opening = opening or (band[0], key[0])
        whole = rest = len(key) if last else int(edges[-1])
        if not whole:
            if len(key) < most:
                return
            whole, rest = len(key), len(key) - 1
        edges = edges[edges < whole]
        sizes = np.diff(np.append(edges, whole))
        end = (band[edges] == opening[0]) & (key[edges] == opening[1])
        end[-1] |= last
        bucket, large, cut = np.repeat(np.arange(len(edges)), sizes), np.repeat(sizes > small, sizes), np.repeat(end, sizes)
        for rule, these in ((_bucket_pairs, ~large & ~cut), (_chain_pairs, large)):
            own = np.flatnonzero(these)
            a, b = rule(bucket[own], node[own], fp[own], n[own])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.nulls(len(a), f.type) for f in list(MET)[2:])], schema=MET)
        on = np.concatenate([np.flatnonzero(cut & ~large), edges[end & (sizes > small)]])
        if len(on):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(on), pa.int64()) for _ in "ab"), *(pa.array(x[on], f.type) for x, f in zip((band, key, node, fp, n, large), list(MET)[2:]))], schema=MET)
        held, rows = table.slice(rest).to_batches(), len(key) - rest

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
            if rows >= most:
                yield from met(False)
    if rows:
        yield from met(True)


def _cut_candidates(batches: Iterator[pa.RecordBatch], small: int) -> Iterator[pa.RecordBatch]:
    """Rows (band, key, node, fp, n, many) that :func:`_candidates` has handed on, sorted alike: at most a few a range, and whole buckets."""
    held = [x for x in batches if x.num_rows]
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        band, key, node, fp, n, many = (table.column(k).to_numpy(zero_copy_only=False) for k in range(6))
        edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (band[1:] != band[:-1])]))
        sizes = np.diff(np.append(edges, len(key)))
        bucket, large = np.repeat(np.arange(len(edges)), sizes), np.repeat((sizes > small) | np.logical_or.reduceat(many, edges), sizes)
        for rule, these in ((_bucket_pairs, ~large), (_chain_pairs, large)):
            own = np.flatnonzero(these)
            a, b = rule(bucket[own], node[own], fp[own], n[own])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _gray_place() -> Column:
    """Place of ``fp``, turned by the band, in Gray order; long order is that of unsigned ranks."""
    rank = F.expr("shiftleft(fp, 4 * band) | shiftrightunsigned(fp, 64 - 4 * band)")
    for k in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, k))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def candidates(spark: SparkSession, firsts: DataFrame, small: int = SMALL) -> DataFrame:
    """``(a, b)``, lesser node first: all near pairs of small buckets; of large ones each member with the first of its range and the one before.

    All members are dealt by ranges of bucket and Gray order, so no bucket is one task's, and none has to be joined with what is known of it.
    Buckets that lie in several ranges are put together from a few members a range."""
    keyed = firsts.select("node", "fp", "n", F.posexplode("keys").alias("band", "key")).select("band", "key", "node", "fp", "n")
    order = ["band", "key", "place", "node"]
    ranked = keyed.withColumn("place", _gray_place()).repartitionByRange(*order).sortWithinPartitions(*order).drop("place")
    met = stage(spark, ranked.mapInArrow(lambda batches: _candidates(batches, small), "a long, b long, band int, key long, node long, fp long, n long, many boolean"), "near-met")
    cut = met.where("band is not null").select("band", "key", "node", "fp", "n", "many").withColumn("place", _gray_place())
    cut = cut.repartition("band", "key").sortWithinPartitions(*order).drop("place")
    found = met.where("band is null").select("a", "b").union(cut.mapInArrow(lambda batches: _cut_candidates(batches, small), "a long, b long"))
    out = stage(spark, found.distinct(), "near-candidates")
    drop(spark, met)
    return out


def _part_links(part: pa.Table) -> Iterator[tuple[int, int]]:
    """Links that join components, of one pair of parts; columns as :func:`_open_links` takes them."""
    band, low, high = (part.column(k)[0].as_py() for k in ("band", "low", "high"))
    side, node, fp, n, root = (part.column(k).to_numpy() for k in ("part", "node", "fp", "n", "root"))
    fp, keys = fp.view(np.uint64), np.stack(part.column("keys").to_pylist())
    left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)
    if not len(left) or not len(right):
        return
    # The Gray-order index of the part, or of both, finds which pairs are within the radius.
    near = np.zeros((len(left), len(right)), bool)
    both = left if low == high else np.concatenate([left, right])
    index = GrayIndex(np.repeat([0, 1], [len(left), len(both) - len(left)]), fp[both])
    for x, y in index.links(RADIUS, across=low != high):
        x, y = index.order[x], index.order[y]
        if low == high:
            near[x, y] = near[y, x] = True
        else:
            near[x, y - len(left)] = True
    sets = [np.frombuffer(x, "<u8") for x in part.column("hashes").to_pylist()]
    # Postings of the right part: which members hold each shingle.
    shingles, number = np.unique(np.concatenate([sets[j] for j in right]), return_inverse=True)
    holder = np.repeat(np.arange(len(right)), n[right])[np.argsort(number, kind="stable")]
    begun = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(shingles)))])
    for at_left, i in enumerate(left.tolist()):
        open_ = (root[right] != root[i]) & near[at_left] & _like_sizes(n[i], n[right])
        # A pair that shares an earlier band has been a candidate there.
        open_ &= ~(keys[right, :band] == keys[i, :band]).any(axis=1)
        if not open_.any():
            continue
        at = np.minimum(np.searchsorted(shingles, sets[i]), len(shingles) - 1)
        at = at[shingles[at] == sets[i]]
        sizes = begun[at + 1] - begun[at]
        places = np.repeat(begun[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        both = np.bincount(holder[places], minlength=len(right))
        for j in right[open_ & (SIMILAR[1] * both >= SIMILAR[0] * (n[i] + n[right] - both))].tolist():
            if root[i] != root[j]:
                yield int(node[i]), int(node[j])
                root = np.where(root == root[j], root[i], root)


def _open_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, key, low, high, part, node, fp, n, root, keys, hashes) sorted by the first four: parts *low* and *high* of a bucket."""

    def linked(held: list[pa.Table]) -> pa.RecordBatch:
        found = list(_part_links(pa.concat_tables(held).combine_chunks()))
        return pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], ["a", "b"])

    held: list[pa.Table] = []
    last = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        own = np.stack([table.column(k).to_numpy() for k in range(4)], axis=1)
        edges = [0, *(np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1).tolist(), len(own)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if held and tuple(own[a]) != last:
                yield linked(held)
                held = []
            held.append(table.slice(a, b - a))
            last = tuple(own[a])
    if held:
        yield linked(held)


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [shingle_hashes(t).astype("<u8").tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.binary())], ["node", "hashes"])


def _parts(spark: SparkSession, members: DataFrame, mixed: DataFrame, part: int) -> tuple[DataFrame, list[DataFrame]]:
    """*members* with ``part``, their own part of the bucket, and ``others``, the parts to compare it with; and the staged tables it reads.

    A component of more than a part has parts of its own, which aren't compared with each other; the rest of a bucket is dealt by
    a hash.  So where one component makes most of a bucket, what is dealt grows with the bucket, not with its square.
    """
    bucket = ["band", "key"]

    def count(m: str, total: str):
        return F.greatest(F.ceil(F.col(m) / part), F.ceil(F.col(total) / PART_SHINGLES)).cast("int")

    groups = members.groupBy(*bucket, "root").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
    groups = groups.where((F.col("c") > part) | (F.col("t") > PART_SHINGLES)).withColumn("own", count("c", "t"))
    sums = groups.groupBy(*bucket).agg(F.sum("c").alias("c"), F.sum("t").alias("t"), F.sum("own").alias("pure"))
    sizes = mixed.join(sums, bucket, "left").na.fill(0, ["c", "t", "pure"])
    sizes = sizes.withColumn("m", F.col("m") - F.col("c")).withColumn("total", F.col("total") - F.col("t")).withColumn("rest", count("m", "total"))
    sizes = sizes.select(*bucket, "rest", (F.col("rest") + F.col("pure")).cast("int").alias("parts"))
    # A bucket has at most a row here for every *part* members.
    ahead = F.coalesce(F.sum("own").over(Window.partitionBy(*bucket).orderBy("root").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    # As tables, so that the joins' hot buckets are split.
    groups = stage(spark, groups.select(*bucket, "root", "own", ahead.alias("ahead")), "near-own")
    sizes = stage(spark, sizes, "near-sizes")
    dealt = members.join(sizes, bucket).join(groups, [*bucket, "root"], "left")
    lone = F.col("own").isNull()
    dealt = dealt.withColumn("base", F.when(lone, 0).otherwise(F.col("rest") + F.col("ahead"))).withColumn("among", F.coalesce("own", "rest"))
    part_of = F.col("base") + F.pmod(F.xxhash64("node"), F.col("among")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    others = F.when(lone, every).otherwise(F.filter(every, lambda x: (x < F.col("base")) | (x >= F.col("base") + F.col("own"))))
    return dealt.withColumn("part", part_of).withColumn("others", others), [groups, sizes]


def open_links(spark: SparkSession, rows: DataFrame, firsts: DataFrame, roots: DataFrame, small: int = SMALL, part: int = PART) -> DataFrame:
    """``(a, b)``: links between different components (*roots*) that share a bucket of over *small*, no more than join these.

    Which buckets hold several components is a sum over their members; only the members of these are listed.  They are dealt into
    parts of bounded size; every two parts that differ in components are compared by a task's index and
    postings of shingles, so what is written are links, not pairs."""
    bucket = ["band", "key"]
    named = stage(spark, firsts.join(roots.toDF("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node")), "near-named")
    keyed = named.select("node", "n", "root", F.posexplode("keys").alias(*bucket))
    sums = keyed.groupBy(*bucket).agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.min("root").alias("least"), F.max("root").alias("most"))
    mixed = stage(spark, sums.where((F.col("m") > small) & (F.col("least") != F.col("most"))).select(*bucket, "m", "total"), "near-mixed")
    places = stage(spark, keyed.select(*bucket, "node").join(mixed.select(*bucket), bucket), "near-places")
    asked = stage(spark, named.join(places.select("node").distinct(), "node"), "near-asked")
    members = stage(spark, places.join(asked.select("node", "fp", "n", "root", "keys"), "node"), "near-members")
    texts = rows.join(asked.select("node", "row"), "row").select("node", "text")
    hashes = stage(spark, texts.mapInArrow(_hash_rows, "node long, hashes binary"), "near-hashes")
    dealt, tables = _parts(spark, members, mixed, part)
    dealt = dealt.withColumn("other", F.explode("others")).join(hashes, "node")
    dealt = dealt.select("band", "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "fp", "n", "root", "keys", "hashes")
    dealt = dealt.repartition("band", "key", "low", "high").sortWithinPartitions("band", "key", "low", "high")
    out = stage(spark, dealt.mapInArrow(_open_links, "a long, b long").distinct(), "near-open")
    drop(spark, named, places, members, mixed, asked, hashes, *tables)
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, ta, tb = (batch.column(k).to_pylist() for k in range(4))
        seen: dict[int, np.ndarray] = {}
        for node, text in zip(a + b, ta + tb):
            if node not in seen:
                seen[node] = shingle_hashes(text)
        good = [similar(seen[x], seen[y]) for x, y in zip(a, b)]
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))


def links(spark: SparkSession, rows: DataFrame, signed: DataFrame, small: int = SMALL, part: int = PART) -> DataFrame:
    """``(node, root)`` of all linked nodes; *rows* has row and text, *signed* row, node, fp, n and keys."""
    firsts = stage(spark, signed.groupBy("node", "fp", "n").agg(F.min("row").alias("row"), F.min("keys").alias("keys")), "near-nodes")
    found = candidates(spark, firsts, small)

    def verified(edges: DataFrame, name: str) -> DataFrame:
        asked = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = stage(spark, rows.join(firsts.join(asked, "node").select("node", "row"), "row").select("node", "text"), "near-texts")
        both = edges.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
        out = stage(spark, both.mapInArrow(_verify, "a long, b long"), name)
        drop(spark, texts)
        return out

    one = stage(spark, found.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "near-first")
    good = verified(one, "near-good")
    roots = components(spark, good)
    x, y = F.coalesce("x", "a"), F.coalesce("y", "b")
    left = found.join(one, ["a", "b"], "left_anti").join(roots.toDF("a", "x"), "a", "left").join(roots.toDF("b", "y"), "b", "left")
    left = stage(spark, left.where(x != y).select("a", "b"), "near-left")
    more = verified(left, "near-more")
    drop(spark, roots, found, one, left)
    roots = components(spark, good.union(more))
    rest = open_links(spark, rows, firsts, roots, small, part)
    if not rest.isEmpty():
        drop(spark, roots)
        roots = components(spark, good.union(more).union(rest))
    drop(spark, firsts, good, more, rest)
    return roots


def keep_one(spark: SparkSession, docs: DataFrame, small: int = SMALL, part: int = PART) -> DataFrame:
    """One row of *docs* for each component of links; *small* and *part* don't change which."""
    prepare(spark)
    row = fresh(docs, "_row")
    staged = stage(spark, docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    rows = staged.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text"))
    signed = stage(spark, rows.mapInArrow(_signatures, "row long, node long, fp long, n long, keys array<long>"), "near-signed")
    roots = links(spark, rows, signed, small, part)
    named = signed.select("row", "node").join(roots, "node", "left").select("row", F.coalesce("root", "node").alias("root"))
    out = keep_first(spark, staged, row, named)
    drop(spark, signed, roots)
    return out
