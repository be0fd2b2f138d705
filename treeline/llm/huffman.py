"""Token-id files in canonical length-limited Huffman code.

A file set is a folder with two Parquet datasets.  ``codes`` lists ``(id, n, length)``; the
canonical code follows from the lengths alone.  ``blocks`` holds independent blocks in
ascending ``doc_id`` order: ``shard`` and ``seq`` order them, ``first`` counts the ids before
the block in its shard, ``doc_ids`` and ``n_ids`` describe its documents, ``payload`` is the bit stream
and ``points`` are bit offsets of every ``CHECKPOINT``-th id, at each of which decoding can begin.

Cases: a null text is empty and holds only the end id; an empty table gives no blocks; rows with
a null ``doc_id`` come first; rows that repeat a ``doc_id`` are ordered by a hash of their ids and
all stay; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm.common import drop, id_text, prepare, stage
from treeline.llm.tokens import encoder, id_batches

MAX_LENGTH = 20
CHECKPOINT = 256
BLOCK_IDS = 1 << 16


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Lengths of an optimal prefix code under *limit* by package-merge; 0 for unused ids."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes longer than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    weights, levels = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        even = len(weights) // 2 * 2
        packages = weights[0:even:2] + weights[1:even:2]
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        weights = both[rank]
        levels.append(rank < len(leaves))
    take, own = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        own[:n] += 1
        take = 2 * (take - n)
    lengths[order] = own
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        n = int(lengths[i])
        if n:
            code <<= n - last
            codes[i] = code
            code, last = code + 1, n
    return codes


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bit stream of *ids*, most significant bit first, and the bit offset of each id."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    word, shift = starts >> 6, 64 - (starts & 63) - n
    code = codes[ids]
    out = np.zeros((int(ends[-1]) + 63 >> 6) + 1, np.uint64)
    high = np.where(shift >= 0, code << np.maximum(shift, 0).astype(np.uint64), code >> np.maximum(-shift, 0).astype(np.uint64))
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[first]] = np.bitwise_or.reduceat(high, first)
    over = np.flatnonzero(shift < 0)
    out[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: int(ends[-1]) + 7 >> 3], starts


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every window of the longest code's width: the id it starts with and that id's length."""
    width = int(lengths.max(initial=1))
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    span = (1 << width) >> lengths[order].astype(np.int64)
    ids = np.zeros(1 << width, np.uint32)
    own = np.ones(1 << width, np.uint8)
    end = int(span.sum())
    ids[:end], own[:end] = np.repeat(order, span), np.repeat(lengths[order], span)
    return ids, own, width


def unpack_bits(payloads: list[bytes], points: list[np.ndarray], totals: list[int], table) -> list[np.ndarray]:
    """Ids of several blocks; every checkpoint of every block is a lane, all lanes step together."""
    ids, own, width = table
    data = np.frombuffer(b"".join(p + b"\0" * 8 for p in payloads), np.uint8)
    base = np.cumsum([0] + [len(p) + 8 for p in payloads])[:-1]
    at = np.concatenate([b * 8 + p for b, p in zip(base, points)]).astype(np.int64)
    left = np.concatenate([np.minimum(CHECKPOINT, t - CHECKPOINT * np.arange(len(p))) for t, p in zip(totals, points)])
    out = np.zeros((len(at), CHECKPOINT), np.uint32)
    mask = np.uint32((1 << width) - 1)
    wide = np.zeros(len(data), np.uint32)
    # Four bytes from each byte position: a window of up to 25 bits at any bit offset.
    for k in range(4):
        wide[: len(data) - k] |= data[k:].astype(np.uint32) << np.uint32(24 - 8 * k)
    for k in range(CHECKPOINT):
        if k and not (k & 63):
            live = left > k
            if not live.any():
                break
        window = (wide[at >> 3] >> (32 - width - (at & 7)).astype(np.uint32)) & mask
        out[:, k] = ids[window]
        at = np.minimum(at + own[window], (len(data) - 4) * 8)
    lanes = np.cumsum([0] + [len(p) for p in points])
    return [out[a:b].reshape(-1)[:t] for a, b, t in zip(lanes, lanes[1:], totals)]


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(encoder(path).library.get_vocab_size(with_added_tokens=True), np.int64)
        dtype = encoder(path).dtype
        for batch, ids in id_batches(batches, path, end_id):
            for at in range(0, len(ids), 256):
                counts += np.bincount(np.frombuffer(b"".join(ids[at : at + 256]), dtype), minlength=len(counts))
            doc_id = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], ["doc_id", "ids", "counts"])
        used = np.flatnonzero(counts)
        own = np.stack([used, counts[used]], axis=1).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([own], pa.binary())], ["doc_id", "ids", "counts"])

    return run


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for own in batch.column(0).to_pylist():
            pairs = np.frombuffer(own, "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["id", "n"])


def _block_writer(lengths_of, dtype: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lengths = lengths_of.value
        codes, shard = canonical(lengths), TaskContext.get().partitionId()
        seq = first = 0

        def block(doc_ids, texts):
            nonlocal seq, first
            sizes = [len(t) // dtype.itemsize for t in texts]
            payload, starts = pack_bits(np.frombuffer(b"".join(texts), dtype), codes, lengths)
            row = pa.RecordBatch.from_pylist([{"shard": shard, "seq": seq, "first": first, "doc_ids": doc_ids, "n_ids": sizes, "points": starts[::CHECKPOINT].tolist(), "payload": payload}], BLOCK)
            seq, first = seq + 1, first + sum(sizes)
            return row

        doc_ids: list = []
        texts: list[bytes] = []
        held = 0
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids.append(d)
                texts.append(t)
                held += len(t)
                if held >= BLOCK_IDS * dtype.itemsize:
                    yield block(doc_ids, texts)
                    doc_ids, texts, held = [], [], 0
        if doc_ids:
            yield block(doc_ids, texts)

    return run


BLOCK = pa.schema([("shard", pa.int32()), ("seq", pa.int64()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_ids", pa.list_(pa.int64())), ("points", pa.list_(pa.int64())), ("payload", pa.binary())])
BLOCK_DDL = "shard int, seq long, first long, doc_ids array<long>, n_ids array<long>, points array<long>, payload binary"


def write_ids(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int, max_length: int = MAX_LENGTH) -> None:
    """Encode *docs* (doc_id, text) and write a file set to *path*."""
    prepare(spark)
    encoded = stage(spark, id_text(docs).mapInArrow(_encode(tokenizer, end_id), "doc_id long, ids binary, counts binary"), "ids")
    # A row for each id in use: what comes to the driver is bounded by the vocabulary.
    totals = encoded.where("counts is not null").select("counts").mapInArrow(_count_rows, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in totals), default=0) + 1, np.int64)
    for r in totals:
        counts[r.id] = r.n
    lengths = code_lengths(counts, max_length)
    used = np.flatnonzero(lengths)
    codes = [(int(i), int(counts[i]), int(lengths[i])) for i in used]
    spark.createDataFrame(codes, "id long, n long, length int").coalesce(1).write.parquet(f"{path}/codes")
    shared = spark.sparkContext.broadcast(lengths)
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The last column splits rows that are equal in both others.
    keyed = encoded.where("counts is null").select("doc_id", "ids", F.xxhash64("ids").alias("tie"), F.monotonically_increasing_id().alias("row"))
    ordered = keyed.repartitionByRange(ranges, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "ids")
    ordered.mapInArrow(_block_writer(shared, encoder(tokenizer).dtype), BLOCK_DDL).write.option("compression", "none").parquet(f"{path}/blocks")
    drop(spark, encoded)


def read_lengths(spark: SparkSession, path: str) -> np.ndarray:
    """Code lengths of a file set; as many rows as the vocabulary has ids."""
    rows = spark.read.parquet(f"{path}/codes").select("id", "length").collect()
    lengths = np.zeros(max([r[0] for r in rows], default=0) + 1, np.uint8)
    for i, n in rows:
        lengths[i] = n
    return lengths


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Decode a file set: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and
    the ids themselves as ``ids`` (little-endian unsigned 32-bit) or, with *digest*, their crc32."""
    prepare(spark)
    blocks = spark.read.schema(BLOCK_DDL).parquet(f"{path}/blocks")
    sizes = blocks.select("shard", F.expr("aggregate(n_ids, 0L, (a, x) -> a + x)").alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    # One row per shard: never more than the shuffle partitions of the writer.
    bases = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    table_of = spark.sparkContext.broadcast(read_lengths(spark, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(table_of.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                rows = batch.slice(at, 16).to_pylist()
                totals = [sum(r["n_ids"]) for r in rows]
                decoded = unpack_bits([r["payload"] for r in rows], [np.array(r["points"], np.int64) for r in rows], totals, table)
                out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "value": []}
                for r, ids in zip(rows, decoded):
                    raw, begin = memoryview(ids.astype("<u4").tobytes()), 0
                    for d, n in zip(r["doc_ids"], r["n_ids"]):
                        own = raw[4 * begin : 4 * (begin + n)]
                        for k, v in zip(out, (d, r["base"] + r["first"] + begin, n, zlib.crc32(own) if digest else bytes(own))):
                            out[k].append(v)
                        begin += n
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "value" and not digest else pa.int64()) for k, v in out.items()], list(out))

    name = "ids_crc32" if digest else "ids"
    return blocks.join(F.broadcast(bases), "shard").mapInArrow(run, f"doc_id long, start long, n_tokens long, value {'long' if digest else 'binary'}").withColumnRenamed("value", name)
