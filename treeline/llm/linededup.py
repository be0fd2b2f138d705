"""Line dedup by content-defined chunks of lines.

A text's lines are hashed; a rolling hash over ``WINDOW`` line hashes ends a chunk after every line at
which it is zero modulo ``DIVISOR``.  Boundaries thus depend on nearby lines alone and come back in step after
lines are put in or taken out.  A boundary is held back until the chunk has two lines that are not blank; a chunk
also ends at ``MOST`` lines and after a run of equal lines (:func:`chunks`).  The chunks of ``ORACLE`` have none of the three
(:func:`free_chunks`).  A chunk of two lines or more (at least two of them not blank) that an
earlier document, or an earlier place of the same one, also holds is removed, once its bytes have been
compared with those of the first.  What a chunk's lines are cut from each other by stays with what is kept:
kept lines are joined by line feeds.

Cases: a null text has no lines and stays null; an empty text is one blank line; earlier means smaller
doc_id (null last), then a hash of the text, then position; rows equal in doc_id and text are one
document; a text may end up empty; other columns stay as they are; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import drop, fresh, prepare, stage, text_key

WINDOW = 2
DIVISOR = 3
MULTIPLIER = 31
MOST = 8
WORD = re.compile(r"[^\x20\x09-\x0D]")
LAST = (1 << 63) - 1
Chunker = Callable[[list[str]], list[tuple[int, int]]]
Digest = Callable[[str], bytes]


def line_hash(line: str) -> int:
    return int(hashlib.md5(line.encode("utf-8", "replace"), usedforsecurity=False).hexdigest()[:8], 16)


def chunks(lines: list[str]) -> list[tuple[int, int]]:
    """(first line, line after the last) of each chunk; all but the last have two lines that are not blank."""
    out, begun, worded, before = [], 0, 0, 0
    for i, line in enumerate(lines):
        h = line_hash(line)
        worded += bool(WORD.search(line))
        if worded > 1:
            run_ends = lines[i - 1] == line and lines[i + 1 : i + 2] != [line]
            if (before * MULTIPLIER + h) % DIVISOR == 0 or run_ends or i + 1 - begun >= MOST:
                out.append((begun, i + 1))
                begun, worded = i + 1, 0
        before = h
    if begun < len(lines):
        out.append((begun, len(lines)))
    return out


def free_chunks(lines: list[str]) -> list[tuple[int, int]]:
    """Chunks of any length, as ``ORACLE`` makes them."""
    out, begun, window = [], 0, [0] * WINDOW
    for i, line in enumerate(lines):
        window = [*window[1:], line_hash(line)]
        rolled = 0
        for h in window:
            rolled = rolled * MULTIPLIER + h
        if rolled % DIVISOR == 0:
            out.append((begun, i + 1))
            begun = i + 1
    if begun < len(lines):
        out.append((begun, len(lines)))
    return out


def is_candidate(lines: list[str]) -> bool:
    return len(lines) > 1 and sum(bool(WORD.search(x)) for x in lines) > 1


def _hash(body: str) -> bytes:
    return xxhash.xxh3_128_digest(body.encode("utf-8", "replace"))


def _candidates(batches: Iterator[pa.RecordBatch], chunker: Chunker, digest: Digest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for rank, key, text in zip(*(c.to_pylist() for c in batch.columns)):
            if text is None:
                continue
            lines = text.split("\n")
            for n, (a, b) in enumerate(chunker(lines)):
                if is_candidate(lines[a:b]):
                    for column, v in zip(out, (digest("\n".join(lines[a:b])), rank, key, n)):
                        column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.int32()))], ["hash", "rank", "key", "n"])


def _bodies(batches: Iterator[pa.RecordBatch], chunker: Chunker, digest: Digest) -> Iterator[pa.RecordBatch]:
    """Rows (rank, key, text, cuts, heads): the chunks that *cuts* and *heads* number, with their bytes."""
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for rank, key, text, cuts, heads in zip(*(c.to_pylist() for c in batch.columns)):
            lines, cuts, heads = text.split("\n"), set(cuts), set(heads)
            for n, (a, b) in enumerate(chunker(lines)):
                if n in cuts or n in heads:
                    body = "\n".join(lines[a:b])
                    for column, v in zip(out, (digest(body), rank, key, n, n in heads, body)):
                        column.append(v)
        types = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["hash", "rank", "key", "n", "is_first", "body"])


def repeated_chunks(spark: SparkSession, rows: DataFrame, chunker: Chunker = chunks, digest: Digest = _hash) -> DataFrame:
    """``rank`` (doc_id, null last), ``key`` (of the text), ``cuts`` and ``heads``: the numbers of the chunks whose hash came
    before, and of the chunks that are the first of those.  *rows* has rank, key and text."""
    found = stage(spark, rows.mapInArrow(lambda batches: _candidates(batches, chunker, digest), "hash binary, rank long, key long, n int"), "line-chunks")
    place = F.struct("rank", "key", "n")
    firsts = found.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").select("hash", "first")
    # A table, so that a frequent chunk's rows are split over tasks of the join.
    firsts = stage(spark, firsts, "line-firsts")
    repeats = found.join(firsts, "hash").select("rank", "key", "n", (place == F.col("first")).alias("is_first"))
    marks = repeats.groupBy("rank", "key").agg(F.collect_set(F.expr("case when not is_first then n end")).alias("cuts"), F.collect_set(F.expr("case when is_first then n end")).alias("heads"))
    out = stage(spark, marks, "line-marks")
    drop(spark, found, firsts)
    return out


def differing_chunks(spark: SparkSession, marked: DataFrame, chunker: Chunker = chunks, digest: Digest = _hash) -> DataFrame:
    """``rank``, ``key`` and ``spared``: the numbers of those *cuts* whose bytes are not the first's.  *marked* has rank, key, text, cuts and heads."""
    asked = marked.where("text is not null and (size(cuts) > 0 or size(heads) > 0)")
    schema = "hash binary, rank long, key long, n int, is_first boolean, body string"
    repeats = stage(spark, asked.mapInArrow(lambda batches: _bodies(batches, chunker, digest), schema), "line-repeats")
    heads = stage(spark, repeats.where("is_first").groupBy("hash").agg(F.min("body").alias("first_body")), "line-heads")
    other = repeats.where("not is_first").join(heads, "hash").where("body <> first_body")
    out = stage(spark, other.groupBy("rank", "key").agg(F.collect_set("n").alias("spared")), "line-spared")
    drop(spark, repeats, heads)
    return out


def dedup_lines(spark: SparkSession, docs: DataFrame, chunker: Chunker = chunks, digest: Digest = _hash) -> DataFrame:
    """*docs* with repeated chunks removed from text, and n_lines and n_removed at the end
    (underscores go before these names where *docs* has them).

    Hashes alone decide which chunks are looked at, so texts are dealt once, to meet their marks, by a plan that doesn't hang on
    the size of the tables; from there only the bytes of repeated chunks go on."""
    prepare(spark)
    rank, key, cuts, heads, spared = (fresh(docs, x) for x in ("_rank", "_key", "_cuts", "_heads", "_spared"))
    keyed = docs.withColumns({rank: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), key: text_key()})
    marks = repeated_chunks(spark, keyed.select(F.col(rank).alias("rank"), F.col(key).alias("key"), F.col("text").cast("string").alias("text")), chunker, digest)
    marked = stage(spark, keyed.join(marks.toDF(rank, key, cuts, heads).hint("merge"), [rank, key], "left"), "line-marked")
    drop(spark, marks)
    own = marked.select(F.col(rank).alias("rank"), F.col(key).alias("key"), F.col("text").cast("string").alias("text"), F.col(cuts).alias("cuts"), F.col(heads).alias("heads"))
    other = differing_chunks(spark, own, chunker, digest)
    gone = F.when(F.col(spared).isNull(), F.col(cuts)).otherwise(F.array_except(cuts, spared)).alias(cuts)
    joined = marked.join(other.toDF(rank, key, spared), [rank, key], "left").select(*docs.columns, gone)
    at, names = docs.columns.index("text"), [fresh(docs, "n_lines"), fresh(docs, "n_removed")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, gone = [], [], []
            for text, own in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                lines = [] if text is None else text.split("\n")
                totals.append(len(lines))
                if own:
                    own = set(own)
                    kept = [x for n, (a, b) in enumerate(chunker(lines)) if n not in own for x in lines[a:b]]
                    text = "\n".join(kept)
                    gone.append(len(lines) - len(kept))
                else:
                    gone.append(0)
                texts.append(text)
            columns = [*batch.columns[:-1], pa.array(totals, pa.int64()), pa.array(gone, pa.int64())]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(run, f"{fields}, `{names[0]}` long, `{names[1]}` long")


ORACLE = r"""
with l as (select doc_id, unnest(t) as line, generate_subscripts(t, 1) as i
           from (select doc_id, string_split(text, chr(10)) as t from documents)),
h as (select *, ('0x' || substr(md5(line), 1, 8))::bigint as h from l),
b as (select *, case when (lag(h, 1, 0) over (partition by doc_id order by i) * 31 + h) % 3 = 0 then 1 else 0 end as cut from h),
c as (select *, coalesce(sum(cut) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as n from b),
k as (select doc_id, n, string_agg(line, chr(10) order by i) as body, count(*) as lines,
             count(*) filter (where regexp_matches(line, '[^\x20\x09-\x0D]')) as worded from c group by doc_id, n),
r as (select *, lines > 1 and worded > 1 and row_number() over (partition by body, lines > 1 and worded > 1 order by doc_id, n) > 1 as gone from k)
select d.doc_id, coalesce(sum(lines), 0)::bigint as n_lines, coalesce(sum(lines) filter (where gone), 0)::bigint as n_removed,
       md5(coalesce(string_agg(body, chr(10) order by n) filter (where not gone), '')) as kept_md5
from documents d left join r on d.doc_id = r.doc_id group by d.doc_id
"""
