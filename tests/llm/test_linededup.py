import hashlib
import random

import duckdb

import corpus_pipeline
from treeline.llm import linededup
from treeline.llm.linededup import chunks, dedup_lines, is_candidate
from treeline.llm.queries import op9_line_dedup


def brute(rows):
    """doc_id -> text after removal, from (doc_id, text) with unique ids."""
    seen, out = set(), {}
    for d, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if text is None:
            out[d] = None
            continue
        lines, kept = text.split("\n"), []
        for a, b in chunks(lines):
            body = tuple(lines[a:b])
            if is_candidate(lines[a:b]) and body in seen:
                continue
            if is_candidate(lines[a:b]):
                seen.add(body)
            kept += body
        out[d] = "\n".join(kept)
    return out


def test_whole_table_matches_sql(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = sorted(tuple(r) for r in op9_line_dedup(spark, sf_dir).collect())
    assert got == sorted(con.execute(linededup.ORACLE).fetchall())
    assert sum(r[2] for r in got) > 0


def test_awkward_rows(spark):
    body = "\n".join(f"line {i} of a passage" for i in range(40))
    rows = [(3, body), (1, "new first line\n" + body), (2, None), (4, ""), (5, "\n\n\n\n"), (6, "\n\n\n\n"), (7, "same\nsame\n" * 3000), (8, body + "\ntail"), (None, body), (9, "x")]
    docs = spark.createDataFrame([(a, b, 5, "k", "c") for a, b in rows], "doc_id long, text string, n_lines int, key string, _cuts string")
    got = dedup_lines(spark, docs)
    assert got.columns == [*docs.columns, "_n_lines", "n_removed"]
    have = {r.doc_id: r.text for r in got.collect()}
    assert have == brute(rows) and len(have[3]) < len(body) / 2 and have[2] is None
    twice = docs.where("doc_id = 3").union(docs.where("doc_id = 3"))
    assert [r.text for r in dedup_lines(spark, twice).collect()] == [body] * 2
    assert dedup_lines(spark, docs.limit(0)).count() == 0


def test_boundaries_resist_shifts():
    lines = [f"line {i}" for i in range(200)]
    cut = lambda x: {tuple(x[a:b]) for a, b in chunks(x)}
    assert [x for a, b in chunks(lines) for x in lines[a:b]] == lines
    assert len(cut(lines) - cut(["put in front", *lines])) <= 1
    assert len(cut(lines) - cut([*lines[:90], "in the middle", *lines[90:]])) <= 3
    assert hashlib.md5(b"a").hexdigest()[:8] == f"{linededup.line_hash('a'):08x}"


def test_pipeline_stage_removes_short_repeats_and_runs(spark):
    short = [("a", "b"), ("c d", "e f"), ("one", "two", "three"), ("p", "q"), ("r", "s"), ("t", "u"), ("v", "w"), ("x", "y")]
    rows = [(2 * k + side, "\n".join(x)) for k, x in enumerate(short) for side in (0, 1)]
    rows += [(100, "\n".join(["same line"] * 400 + ["end"])), (101, "\n".join(["lone", *[f"l{i}" for i in range(90)]]))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == brute(rows)
    assert [got[2 * k + 1] for k in range(len(short))].count("") >= len(short) - 1
    assert got[100].count("same line") <= 2 * linededup.MOST and got[101] == rows[-1][1]
    for _, text in rows:
        lines = text.split("\n")
        assert all(2 <= b - a <= linededup.MOST for a, b in chunks(lines)[:-1])


def shuffled(spark, work):
    """Bytes that the stages of *work* have written for other stages."""
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    work()
    return total() - before


def test_what_is_shuffled_does_not_hang_on_broadcasts(spark):
    rng = random.Random(3)
    texts = ["\n".join(" ".join(f"w{rng.random()}" for _ in range(12)) for _ in range(12)) for _ in range(400)]
    rows = [(d, t if d % 4 else texts[1]) for d, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    work = lambda: dedup_lines(spark, docs).write.format("noop").mode("overwrite").save()
    before, sizes = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), []
    try:
        for threshold in (before, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            sizes.append(shuffled(spark, work))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert 0 < sizes[1] < 2.5 * sizes[0], sizes


def test_bytes_decide_where_hashes_clash(spark):
    bodies = ["a b\nc d", "e f\ng h", "i j\nk l"]
    rows = [(d, bodies[k]) for d, k in enumerate((1, 0, 1, 2, 0, 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = lambda lines: [(0, len(lines))]
    got = {r.doc_id: r.text for r in dedup_lines(spark, docs, whole, lambda body: b"same").collect()}
    assert got == {0: bodies[1], 1: bodies[0], 2: "", 3: bodies[2], 4: bodies[0], 5: ""}
    got = {r.doc_id: r.text for r in dedup_lines(spark, docs, whole).collect()}
    assert got == {0: bodies[1], 1: bodies[0], 2: "", 3: bodies[2], 4: "", 5: ""}
