import itertools
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as st

from treeline.functions import stats
from treeline.functions import text as T
from treeline.functions.stats import measured_fanout, min_max_normalised
from treeline.model import Entity, JoinTree, QueryTemplate, Relation
from treeline.operators.joins import answer, tree_join
from treeline.operators.navigator import Navigator, look_up, restrict
from treeline.plans.advisor import Advisor
from treeline.plans.cost import ViewSpec
from treeline.plans.cover import find_covers
from treeline.plans.engine import Engine, base_covers
from treeline.sources.catalog import Catalog, invert, load_config, merge, random_relation, relation
from treeline.sources.storage import append_csv, check_schema, write_bucketed, write_table

A, B, C, X = (Entity(n, 12) for n in "abcx")
AB, BC, XC = Relation("ab", A, B, 3, 3), Relation("bc", B, C, 3, 3), Relation("xc", X, C, 3, 3)
TREE = JoinTree.compose(C, "c", [(BC, JoinTree.compose(B, "b", [(AB, JoinTree.leaf(A, "a1")), (AB, JoinTree.leaf(A, "a2"))])), (XC, JoinTree.leaf(X, "x"))])
QUERY = QueryTemplate("q", TREE)


def random_pairs(spark, seed, n=40, card=8):
    rng = random.Random(seed)
    rows = [(rng.randrange(card), rng.randrange(card)) for _ in range(n)]
    return set(rows), relation(spark.createDataFrame(rows, "l long, r long"), "l", "r").select("l", "r")


@pytest.fixture(scope="module")
def data(spark):
    made = {n: random_pairs(spark, k) for k, n in enumerate(("ab", "bc", "xc"))}
    return {n: m[0] for n, m in made.items()}, {n: m[1].cache() for n, m in made.items()}


def brute(sets, a1, a2, x):
    return {(c, b, a1, a2, x) for b in range(8) for c in range(8) if (a1, b) in sets["ab"] and (a2, b) in sets["ab"] and (b, c) in sets["bc"] and (x, c) in sets["xc"]}


def test_every_complete_set_of_covers_gives_the_same_answers(spark, data):
    sets, pairs = data
    asked = [(i, i % 8, (3 * i) % 8, (5 * i + 1) % 8) for i in range(24)] + [(99, -1, 0, 0)]
    instances = spark.createDataFrame(asked, "iid long, a1 long, a2 long, x long")
    want = sorted((i, *row) for i, a1, a2, x in asked for row in brute(sets, a1, a2, x))
    engine = Engine(spark, pairs)
    assert sorted(map(tuple, engine.run_direct(QUERY, instances).collect())) == want
    advisor = Advisor([QUERY])
    multi = [k for k, c in enumerate(advisor.covers) if len(c.goals) > 1]
    rng, tried = random.Random(0), 0
    for ks in itertools.chain(itertools.combinations(multi, 1), itertools.combinations(multi, 2)):
        covers = [advisor.covers[k] for k in ks]
        if frozenset().union(*(c.goals for c in covers)) == QUERY.goals and (tried < 3 or rng.random() < 0.02) and tried < 6:
            tried += 1
            for c in covers:
                engine.materialize(c.view)
            assert sorted(map(tuple, engine.run(covers, instances).collect())) == want
    assert tried >= 2
    result = advisor.optimize()
    engine.create_views(result)
    assert sorted(map(tuple, engine.run(result.covers_of(QUERY), instances).collect())) == want
    with pytest.raises(ValueError):
        answer(base_covers(QUERY)[:-1], {}, instances)


def test_constants_and_unbound_queries(spark, data):
    sets, pairs = data
    fixed = JoinTree.compose(C, "c", [(BC, JoinTree.edge(AB, "a", "b", 3)), (XC, JoinTree.leaf(X, "x"))])
    want = sorted((c, b, 3, x) for a, b in sets["ab"] if a == 3 for b2, c in sets["bc"] if b2 == b for x, c2 in sets["xc"] if c2 == c)
    assert sorted(map(tuple, tree_join(fixed, pairs).collect())) == want
    query = QueryTemplate("f", fixed)
    asked = spark.createDataFrame([(x,) for x in range(8)], "x long")
    assert sorted(map(tuple, Engine(spark, pairs).run_direct(query, asked).collect())) == want
    empty = {k: v.limit(0) for k, v in pairs.items()}
    assert tree_join(TREE, empty).count() == 0
    inside = tree_join(TREE, pairs, {"b": [1, 2], "x": spark.createDataFrame([(4,)], "v long")})
    assert {(r.b, r.x) for r in inside.collect()} <= {(1, 4), (2, 4)}


def test_string_keys(spark):
    pairs = {"ab": spark.createDataFrame([("é", "k"), ("z", "k")], "l string, r string")}
    tree = JoinTree.compose(B, "b", [(AB, JoinTree.leaf(A, "a1", "é")), (AB, JoinTree.leaf(A, "a2"))])
    assert sorted(map(tuple, tree_join(tree, pairs).collect())) == [("k", "é", "z"), ("k", "é", "é")]


def test_relations(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (None, 2), (3, None), (3, 4)], "x int, y int")
    got = relation(df, "x", "y")
    assert [f.simpleString() for f in got.schema] == ["l:bigint", "r:bigint", "mult:bigint"]
    assert sorted(map(tuple, got.collect())) == [(1, 2, 2), (3, 4, 1)]
    assert sorted(map(tuple, invert(got).collect())) == [(2, 1), (4, 3)]
    assert sorted(map(tuple, merge(got, got, got.limit(0)).collect())) == [(1, 2, 4), (3, 4, 2)]
    assert relation(df.limit(0), "x", "y").count() == 0
    fan = measured_fanout(got).first()
    assert (fan.pairs, fan.n_rgl, fan.n_lgr) == (2, 1.0, 1.0) and measured_fanout(got.limit(0)).first().n_rgl is None
    assert measured_fanout(got, approximate=True).first().pairs == 2
    drawn = random_relation(spark, 500, 7, 9, seed=3)
    assert drawn.count() == 500 and drawn.agg(F.max("l"), F.max("r")).first() == (6, 8)
    assert sorted(drawn.collect()) == sorted(random_relation(spark, 500, 7, 9, seed=3).collect())


def test_catalog_and_config(spark):
    text = json.dumps({"0": {"entities": {"k": 1000, "d": 500}, "relations": [["k", "d", 50]]}})
    entities, rels = load_config(text, "0", 0.5)
    assert entities["k"].card == 500 and rels == [("k", "d", 50)]
    catalog = Catalog(spark)
    found = catalog.register("kd", entities["k"], entities["d"], spark.createDataFrame([(1, 2), (1, 3), (1, 3)], "l long, r long"), stored=True, measure=True)
    assert (found.n_rgl, found.n_lgr) == (2.0, 1.0)
    back = catalog.register_inverse("kd")
    assert (back.left.name, back.n_rgl) == ("d", 1.0) and sorted(map(tuple, catalog.pairs["kd_inv"].collect())) == [(2, 1), (3, 1)]


def test_navigation(spark):
    df = relation(spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 1)], "k string, d long"), "k", "d")
    nav = Navigator(df, ["l", "r"])
    assert [r[0] for r in nav.scan(ordered=True).collect()] == ["a", "b"]
    assert sorted(map(tuple, nav.dump().collect())) == [("a", 3), ("b", 1)]
    assert sorted(map(tuple, nav.look_up("a").dump().collect())) == [(1, 1), (2, 2)]
    assert nav.look_up("b").exists() and not nav.look_up("zz").exists()
    with pytest.raises(ValueError):
        nav.look_up("a").look_up(1)
    assert look_up(df, {"r": 1}).count() == 2 and restrict(df, "l", ["b"]).count() == 1
    assert restrict(df, "r", spark.createDataFrame([(2,), (2,)], "v long")).count() == 1


def test_text(spark, tmp_path):
    (tmp_path / "corpus.txt").write_text("a b c\na b\na a d\nb b e\nc a")
    docs = T.read_lines(spark, str(tmp_path / "corpus.txt"))
    want = [("a", 1, 0), ("a", 2, 0), ("a", 3, 0), ("a", 3, 1), ("a", 5, 1), ("b", 1, 1), ("b", 2, 1), ("b", 4, 0), ("b", 4, 1), ("c", 1, 2), ("c", 5, 0), ("d", 3, 2), ("e", 4, 2)]
    assert sorted(map(tuple, T.inverted_index(docs).collect())) == [(*w, 1) for w in want]
    odd = spark.createDataFrame([(1, "  x \t y  ((z)),_9 ", "see #city{new york} and #car{}#x y{z}"), (2, None, None)], "doc_id long, text string, note string")
    assert odd.select(T.clean(F.col("text")), T.keep_rule_characters(F.col("text"))).first()[:] == ("x y ((z)),_9", "xy((z)),_")
    assert sorted(map(tuple, T.tags(odd, text="note").collect())) == [(1, "car", ""), (1, "city", "new york")]
    assert odd.select(T.split_literal(F.lit("a.b..c"), ".")).first()[0] == ["a", "b", "", "c"]
    assert T.tokens(odd, "doc_id", "text").count() == 3
    assert T.normalise([1, 3]) == [0.25, 0.75]
    with pytest.raises(ValueError):
        T.normalise([0.0])


def test_storage(spark, tmp_path):
    df = spark.range(20).select(F.col("id"), (F.col("id") % 3).alias("g"))
    assert write_table(df, str(tmp_path / "t"), ["g", "id"]).count() == 20
    check_schema(df, df.schema)
    with pytest.raises(ValueError):
        check_schema(df, st.StructType([st.StructField("id", st.StringType())]))
    append_csv(df, str(tmp_path / "csv"))
    append_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 40
    scaled = min_max_normalised(df, "id").agg(F.min("id"), F.max("id")).first()
    assert tuple(scaled) == (0.0, 1.0)


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_plans(spark, sf_dir, data):
    """Leaf values reach the scan, columns are pruned, bucketed joins need no exchange, nothing runs Python."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    found = plan_of(look_up(relation(lines, "l_partkey", "l_orderkey"), {"l": 982}))
    assert "EqualTo(l_partkey,982)" in found and "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in found
    _, pairs = data
    whole = plan_of(tree_join(TREE, pairs))
    assert "CartesianProduct" not in whole and "Python" not in whole and "Arrow" not in whole
    one = write_bucketed(pairs["ab"].toDF("a", "b"), "t_ab", ["b"], 4)
    two = write_bucketed(pairs["bc"].toDF("b", "c"), "t_bc", ["b"], 4)
    joined = one.hint("merge").join(two, "b")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_view_of_equal_key_with_other_names(spark, data):
    _, pairs = data
    engine = Engine(spark, pairs)
    spec = ViewSpec(JoinTree.compose(C, "z", [(BC, JoinTree.edge(AB, "u", "w")), (XC, JoinTree.leaf(X, "v"))]))
    turned = ViewSpec(JoinTree.compose(C, "m", [(XC, JoinTree.leaf(X, "n")), (BC, JoinTree.edge(AB, "o", "p"))]))
    engine.materialize(spec)
    assert spec.key == turned.key
    instances = spark.createDataFrame([(a, b, x) for a in range(4) for b in range(4) for x in range(3)], "a1 long, a2 long, x long")
    want = sorted(map(tuple, engine.run_direct(QUERY, instances).collect()))
    assert sorted(map(tuple, engine.run(find_covers(turned, QUERY), instances).collect())) == want


def test_instances_are_answered_from_what_they_reach(spark, sf_dir):
    """Raw relations are restricted by the instances before they are made distinct; the answers are those of distinct ones."""
    from treeline import queries as Q

    names = ("part_order", "supplier_order", "order_customer")
    query = QueryTemplate("depth2", Q.DEPTH2)
    asked = spark.createDataFrame([(i, p, s) for i, (p, s) in enumerate([(1, 1), (982, 22), (-1, 3), (5, 7), (5, 7)])], "iid long, p long, s long")
    direct = Engine(spark, Q.pairs(spark, sf_dir, *names), Q.raw(spark, sf_dir, *names)).run_direct(query, asked)
    want = Engine(spark, Q.pairs(spark, sf_dir, *names)).run([*base_covers(query)], asked)
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, want.collect()))
    plan = direct._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate [p") :] if "Aggregate [p" in plan else plan
    assert "LeftSemi" in plan and plan.index("Aggregate") < plan.index("LeftSemi") and "LeftSemi" in below


def test_inverted_index_moves_texts_once(spark, sf_dir):
    index = T.inverted_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "hashpartitioning(doc_id" in plan


def test_bucketed_views_join_without_exchange(spark, data):
    _, pairs = data
    engine = Engine(spark, pairs, buckets=4)
    one, two = ViewSpec(JoinTree.edge(AB, "b1", "m")), ViewSpec(JoinTree.compose(B, "m", [(AB, JoinTree.leaf(A, "b1"))]))
    left = engine.materialize(one)
    key = left.columns[0]
    right = engine.materialize(two).withColumnRenamed("m" if key == "b1" else "b1", "other")
    joined = left.hint("merge").join(right, key)
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == left.alias("x").join(left.alias("y"), key).count()


def test_bound_views_are_checked(spark, data):
    _, pairs = data
    engine, spec = Engine(spark, pairs), ViewSpec(JoinTree.edge(AB, "x", "y"))
    good = engine.materialize(spec)
    assert engine.bind(spec, good) is good
    for bad in (good.select(*reversed(good.columns)), good.withColumn("x", F.col("x").cast("string")), good.select("x"), good.withColumn("z", F.lit(1))):
        with pytest.raises(ValueError):
            engine.bind(spec, bad)


def test_explained_covers(spark, data):
    _, pairs = data
    engine, instances = Engine(spark, pairs), spark.createDataFrame([(0, 1, 2)], "a1 long, a2 long, x long")
    covers = base_covers(QUERY)
    engine.materialize(covers[0].view)
    said = engine.explain(covers, instances)
    assert said.count("view ") >= len(QUERY.goals) and "stored view" in said and "joined view" in said and "Physical Plan" in said


def test_lines_of_several_files_and_splits(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    (folder / "a.txt").write_text("".join(f"a{i}\n" for i in range(3000)))
    (folder / "b.txt").write_text("b0\n\nb2\r\nb3")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        docs = T.read_lines(spark, str(folder))
        assert docs.rdd.getNumPartitions() >= 1
        got = sorted(map(tuple, docs.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i + 1, f"a{i}") for i in range(3000)] + [(3001, "b0"), (3002, ""), (3003, "b2\r"), (3004, "b3")]


def test_ordered_scans_held_columns_and_draws(spark):
    df = spark.createDataFrame([(3, 1), (1, 1), (2, 5), (1, 7)], "l long, r long")
    nav = Navigator(df, ["l", "r"]).hold()
    assert [r.l for r in nav.scan(ordered=True).collect()] == [1, 2, 3] and nav.held.is_cached
    nav.held.unpersist()
    u = spark.range(1000).select((F.col("id") / 1000).alias("u")).select(stats.sample_index(F.col("u"), [1, 0, 2, 1]).alias("k"))
    assert {r.k: r["count"] for r in u.groupBy("k").count().collect()} == {0: 250, 2: 500, 3: 250}
    assert spark.range(1).select(stats.sample_index(F.lit(0.4), [5])).first()[0] == 0


def test_fanout_plan_makes_pairs_distinct_once(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    found = measured_fanout(relation(lines, "l_partkey", "l_orderkey").select("l", "r"))
    assert "Expand" not in plan_of(found)
    want = lines.agg(F.count_distinct("l_partkey", "l_orderkey"), F.count_distinct("l_partkey"), F.count_distinct("l_orderkey")).first()
    assert tuple(found.select("pairs", "lefts", "rights").first()) == tuple(want)


def test_batches_and_scratch_folders(spark, tmp_path):
    from treeline.sources import storage
    from treeline.streaming.append import append_stream, compact, unmerged

    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "u long, t string")
    for k in range(2):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    append_stream(stream, "u", "t", str(tmp_path / "rows"), str(tmp_path / "log")).awaitTermination()
    assert sorted(map(tuple, unmerged(spark, str(tmp_path / "rows")).collect())) == [(k, *r) for k in range(2) for r in ((1, "a", 2), (2, "b", 1))]
    assert sorted(map(tuple, compact(spark, str(tmp_path / "rows"), str(tmp_path / "all")).collect())) == [(1, "a", 4), (2, "b", 2)]
    before = dict(storage._made)
    path = storage.scratch_path(spark, "gone")
    rows.write.parquet(path)
    storage.delete(spark, path)
    assert storage._made == before and not (tmp_path / path).exists()
