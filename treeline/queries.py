"""Registered queries of the relational operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import text as T
from treeline.functions.stats import estimated_fanout_column, measured_fanout, min_max_normalised, sample_index
from treeline.model import Entity, JoinTree, QueryTemplate, Relation
from treeline.operators.joins import tree_join
from treeline.operators.navigator import Navigator, look_up, restrict
from treeline.plans.advisor import Advisor, Pick, Result
from treeline.plans.cost import CostParams, ViewSpec
from treeline.plans.cover import find_covers
from treeline.plans.engine import Engine, base_covers
from treeline.plans.generate import random_workload
from treeline.sources.catalog import Catalog, invert, load_config, merge, random_relation, raw_pairs, relation
from treeline.sources.storage import append_csv, scratch_path, write_table
from treeline.streaming.append import append_stream, current, unmerged

PART, SUPPLIER, ORDER, CUSTOMER, SEGMENT, NATION, REGION, TOKEN, DOCUMENT, LANG, USER, EVENT_TYPE = (
    Entity(n) for n in ("part", "supplier", "order", "customer", "segment", "nation", "region", "token", "document", "lang", "user", "event_type")
)
#: name: (left, right, table, left column, right column)
RELATIONS = {
    "part_order": (PART, ORDER, "lineitem", "l_partkey", "l_orderkey"),
    "supplier_order": (SUPPLIER, ORDER, "lineitem", "l_suppkey", "l_orderkey"),
    "order_customer": (ORDER, CUSTOMER, "orders", "o_orderkey", "o_custkey"),
    "segment_customer": (SEGMENT, CUSTOMER, "customer", "c_mktsegment", "c_custkey"),
    "customer_nation": (CUSTOMER, NATION, "customer", "c_custkey", "c_nationkey"),
    "nation_region": (NATION, REGION, "nation", "n_nationkey", "n_regionkey"),
    "document_lang": (DOCUMENT, LANG, "documents", "doc_id", "lang"),
    "user_type": (USER, EVENT_TYPE, "events", "user_id", "event_type"),
}
REL = {k: Relation(k, v[0], v[1]) for k, v in RELATIONS.items()} | {"token_document": Relation("token_document", TOKEN, DOCUMENT)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _, _, source, left, right = RELATIONS[name]
    return relation(table(spark, sf_dir, source), left, right)


def raw(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: raw_pairs(table(spark, sf_dir, RELATIONS[n][2]), *RELATIONS[n][3:]) for n in names}


def pairs(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: counted(spark, sf_dir, n).select("l", "r") for n in names}


def leaf(entity: Entity, name: str, const=None) -> JoinTree:
    return JoinTree.leaf(entity, name, const)


PART_EDGE = JoinTree.edge(REL["part_order"], "p", "o")
TWO_LEAF = JoinTree.compose(ORDER, "o", [(REL["part_order"], leaf(PART, "p")), (REL["supplier_order"], leaf(SUPPLIER, "s"))])
DEPTH2 = JoinTree.compose(CUSTOMER, "c", [(REL["order_customer"], TWO_LEAF)])
SELF = JoinTree.compose(ORDER, "o", [(REL["part_order"], leaf(PART, "p1")), (REL["part_order"], leaf(PART, "p2"))])
WORKED = JoinTree.compose(CUSTOMER, "e", [(REL["order_customer"], JoinTree.compose(ORDER, "d", [(REL["part_order"], leaf(PART, "k1")), (REL["part_order"], leaf(PART, "k2"))])), (REL["segment_customer"], leaf(SEGMENT, "c"))])


def branch(segment=None) -> JoinTree:
    customer = JoinTree.compose(CUSTOMER, "c", [(REL["order_customer"], PART_EDGE), (REL["segment_customer"], leaf(SEGMENT, "segment", segment))])
    nation = JoinTree.compose(NATION, "nation", [(REL["customer_nation"], customer)])
    return JoinTree.compose(REGION, "region", [(REL["nation_region"], nation)])


BATCH = [(0, 982, 22), (1, 1, 1), (2, 5, 7), (3, -1, 7)]


def instances(spark: SparkSession, rows: list[tuple[int, int, int]]) -> DataFrame:
    """A literal batch, whose size the optimizer knows: it is broadcast as long as it is small."""
    return spark.sql(f"select * from values {', '.join(f'({i}L, {p}L, {s}L)' for i, p, s in rows)} as t(iid, p, s)")


def _wide_views(engine: Engine, query: QueryTemplate):
    """Covers of *query* by two overlapping stored views, part-order-customer and supplier-order-customer."""
    covers = []
    for rel, name in (("part_order", "p"), ("supplier_order", "s")):
        edge = JoinTree.edge(REL[rel], name, "o")
        spec = ViewSpec(JoinTree.compose(CUSTOMER, "c", [(REL["order_customer"], edge)]))
        engine.materialize(spec)
        covers += find_covers(spec, query)
    return covers


# -- relations and navigation ----------------------------------------------------
def rel_mult(spark, sf_dir):
    return counted(spark, sf_dir, "part_order")


def rel_invert(spark, sf_dir):
    return invert(counted(spark, sf_dir, "part_order"))


def rel_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    halves = [relation(rows.where(F.col("l_linenumber") % 2 == k), "l_partkey", "l_orderkey") for k in (0, 1)]
    return merge(*halves)


def nav_scan(spark, sf_dir):
    return Navigator(counted(spark, sf_dir, "supplier_order").withColumnRenamed("l", "s"), ["s", "r"]).scan()


def nav_lookup(spark, sf_dir):
    return Navigator(counted(spark, sf_dir, "part_order").toDF("p", "o", "mult"), ["p", "o"]).look_up(982).scan()


def nav_dump(spark, sf_dir):
    return Navigator(counted(spark, sf_dir, "part_order").toDF("p", "o", "mult"), ["p", "o"]).look_up(982).dump()


def nav_holes(spark, sf_dir):
    view = tree_join(DEPTH2, pairs(spark, sf_dir, "part_order", "supplier_order", "order_customer"))
    return look_up(view, {"s": 22, "c": 928})


def semi_domain(spark, sf_dir):
    return restrict(look_up(counted(spark, sf_dir, "part_order"), {"l": 982}).select(F.col("r").alias("o")), "o", look_up(counted(spark, sf_dir, "supplier_order"), {"l": 22}).select("r"))


def set_diff(spark, sf_dir):
    left = look_up(counted(spark, sf_dir, "part_order"), {"l": 982}).select(F.col("r").alias("o"))
    return left.subtract(look_up(counted(spark, sf_dir, "supplier_order"), {"l": 22}).select(F.col("r").alias("o")))


def fanout(spark, sf_dir):
    found = measured_fanout(pairs(spark, sf_dir, "part_order")["part_order"])
    return found.select(F.round("n_rgl", 6).alias("n_rgl"), F.round("n_lgr", 6).alias("n_lgr"))


def fanout_estimate(spark, sf_dir):
    one = counted(spark, sf_dir, "part_order").agg(F.sum("mult").cast("double").alias("n"), F.count_distinct("l").alias("a"), F.count_distinct("r").alias("b"))
    return one.select(F.round(estimated_fanout_column(F.col("n"), F.col("a"), F.col("b")), 4).alias("n_rgl"), F.round(estimated_fanout_column(F.col("n"), F.col("b"), F.col("a")), 4).alias("n_lgr"))


def balance_scaled(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return min_max_normalised(rows, "c_acctbal").select("c_custkey", F.round("c_acctbal", 6).alias("scaled"))


# -- text ------------------------------------------------------------------------
def inverted_index(spark, sf_dir):
    return T.inverted_index(table(spark, sf_dir, "documents"))


def rule_characters(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.keep_rule_characters(F.col("text"))).alias("kept_md5"), F.size(T.split_literal(F.col("text"), ". ")).cast("long").alias("n_pieces"))


def kw2(spark, sf_dir):
    found = T.tokens(table(spark, sf_dir, "documents"), "doc_id", "text").where(F.col("k").isin("un", "la"))
    # Stored, so that both keywords are read from one pass over the texts.
    held = write_table(relation(found, "k", "d").select("l", "r"), scratch_path(spark, "keywords"))
    own = pairs(spark, sf_dir, "document_lang") | {"token_document": held}
    tree = JoinTree.compose(LANG, "lang", [(REL["document_lang"], JoinTree.compose(DOCUMENT, "d", [(REL["token_document"], leaf(TOKEN, "k1", "un")), (REL["token_document"], leaf(TOKEN, "k2", "la"))]))])
    return tree_join(tree, own)


# -- trees -------------------------------------------------------------------------
def tree_1edge(spark, sf_dir):
    return tree_join(PART_EDGE, pairs(spark, sf_dir, "part_order"))


def tree_2leaf(spark, sf_dir):
    return tree_join(TWO_LEAF, pairs(spark, sf_dir, "part_order", "supplier_order"))


def tree_depth2(spark, sf_dir):
    return tree_join(DEPTH2, pairs(spark, sf_dir, "part_order", "supplier_order", "order_customer"))


def tree_branch(spark, sf_dir):
    return tree_join(branch(), pairs(spark, sf_dir, "part_order", "order_customer", "segment_customer", "customer_nation", "nation_region"))


def tree_const_leaf(spark, sf_dir):
    return tree_join(branch("HOUSEHOLD"), pairs(spark, sf_dir, "part_order", "order_customer", "segment_customer", "customer_nation", "nation_region"))


def tree_selfjoin(spark, sf_dir):
    return tree_join(SELF, pairs(spark, sf_dir, "part_order"), {"p1": [982], "p2": [982]})


def user_type(spark, sf_dir):
    return tree_join(JoinTree.edge(REL["user_type"], "u", "t"), pairs(spark, sf_dir, "user_type"))


# -- instances and views ---------------------------------------------------------
def _depth2_engine(spark, sf_dir) -> tuple[Engine, QueryTemplate]:
    names = ("part_order", "supplier_order", "order_customer")
    return Engine(spark, pairs(spark, sf_dir, *names), raw(spark, sf_dir, *names)), QueryTemplate("depth2", DEPTH2)


def instance(spark, sf_dir):
    engine, query = _depth2_engine(spark, sf_dir)
    return engine.run_direct(query, instances(spark, BATCH[:1]).drop("iid"))


def instance_absent(spark, sf_dir):
    engine, query = _depth2_engine(spark, sf_dir)
    return engine.run_direct(query, instances(spark, [(0, -1, 22)]).drop("iid"))


def batch(spark, sf_dir):
    engine, query = _depth2_engine(spark, sf_dir)
    return engine.run_direct(query, instances(spark, BATCH))


def view_rewrite(spark, sf_dir):
    engine, query = _depth2_engine(spark, sf_dir)
    return engine.run(_wide_views(engine, query), instances(spark, BATCH))


def view_build(spark, sf_dir):
    engine = Engine(spark, pairs(spark, sf_dir, "part_order", "order_customer"))
    return engine.materialize(ViewSpec(JoinTree.compose(CUSTOMER, "c", [(REL["order_customer"], PART_EDGE)]))).select("p", "o", "c")


def worked_rewriting(spark, sf_dir):
    """Every two parts of any order, in one order of a customer of a segment, through views that cover a goal twice."""
    engine = Engine(spark, pairs(spark, sf_dir, "part_order", "order_customer", "segment_customer"))
    query = QueryTemplate("worked", WORKED)
    chain = JoinTree.compose(CUSTOMER, "e", [(REL["order_customer"], JoinTree.edge(REL["part_order"], "k", "d"))])
    spec = ViewSpec(chain.add_leaf(0, REL["segment_customer"], "c"))
    engine.materialize(spec)
    parts = relation(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")
    asked = parts.alias("a").join(parts.alias("b"), "l").where("a.r < b.r").select(F.col("a.r").alias("k1"), F.col("b.r").alias("k2")).distinct()
    asked = asked.select("k1", "k2", F.explode(F.array(F.lit("HOUSEHOLD"), F.lit("BUILDING"))).alias("c"))
    return engine.run(find_covers(spec, query), asked)


# -- advisor -----------------------------------------------------------------------
def _designed(spark, sf_dir) -> tuple[Engine, Result]:
    """A measured catalog, a workload over it and its best design."""
    catalog = Catalog(spark)
    names = ("part_order", "supplier_order", "order_customer", "segment_customer")
    cards: dict[str, float] = {}
    measured = {}
    for n in names:
        left, right = RELATIONS[n][:2]
        catalog.register(n, left, right, table(spark, sf_dir, RELATIONS[n][2]), RELATIONS[n][3:])
        row = measured[n] = measured_fanout(catalog.pairs[n]).first()
        cards[left.name] = max(cards.get(left.name, 1.0), float(row.lefts))
        cards[right.name] = max(cards.get(right.name, 1.0), float(row.rights))
    own = {n: Relation(n, Entity(r[0].name, cards[r[0].name]), Entity(r[1].name, cards[r[1].name]), measured[n].n_rgl, measured[n].n_lgr) for n in names for r in (RELATIONS[n],)}

    def measured_tree(tree: JoinTree) -> JoinTree:
        nodes = tuple(replace(n, entity=Entity(n.entity.name, cards[n.entity.name])) for n in tree.nodes)
        return JoinTree(nodes, tree.parents, tuple(r and own[r.name] for r in tree.relations))

    queries = [QueryTemplate("depth2", measured_tree(DEPTH2), 0.6), QueryTemplate("worked", measured_tree(WORKED), 0.4)]
    advisor = Advisor(queries, CostParams(seek=10000, first_limit=1010, last_limit=2**32 - 1, wt_maint=0.1), max_depth=3, max_maint=1e8)
    return Engine(spark, catalog.pairs), advisor.optimize(Pick.LOWER, max_iters=200)


def advisor_design(spark, sf_dir):
    _, result = _designed(spark, sf_dir)
    rows = [(str(v.tree), float(v.maintenance), sum(c.view is v for q in result.advisor.queries for c in result.covers_of(q))) for v in result.stored_views]
    return spark.createDataFrame(rows, "view string, maintenance double, n_covers long")


def designed_batch(spark, sf_dir):
    """The batch answered from whatever views the advisor chose."""
    engine, result = _designed(spark, sf_dir)
    engine.create_views(result)
    return engine.run(result.covers_of(result.advisor.queries[0]), instances(spark, BATCH))


def expanded_states(spark, sf_dir):
    """States made and cost at every improvement, for each pick function on one random workload."""
    keyword, document, entity, category = Entity("keyword", 1000), Entity("document", 1000), Entity("entity", 800), Entity("category", 10)
    rels = [Relation("kd", keyword, document, 48.794, 48.794), Relation("ed", entity, document, 12.428, 9.944), Relation("ec", entity, category, 1.0, 76.175)]
    rels += [r.inverse() for r in rels]
    queries = random_workload(rels, 2, 2, seed=3)
    rows = []
    for pick in Pick:
        result = Advisor(queries, CostParams(10000, 1010, 2**32 - 1, 0.1)).optimize(pick, refresh=1, num_expand=4, max_iters=300)
        rows += [(pick.name, i, states, float(cost)) for i, (states, cost) in enumerate(result.trace)]
    return spark.createDataFrame(rows, "pick string, step long, states long, cost double")


# -- streaming ---------------------------------------------------------------------
def stream_counts(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    path = scratch_path(spark, "stream")
    # A glob is taken as it is, whether it finds one file or a folder of them.
    append_stream(spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet"), "user_id", "event_type", f"{path}/rows", f"{path}/log").awaitTermination()
    return current(spark, f"{path}/rows")


# -- sources, samples and the rest -------------------------------------------------
CONFIG = '{"small": {"entities": {"document": 1000, "entity": 800, "category": 10}, "relations": [["document", "entity", 9944], ["entity", "category", 800]]}}'
WEIGHTS = [3.0, 1.0, 4.0, 2.0]
#: Least cost of ``_small_workload``; tests/test_plans.py finds it by trying every set of covers.
SMALL_OPTIMUM = 105.039719


def config_catalog(spark, sf_dir):
    """Entities and relations of a JSON catalog at half its scale, as a table."""
    entities, relations = load_config(CONFIG, "small", 0.5)
    rows = [(e.name, None, float(e.card)) for e in entities.values()] + [(a, b, float(n)) for a, b, n in relations]
    return spark.createDataFrame(rows, "left string, right string, size double")


def text_lines(spark, sf_dir):
    """Documents written as lines of a text file and read back as numbered documents."""
    path = scratch_path(spark, "lines")
    names = table(spark, sf_dir, "customer").select(F.concat_ws("|", F.col("c_custkey"), F.col("c_mktsegment")).alias("value"), "c_custkey")
    names.orderBy("c_custkey").select("value").write.text(path)
    return T.read_lines(spark, path).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def csv_appended(spark, sf_dir):
    """Rows appended to a CSV folder in two goes and read back."""
    path, nations = scratch_path(spark, "csv"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    for part in (nations.where("n_regionkey < 2"), nations.where("n_regionkey >= 2")):
        append_csv(part, path)
    return spark.read.option("header", True).schema("n_nationkey long, n_name string, n_regionkey long").csv(path)


def random_pairs(spark, sf_dir):
    """What a random relation has to keep to: so many pairs, all inside both domains, no two domains alike."""
    own = random_relation(spark, 50_000, 400, 30, seed=3)
    return own.agg(F.count("*").alias("n"), F.min("l").alias("least_l"), F.max("l").alias("most_l"), F.min("r").alias("least_r"), F.max("r").alias("most_r"), F.count_distinct("l").alias("lefts"), F.count_distinct("r").alias("rights"))


def tags_of_documents(spark, sf_dir):
    """Tags put before every text and found in it."""
    text = F.concat(F.lit("#lang{"), F.coalesce("lang", F.lit("-")), F.lit("} #from{"), F.coalesce("source", F.lit("-")), F.lit("} "), F.translate(F.coalesce("text", F.lit("")), "#", ""))
    return T.tags(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))


def scan_ordered(spark, sf_dir):
    return Navigator(counted(spark, sf_dir, "supplier_order").withColumnRenamed("l", "s"), ["s", "r"]).hold().scan(ordered=True)


def cross_parts(spark, sf_dir):
    """Instances that bind no node of the tree: each meets every assignment."""
    engine = Engine(spark, pairs(spark, sf_dir, "nation_region"))
    return engine.run_direct(QueryTemplate("all", JoinTree.edge(REL["nation_region"], "n", "region")), spark.createDataFrame([(0,), (1,)], "iid long"))


def weights_normalised(spark, sf_dir):
    return spark.createDataFrame([(k, round(w, 9)) for k, w in enumerate(T.normalise(WEIGHTS))], "k long, weight double")


def multinomial_draws(spark, sf_dir):
    """One of four classes for each customer, drawn by a number that follows from its key."""
    u = F.pmod(F.col("c_custkey") * 7919, F.lit(10007)) / F.lit(10007.0)
    return table(spark, sf_dir, "customer").select("c_custkey", sample_index(u, WEIGHTS).cast("long").alias("k"))


def bound_views(spark, sf_dir):
    """Views bucketed by their first column, bound after a check of their schema, and joined."""
    engine = Engine(spark, pairs(spark, sf_dir, "part_order", "supplier_order", "order_customer"), buckets=8)
    query = QueryTemplate("depth2", DEPTH2)
    return engine.run(_wide_views(engine, query), instances(spark, BATCH))


def cover_plan(spark, sf_dir):
    """The covers of a query by its base relations: goal, relation, node below and node above."""
    rows = [(min(c.goals), DEPTH2.relations[min(c.goals)].name, *(DEPTH2.nodes[q].name for q in c.mapping)) for c in base_covers(QueryTemplate("depth2", DEPTH2))]
    return spark.createDataFrame(rows, "goal long, relation string, above string, below string")


def stream_batches(spark, sf_dir):
    """What the stream has written batch by batch, not merged: its counts, and that no batch holds a pair twice."""
    schema = table(spark, sf_dir, "events").schema
    path = scratch_path(spark, "stream")
    append_stream(spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet"), "user_id", "event_type", f"{path}/rows", f"{path}/log").awaitTermination()
    own = unmerged(spark, f"{path}/rows")
    return own.agg(F.sum("mult").alias("events"), F.count_distinct("l", "r").alias("pairs"), (F.count("*") - F.count_distinct("epoch", "l", "r")).alias("twice"))


def search_optimum(spark, sf_dir):
    """The cost the full search ends with, whatever it looks at first."""
    rows = []
    for pick in Pick:
        result = Advisor(_small_workload(), CostParams(10, 100, 2**32 - 1, 0.1), max_depth=3).optimize(pick)
        rows.append((pick.name, round(float(result.cost), 6)))
    return spark.createDataFrame(rows, "pick string, cost double")


def _small_workload() -> list[QueryTemplate]:
    """Two templates over three relations, small enough for every set of covers to be tried."""
    a, b, c, d = (Entity(n, card) for n, card in (("a", 100), ("b", 50), ("c", 20), ("d", 10)))
    ab, bc, dc = Relation("ab", a, b, 3.0, 6.0), Relation("bc", b, c, 2.0, 5.0), Relation("dc", d, c, 4.0, 2.0)
    chain = JoinTree.compose(c, "z", [(bc, JoinTree.edge(ab, "x", "y"))])
    return [QueryTemplate("chain", chain, 0.7), QueryTemplate("fork", chain.add_leaf(0, dc, "w"), 0.3)]


_QUERIES = (
    rel_mult, rel_invert, rel_merge, nav_scan, nav_lookup, nav_dump, nav_holes, semi_domain, set_diff, fanout, fanout_estimate, balance_scaled, inverted_index, rule_characters, kw2,
    tree_1edge, tree_2leaf, tree_depth2, tree_branch, tree_const_leaf, tree_selfjoin, user_type, instance, instance_absent, batch, view_rewrite, view_build, worked_rewriting,
    advisor_design, designed_batch, expanded_states, stream_counts, config_catalog, text_lines, csv_appended, random_pairs, tags_of_documents, scan_ordered,
    cross_parts, weights_normalised, multinomial_draws, bound_views, cover_plan, stream_batches, search_optimum,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_PO = "(select distinct l_partkey p, l_orderkey o from lineitem)"
_SO = "(select distinct l_suppkey s, l_orderkey o from lineitem)"
_OC = "(select distinct o_orderkey o, o_custkey c from orders)"
_MULT = "select l_partkey l, l_orderkey r, count(*) mult from lineitem group by 1, 2"
_DEPTH2 = f"{_PO} join {_SO} using (o) join {_OC} using (o)"
_BRANCH = f"select p, o, c, c_mktsegment segment, c_nationkey::bigint nation, n_regionkey::bigint region from {_PO} join {_OC} using (o) join customer on c = c_custkey join nation on c_nationkey = n_nationkey"
_BATCH = f"select iid, c, o, p, s from (values {', '.join(f'({a}::bigint, {b}::bigint, {c}::bigint)' for a, b, c in BATCH)}) i(iid, p, s) join {_PO} using (p) join {_SO} using (s, o) join {_OC} using (o)"


def oracle_sql() -> dict[str, str]:
    return {
        "rel_mult": _MULT,
        "rel_invert": "select distinct l_orderkey l, l_partkey r from lineitem",
        "rel_merge": _MULT,
        "nav_scan": "select distinct l_suppkey s from lineitem",
        "nav_lookup": "select distinct l_orderkey o from lineitem where l_partkey = 982",
        "nav_dump": "select l_orderkey o, count(*) mult from lineitem where l_partkey = 982 group by 1",
        "nav_holes": f"select c, o, p, s from {_DEPTH2} where s = 22 and c = 928",
        "semi_domain": "select l_orderkey o from lineitem where l_partkey = 982 intersect select l_orderkey from lineitem where l_suppkey = 22",
        "set_diff": "select l_orderkey o from lineitem where l_partkey = 982 except select l_orderkey from lineitem where l_suppkey = 22",
        "fanout": "select round(count(distinct (l_partkey, l_orderkey)) / count(distinct l_partkey), 6) n_rgl, round(count(distinct (l_partkey, l_orderkey)) / count(distinct l_orderkey), 6) n_lgr from lineitem",
        "fanout_estimate": "select round(b * (1 - pow(1 - 1 / b, n / a)), 4) n_rgl, round(a * (1 - pow(1 - 1 / a, n / b)), 4) n_lgr from (select count(*)::double n, count(distinct l_partkey)::double a, count(distinct l_orderkey)::double b from lineitem)",
        "balance_scaled": "select c_custkey, round((c_acctbal - min(c_acctbal) over ()) / (max(c_acctbal) over () - min(c_acctbal) over ()), 6) scaled from customer",
        "inverted_index": r"select tok k, doc_id d, pos - 1 p, count(*) mult from (select doc_id, unnest(t) tok, generate_subscripts(t, 1) pos from (select doc_id, regexp_split_to_array(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s{2,}', ' ', 'g'), '\s') t from documents)) group by 1, 2, 3",
        "rule_characters": "select doc_id, md5(regexp_replace(text, '[^A-Za-z_(),]', '', 'g')) kept_md5, len(string_split(text, '. '))::bigint n_pieces from documents",
        "kw2": r"select lang, doc_id d, 'un' k1, 'la' k2 from (select doc_id, lang, regexp_split_to_array(text, '\s+') t from documents) where list_contains(t, 'un') and list_contains(t, 'la')",
        "tree_1edge": f"select o, p from {_PO}",
        "tree_2leaf": f"select o, p, s from {_PO} join {_SO} using (o)",
        "tree_depth2": f"select c, o, p, s from {_DEPTH2}",
        "tree_branch": _BRANCH,
        "tree_const_leaf": f"{_BRANCH} where c_mktsegment = 'HOUSEHOLD'",
        "tree_selfjoin": f"select o, 982::bigint p1, 982::bigint p2 from {_PO} where p = 982",
        "user_type": "select distinct user_id u, event_type t from events",
        "instance": f"select c, o, p, s from {_DEPTH2} where p = 982 and s = 22",
        "instance_absent": f"select c, o, p, s from {_DEPTH2} where p = -1 and s = 22",
        "batch": _BATCH,
        "view_rewrite": _BATCH,
        "designed_batch": _BATCH,
        "view_build": f"select p, o, c from {_PO} join {_OC} using (o)",
        "worked_rewriting": f"""with a as (select distinct x.l_partkey k1, y.l_partkey k2 from lineitem x join lineitem y using (l_orderkey) where x.l_partkey < y.l_partkey)
            select x.c e, o d, k1, k2, c_mktsegment c from a join (select p k1, o from {_PO}) using (k1) join (select p k2, o from {_PO}) using (k2, o) join {_OC} x using (o)
            join customer on x.c = c_custkey where c_mktsegment in ('HOUSEHOLD', 'BUILDING')""",
        "config_catalog": "select * from (values ('document', null, 500.0::double), ('entity', null, 400.0), ('category', null, 5.0), ('document', 'entity', 9944.0), ('entity', 'category', 800.0)) t(\"left\", \"right\", size)",
        "text_lines": "select row_number() over (order by c_custkey) doc_id, len(t)::bigint n_chars, md5(t) text_md5 from (select c_custkey, c_custkey || '|' || c_mktsegment t from customer)",
        "csv_appended": "select n_nationkey::bigint n_nationkey, n_name, n_regionkey::bigint n_regionkey from nation",
        "random_pairs": "select 50000::bigint n, 0::bigint least_l, 399::bigint most_l, 0::bigint least_r, 29::bigint most_r, 400::bigint lefts, 30::bigint rights",
        "tags_of_documents": "select doc_id d, 'lang' tag, coalesce(lang, '-') \"value\" from documents union all select doc_id, 'from', coalesce(source, '-') from documents",
        "scan_ordered": "select distinct l_suppkey s from lineitem order by 1",
        "cross_parts": "select iid, n_regionkey::bigint region, n_nationkey::bigint n from (values (0::bigint), (1::bigint)) i(iid), nation",
        "weights_normalised": "select * from (values (0::bigint, 0.3::double), (1, 0.1), (2, 0.4), (3, 0.2)) t(k, weight)",
        "multinomial_draws": "select c_custkey, case when u < 0.3 then 0 when u < 0.4 then 1 when u < 0.8 then 2 else 3 end::bigint k from (select c_custkey, (c_custkey * 7919 % 10007) / 10007.0::double u from customer)",
        "bound_views": _BATCH,
        "cover_plan": "select * from (values (2::bigint, 'part_order', 'o', 'p'), (3, 'supplier_order', 'o', 's'), (1, 'order_customer', 'c', 'o')) t(goal, relation, above, below)",
        "stream_batches": "select count(*) events, count(distinct (user_id, event_type)) pairs, 0::bigint twice from events",
        "search_optimum": "select * from (values ('LOWER', OPTIMUM::double), ('UPPER', OPTIMUM), ('OPEN', OPTIMUM)) t(pick, cost)".replace("OPTIMUM", str(SMALL_OPTIMUM)),
        "stream_counts": "select user_id l, event_type r, count(*) mult from events group by 1, 2",
    }
