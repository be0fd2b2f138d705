"""Tree joins: whole views, and instances answered over covers.

Relations hold each pair once, so tree joins of them hold each assignment once: nothing is made
distinct after a join.  Joins are on all shared columns and are left to Catalyst and AQE.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.model import JoinTree, QueryTemplate
from treeline.operators.navigator import restrict

if TYPE_CHECKING:
    from treeline.plans.cover import Cover


def tree_join(tree: JoinTree, pairs: dict[str, DataFrame], domains: dict[str, DataFrame | list] | None = None) -> DataFrame:
    """Every assignment of *tree*, a column for each node in node order; *domains* restrict nodes by name."""
    domains = domains or {}
    done: dict[int, DataFrame] = {}
    for n in tree.bottom_up:
        node, acc = tree.nodes[n], None
        for c in tree.children[n]:
            child = tree.nodes[c]
            edge = pairs[tree.relations[c].name].select(F.col("l").alias(child.name), F.col("r").alias(node.name))
            if child.const is not None:
                edge = edge.where(F.col(child.name) == F.lit(child.const))
            for side in (child, node):
                if side.name in domains:
                    edge = restrict(edge, side.name, domains[side.name])
            below = done.pop(c, None)
            branch = edge if below is None else below.join(edge, child.name)
            acc = branch if acc is None else acc.join(branch, node.name)
        if acc is not None:
            done[n] = acc
    return done[tree.root].select(*[n.name for n in tree.nodes])


def cover_frame(cover: Cover, view: DataFrame) -> DataFrame:
    """A stored view's rows under the names of the query's nodes."""
    names = cover.query.tree.nodes
    return view.select(*[F.col(cover.view.tree.nodes[v].name).alias(names[q].name) for v, q in enumerate(cover.mapping)])


def answer(covers: list[Cover], views: dict[tuple, DataFrame], instances: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Answers of a batch of instances over *covers*, which together cover every goal of one query.

    *instances* has a column for each input leaf and any others (such as an id), which stay in front.
    Covers may overlap: each join is on every column both sides have.  Constants are filters.
    """
    query = covers[0].query
    if frozenset().union(*(c.goals for c in covers)) != query.goals:
        raise ValueError("the covers leave goals open")
    frames = [cover_frame(c, views[c.view.key]) for c in sorted(covers, key=lambda c: c.order)]
    return answer_frames(query, frames, instances, keep)


def answer_frames(query: QueryTemplate, frames: list[DataFrame], instances: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The same from *frames*, in the order in which they are best joined, whose columns bear the names of the query's nodes."""
    tree, acc = query.tree, instances
    names = [n.name for n in tree.nodes]
    extra = [c for c in instances.columns if c not in names]
    for n in tree.leaves:
        if tree.nodes[n].const is not None and tree.nodes[n].name not in acc.columns:
            acc = acc.withColumn(tree.nodes[n].name, F.lit(tree.nodes[n].const))
    todo = list(frames)
    while todo:
        # A frame that shares a column with what is there comes first; only else the join is a product.
        frame = next((f for f in todo if set(f.columns) & set(acc.columns)), todo[0])
        todo.remove(frame)
        shared = [c for c in frame.columns if c in acc.columns]
        acc = acc.join(frame, shared) if shared else acc.crossJoin(frame)
    return acc.select(*(keep if keep is not None else extra), *names)


def reduced_edges(tree: JoinTree, edges: Callable[[str], DataFrame], instances: DataFrame) -> dict[int, DataFrame]:
    """The pairs of each edge that the instances can reach, under the nodes' names: an edge over a leaf keeps the leaf's
    values, one above keeps what all edges below it reach.  *edges* gives a relation's pairs, which may repeat: they are made
    distinct here, after the semi-joins, so only what is left of them is shuffled."""
    out: dict[int, DataFrame] = {}
    for n in tree.bottom_up:
        if tree.parents[n] is None:
            continue
        node, parent = tree.nodes[n], tree.nodes[tree.parents[n]]
        edge = edges(tree.relations[n].name).select(F.col("l").alias(node.name), F.col("r").alias(parent.name))
        if node.const is not None:
            edge = edge.where(F.col(node.name) == F.lit(node.const))
        for known in [instances] if node.name in instances.columns else [out[c] for c in tree.children[n]]:
            edge = restrict(edge, node.name, known.select(node.name))
        out[n] = edge.distinct()
    return out
