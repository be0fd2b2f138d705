"""Entities, directed relations, join trees and weighted query templates (driver-side values)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property
from typing import Any


@dataclass(frozen=True)
class Entity:
    """A named domain; *card* is its number of values."""

    name: str
    card: float = 1.0


@dataclass(frozen=True)
class Relation:
    """Directed pairs left -> right; *n_rgl* right values for a left one on average, *n_lgr* the reverse."""

    name: str
    left: Entity
    right: Entity
    n_rgl: float = 1.0
    n_lgr: float = 1.0

    def inverse(self, name: str | None = None) -> Relation:
        return Relation(name or f"{self.name}_inv", self.right, self.left, self.n_lgr, self.n_rgl)


@dataclass(frozen=True)
class Node:
    """A variable of a query; *const* fixes a leaf's value."""

    name: str
    entity: Entity
    const: Any = None


@dataclass(frozen=True)
class JoinTree:
    """Rooted tree; the edge of node *n* to its parent carries ``relations[n]``, from child to parent.

    Leaves are inputs (or constants), inner nodes outputs.  Trees are values: every change makes a new one.
    """

    nodes: tuple[Node, ...]
    parents: tuple[int | None, ...]
    relations: tuple[Relation | None, ...]

    def __post_init__(self):
        if len({n.name for n in self.nodes}) != len(self.nodes):
            raise ValueError("node names must differ")
        if sum(p is None for p in self.parents) != 1:
            raise ValueError("a tree has one root")
        for n, (p, rel) in enumerate(zip(self.parents, self.relations)):
            if (p is None) != (rel is None):
                raise ValueError("every edge needs a relation")
            if rel and (rel.left.name != self.nodes[n].entity.name or rel.right.name != self.nodes[p].entity.name):
                raise ValueError(f"{rel.name} does not lead from {self.nodes[n].name} to {self.nodes[p].name}")
            if self.nodes[n].const is not None and self.children[n]:
                raise ValueError("only leaves can be constant")
        if len(self.bottom_up) != len(self.nodes):
            raise ValueError("the parents form a cycle")

    # -- shape ---------------------------------------------------------------
    @cached_property
    def root(self) -> int:
        return self.parents.index(None)

    @cached_property
    def children(self) -> tuple[tuple[int, ...], ...]:
        return tuple(tuple(c for c, p in enumerate(self.parents) if p == n) for n in range(len(self.nodes)))

    @cached_property
    def leaves(self) -> tuple[int, ...]:
        return tuple(n for n in range(len(self.nodes)) if not self.children[n])

    @cached_property
    def inputs(self) -> tuple[int, ...]:
        return tuple(n for n in self.leaves if self.nodes[n].const is None)

    @cached_property
    def edges(self) -> tuple[int, ...]:
        """Edges by their child, which is how goals are named."""
        return tuple(n for n in range(len(self.nodes)) if self.parents[n] is not None)

    @cached_property
    def bottom_up(self) -> tuple[int, ...]:
        """Children before parents."""
        out, todo = [], [self.root]
        while todo:
            n = todo.pop()
            out.append(n)
            todo += self.children[n]
        return tuple(reversed(out))

    @cached_property
    def levels(self) -> tuple[int, ...]:
        """1 for leaves, else one more than the highest child."""
        out = [1] * len(self.nodes)
        for n in self.bottom_up:
            out[n] = 1 + max((out[c] for c in self.children[n]), default=0)
        return tuple(out)

    @cached_property
    def distances(self) -> tuple[int, ...]:
        """Edges up to the root."""
        out = [0] * len(self.nodes)
        for n in reversed(self.bottom_up):
            if self.parents[n] is not None:
                out[n] = out[self.parents[n]] + 1
        return tuple(out)

    def key(self, n: int | None = None) -> tuple:
        """The same for trees that differ only in names and in the order of siblings."""
        n = self.root if n is None else n
        rel = self.relations[n].name if self.relations[n] else self.nodes[n].entity.name
        return (rel, repr(self.nodes[n].const), tuple(sorted(self.key(c) for c in self.children[n])))

    # -- building ------------------------------------------------------------
    @classmethod
    def leaf(cls, entity: Entity, name: str, const: Any = None) -> JoinTree:
        return cls((Node(name, entity, const),), (None,), (None,))

    @classmethod
    def compose(cls, entity: Entity, name: str, branches: list[tuple[Relation, JoinTree]]) -> JoinTree:
        """A root over subtrees; the root is node 0, the subtrees' nodes follow in order."""
        nodes, parents, relations = [Node(name, entity)], [None], [None]
        for rel, sub in branches:
            shift = len(nodes)
            nodes += sub.nodes
            parents += [0 if p is None else p + shift for p in sub.parents]
            relations += [rel if p is None else r for p, r in zip(sub.parents, sub.relations)]
        return cls(tuple(nodes), tuple(parents), tuple(relations))

    @classmethod
    def edge(cls, rel: Relation, child: str, parent: str, const: Any = None) -> JoinTree:
        return cls.compose(rel.right, parent, [(rel, cls.leaf(rel.left, child, const))])

    def add_leaf(self, at: int, rel: Relation, name: str, const: Any = None) -> JoinTree:
        return JoinTree((*self.nodes, Node(name, rel.left, const)), (*self.parents, at), (*self.relations, rel))

    def add_root(self, rel: Relation, name: str) -> JoinTree:
        top = len(self.nodes)
        parents = tuple(top if p is None else p for p in self.parents)
        relations = tuple(rel if p is None else r for p, r in zip(self.parents, self.relations))
        return JoinTree((*self.nodes, Node(name, rel.right)), (*parents, None), (*relations, None))

    def rename(self, names: list[str]) -> JoinTree:
        return replace(self, nodes=tuple(replace(n, name=x) for n, x in zip(self.nodes, names)))

    def __str__(self) -> str:
        def show(n: int) -> str:
            const = f"={self.nodes[n].const!r}" if self.nodes[n].const is not None else ""
            below = ", ".join(f"{self.relations[c].name}: {show(c)}" for c in self.children[n])
            return f"{self.nodes[n].name}{const}" + (f"({below})" if below else "")

        return show(self.root)


@dataclass(frozen=True)
class QueryTemplate:
    """A weighted tree; every edge is a goal that some view has to cover."""

    name: str
    tree: JoinTree
    weight: float = 1.0
    goals: frozenset[int] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "goals", frozenset(self.tree.edges))
