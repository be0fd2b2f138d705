"""Secret scans over a trigram index.

``trigram_query`` derives from a rule's regular expression an AND/OR query over trigrams that
every match must contain (lower-cased ASCII; ``None`` means nothing is mandatory).  Documents are
indexed in segments, one Arrow batch each: postings list, for every trigram that some rule asks
for, the segment's documents that hold it.  A rule's query is answered by joining and intersecting
postings, and only documents that pass are searched.  A rule with no mandatory trigram (such as
a run of hex digits) is searched in every document.  A segment is read once and needs no shuffle.

Cases: a null text is empty; texts are scanned whole, in time that grows with their length; spans are code points, end exclusive;
overlapping finds of different kinds all stay; repeated rows all stay; an empty table gives no
rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as K
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from treeline.llm.common import id_text, prepare

#: Largest set of exact strings that the derivation carries along.
MOST_STRINGS = 32


@dataclass(frozen=True)
class Rule:
    """Matches of *pattern* whose *group* has *least* characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    fold: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.fold else 0))

    def spans(self, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
        found = compiled.finditer(text)
        return [m.span() for m in found if m.end(self.group) - m.start(self.group) >= self.least]


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Further kinds, by the public shapes of such credentials.  A match can only begin where a run of its characters
#: does, and runs are never given back, so each takes time in proportion to the text.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("prefixed", r"(?:ghp_|gho_|xoxb-|xoxp-|sk_live_|rk_live_|glpat-)[A-Za-z0-9_-]{16,}"),
    Rule("url_login", r"(?<![a-z])[a-z]++://[^\s/:@]++:[^\s/:@]++@[A-Za-z0-9.-]+"),
)

Query = tuple | None  # ("tri", code) | ("and", q, ...) | ("or", q, ...) | None


def _both(a: Query, b: Query) -> Query:
    return b if a is None else a if b is None else ("and", a, b)


def _of_strings(strings: set[str]) -> Query:
    """At least one of *strings* occurs: an OR of ANDs of their trigrams."""
    parts = []
    for s in sorted(strings):
        codes = sorted({s[i : i + 3] for i in range(len(s) - 2)})
        if not codes:
            return None
        parts.append(("tri", codes[0]) if len(codes) == 1 else ("and", *(("tri", c) for c in codes)))
    return parts[0] if len(parts) == 1 else ("or", *parts)


def _strings(items, fold: bool) -> tuple[set[str] | None, Query]:
    """Exact strings of a sequence (None: unknown) and the query that holds besides."""
    exact: set[str] | None = {""}
    query: Query = None

    def close():
        nonlocal exact, query
        if exact:
            query = _both(query, _of_strings(exact))
        exact = {""}

    for op, arg in items:
        own: set[str] | None = None
        extra: Query = None
        if op is K.LITERAL and arg < 128:
            own = {chr(arg).lower()}
        elif op is K.IN and all(o is K.LITERAL and a < 128 for o, a in arg):
            own = {chr(a).lower() for _, a in arg}
        elif op is K.SUBPATTERN:
            own, extra = _strings(arg[3], fold)
        elif op is K.BRANCH:
            sides = [_strings(x, fold) for x in arg[1]]
            if all(s is not None and q is None for s, q in sides):
                own = set().union(*(s for s, _ in sides))
            else:
                whole = [_both(q, _of_strings(s) if s else None) for s, q in sides]
                extra = None if None in whole else ("or", *whole)
        elif op in (K.ASSERT, K.ASSERT_NOT, K.AT):
            own = {""}  # takes no characters
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            low, high, body = arg
            inner, needed = _strings(body, fold)
            if (low, high) == (0, 1) and inner is not None and needed is None:
                own = inner | {""}
            elif low:
                extra = _both(needed, _of_strings(inner) if inner else None)
                if low == high == 1:
                    own, extra = inner, needed
        query = _both(query, extra)
        if own is None or exact is None or len(exact) * len(own) > MOST_STRINGS:
            close()
            exact = own if own is not None else {""}
        else:
            exact = {a + b for a in exact for b in own}
        if own is None:
            # What follows can't be joined to what came before.
            close()
    return exact, query


def trigram_query(rule: Rule) -> Query:
    exact, query = _strings(parser.parse(rule.pattern), rule.fold)
    return _both(query, _of_strings(exact) if exact else None)


def trigrams_of(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams_of, query[1:]))


class Segment:
    """Postings of one batch of texts, for the trigrams in *table* (code -> number + 1)."""

    def __init__(self, texts: list[str], table: np.ndarray, n: int):
        raws = [t.encode("utf-8", "replace").lower() + b"\0\0" for t in texts]
        data = np.frombuffer(b"".join(raws), np.uint8).astype(np.uint32)
        self.size = len(texts)
        self.postings = np.zeros((n, len(texts)), bool)
        if len(data) < 3:
            return
        which = table[data[:-2] << 16 | data[1:-1] << 8 | data[2:]]
        at = np.flatnonzero(which)
        ends = np.cumsum([len(r) for r in raws])
        self.postings[which[at] - 1, np.searchsorted(ends, at, side="right")] = True

    def answer(self, query: Query, number: dict[str, int]) -> np.ndarray:
        if query is None:
            return np.ones(self.size, bool)
        if query[0] == "tri":
            return self.postings[number[query[1]]]
        parts = [self.answer(q, number) for q in query[1:]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = BASE + MORE):
        self.rules = rules
        self.queries = [trigram_query(r) for r in rules]
        self.compiled = [r.compiled() for r in rules]
        wanted = sorted(set().union(*map(trigrams_of, self.queries)))
        self.number = {t: i for i, t in enumerate(wanted)}
        self.table = np.zeros(1 << 24, np.uint16)
        for t, i in self.number.items():
            a, b, c = t.encode()
            self.table[a << 16 | b << 8 | c] = i + 1

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text: (start, rule number, end), sorted."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        segment = Segment(texts, self.table, len(self.number))
        for k, (rule, query) in enumerate(zip(self.rules, self.queries)):
            for i in np.flatnonzero(segment.answer(query, self.number)):
                found[i] += [(a, k, b) for a, b in rule.spans(self.compiled[k], texts[i])]
        return [sorted(x) for x in found]


def scan(spark: SparkSession, docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id and finds (kind, start, end) of every document, found or not."""
    prepare(spark)
    base = {r.kind for r in BASE}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner(rules)
        counted = [next((k for k, r in enumerate(rules) if r.kind == name), -1) for name in ("assign", "access", "hex")]
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            finds = own.scan(texts)
            says = [[f"{rules[k].kind}:{a}:{b}" for a, k, b in f] for f in finds]
            digests = [hashlib.sha256(",".join(s for s, (_, k, _) in zip(x, f) if rules[k].kind in base).encode()).hexdigest() for x, f in zip(says, finds)]
            counts = [pa.array([sum(k == c for _, k, _ in f) for f in finds], pa.int64()) for c in counted]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digests), pa.array([",".join(x) for x in says])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
