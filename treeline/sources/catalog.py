"""Relations as DataFrames ``(l, r, mult)``, registered once and read many times."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions.stats import measured_fanout
from treeline.model import Entity, Relation
from treeline.sources.storage import scratch_path, write_table


def raw_pairs(df: DataFrame, left: str, right: str) -> DataFrame:
    """Two columns as ``(l, r)``, repeated as they come; pairs with a null are no pairs, an integer key is widened to long."""

    def key(c: str):
        kind = dict(df.dtypes)[c]
        return F.col(c).cast("long") if kind in ("tinyint", "smallint", "int") else F.col(c)

    return df.select(key(left).alias("l"), key(right).alias("r")).where(F.col("l").isNotNull() & F.col("r").isNotNull())


def relation(df: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs of two columns with how often each occurs.  Empty input gives an empty relation."""
    return raw_pairs(df, left, right).groupBy("l", "r").agg(F.count("*").alias("mult"))


def invert(pairs: DataFrame) -> DataFrame:
    """The pairs the other way round, each once."""
    return pairs.select(F.col("r").alias("l"), F.col("l").alias("r")).distinct()


def merge(*parts: DataFrame) -> DataFrame:
    """Bag union: multiplicities add up."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("l", "r").agg(F.sum("mult").alias("mult"))


def random_relation(spark: SparkSession, n: int, left_card: int, right_card: int, seed: int = 0) -> DataFrame:
    """*n* pairs drawn uniformly with replacement, as ``(l, r)``."""
    return spark.range(n).select(F.floor(F.rand(seed) * left_card).alias("l"), F.floor(F.rand(seed + 1) * right_card).alias("r"))


class Catalog:
    """Named relations over named entities."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.entities: dict[str, Entity] = {}
        self.relations: dict[str, Relation] = {}
        self.pairs: dict[str, DataFrame] = {}

    def entity(self, name: str, card: float = 1.0) -> Entity:
        return self.entities.setdefault(name, Entity(name, card))

    def register(self, name: str, left: Entity, right: Entity, df: DataFrame, columns: tuple[str, str] = ("l", "r"), stored: bool = False, measure: bool = False) -> Relation:
        """Add a relation from two columns of *df*: distinct pairs, so that joins of them need no distinct."""
        pairs = relation(df, *columns).select("l", "r")
        if stored:
            pairs = write_table(pairs, scratch_path(self.spark, f"relation-{name}"), ["l", "r"])
        found = Relation(name, left, right)
        if measure:
            row = measured_fanout(pairs).first()
            found = replace(found, n_rgl=row.n_rgl or 0.0, n_lgr=row.n_lgr or 0.0)
        self.relations[name], self.pairs[name] = found, pairs
        return found

    def register_inverse(self, name: str, inverse: str | None = None) -> Relation:
        inverse = inverse or f"{name}_inv"
        found = self.relations[inverse] = self.relations[name].inverse(inverse)
        self.pairs[inverse] = invert(self.pairs[name])
        return found


def load_config(text: str, schema: str, scale: float = 1.0) -> tuple[dict[str, Entity], list[tuple[str, str, int]]]:
    """Entities (cardinality times *scale*) and (left, right, tuples) of one schema of a JSON catalog.

    ``{"<schema>": {"entities": {name: card}, "relations": [[left, right, tuples], ...]}}``
    """
    own = json.loads(text)[schema]
    entities = {k: Entity(k, v * scale) for k, v in own["entities"].items()}
    return entities, [(a, b, int(n)) for a, b, n in own["relations"]]
