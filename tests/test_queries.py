"""Every registered query with SQL against DuckDB on the same tables."""

import duckdb
import pytest

import __spark_entry__
from treeline import queries as relational

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame, columns):
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in frame)))


@pytest.mark.parametrize("name", sorted(relational.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = relational.queries()[name](spark, sf_dir)
    want = con.execute(relational.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == columns
    names = [d[0] for d in want.description]
    assert rows_of((r.asDict() for r in got.collect()), columns) == rows_of((dict(zip(names, r)) for r in want.fetchall()), columns)


def test_rows_only_queries(spark, sf_dir):
    for name in sorted(set(relational.queries()) - set(relational.oracle_sql())):
        first = relational.queries()[name](spark, sf_dir).collect()
        assert first and first == relational.queries()[name](spark, sf_dir).collect()


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["c", "o", "p", "s"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
