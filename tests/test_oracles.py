"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_point

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
ORACLES = entry_point.oracle_sql()
QUERIES = entry_point.queries()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, sf, name):
    ours = QUERIES[name](spark, sf)
    columns = sorted(ours.columns)
    cursor = duck.execute(ORACLES[name])
    described = {d[0]: str(d[1]) for d in cursor.description}
    theirs = cursor.fetchall()
    order = [d[0] for d in cursor.description]
    assert sorted(order) == columns
    assert {f.name: TYPES[f.dataType.simpleString()] for f in ours.schema.fields} == described
    left = sorted(tuple(plain(r[c]) for c in columns) for r in ours.collect())
    right = sorted(tuple(plain(r[order.index(c)]) for c in columns) for r in theirs)
    assert left == right


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    result = QUERIES[name](spark, sf)
    assert result.count() > 0
    assert len(set(result.columns)) == len(result.columns)


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    rows = entry_point.entry(spark)
    assert rows.columns == ["doc_id", "label", "split"]
    assert {r.split for r in rows.select("split").distinct().collect()} == {
        "train", "validation", "test"}
