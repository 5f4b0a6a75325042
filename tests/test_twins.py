"""Every registered query with an SQL twin gives the same rows as the twin."""

import math

import duckdb
import pytest

from pressweave.catalog import load_all

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
QUERIES, ORACLES = load_all()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return str([norm(x) for x in v]) if isinstance(v, (list, tuple)) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([norm(r[i]) for i in order] for r in data), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    cur = duck.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, cur.fetchall())


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
