"""Every registered query against its SQL."""

from __future__ import annotations

import math

import duckdb
import pytest

from factloom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(name, spark, duck, sf_dir):
    made = catalog.queries()[name](spark, sf_dir)
    wanted = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(made.columns) == sorted(columns)
    assert _rows(made.columns, [tuple(r) for r in made.collect()]) == _rows(columns, wanted.fetchall())


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
