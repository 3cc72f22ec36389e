"""Every query against its SQL twin on the smallest tables, by rows compared as multisets."""

from __future__ import annotations

import os

import duckdb
import pytest

from strataflow.plans.bindings import TABLES
from strataflow.plans.oracles import ORACLE_SQL
from strataflow.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        path = f"{DATA}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if hasattr(value, "isoformat"):
        return str(value)[:19]
    return round(float(value), 4)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_twin(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_every_query_but_the_approximate_one_has_a_twin():
    assert set(QUERIES) - set(ORACLE_SQL) == {"ann_topk"}


def test_approximate_neighbours_recall(spark):
    near = {(r.query_id, r.chunk_id) for r in QUERIES["ann_topk"](spark, DATA).collect()}
    exact = {(r.query_id, r.chunk_id) for r in QUERIES["cosine_topk"](spark, DATA).collect()}
    assert len(near & exact) >= 0.9 * len(exact)
