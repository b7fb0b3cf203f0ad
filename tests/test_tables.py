"""Every table-bound query against its SQL in DuckDB, and every corpus query."""

import glob
import os
import random

import duckdb
import pytest

from granary.operators import relational as R
from granary.plans import corpus_queries, table_queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    df = df.astype(object).where(df.notna(), None)
    return list(df.columns), sorted(map(str, df.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(table_queries.SQL))
def test_table_query(spark, con, name):
    assert rows(table_queries.QUERIES[name](spark, DATA).toPandas()) == rows(con.sql(table_queries.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(corpus_queries.SQL))
def test_corpus_query(spark, con, name):
    assert rows(corpus_queries.QUERIES[name](spark, DATA).toPandas()) == rows(con.sql(corpus_queries.SQL[name]).df())


def test_finding_cap_deals_rows_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(R, "TASK_ROWS", 50, raising=False)
    r = random.Random(3)
    objects = [(r.randrange(4), r.randrange(120)) for _ in range(600)]
    references = [(r.randrange(5), r.randrange(140), r.choice("xyz")) for _ in range(90)]
    every, named = spark.createDataFrame(objects, "g int, p long"), spark.createDataFrame(references, "g int, p long, f string")
    got = R.finding_cap(every, named, "g", "p", ["f"], 20)
    wanted = set()
    for g in range(4):
        paths = {p for x, p in objects if x == g}
        said = {(p, f) for x, p, f in references if x == g and p in paths}
        turn = {p: (3, str(p)) for p in paths} | {p: (2, str(p)) for p, _ in said}
        for f in sorted({f for _, f in said}, reverse=True):
            first = min(p for p, k in said if k == f)
            turn[first] = min(turn[first], (1, f))
        wanted |= {(g, p) for p in sorted(paths, key=lambda p: (turn[p], p))[:20]}
    assert {tuple(x) for x in got.collect()} == wanted and got.count() == len(wanted)
    assert "RepartitionByExpression [g" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and ", 12" in plan
