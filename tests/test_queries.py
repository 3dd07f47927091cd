"""Queries against their oracles, over the driver's smallest tables where they are at hand."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__
from topolake.plans import q_relations
from topolake.plans.catalog import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
def plain(value):
    return ("nan" if math.isnan(value) else repr(round(value, 9))) if isinstance(value, float) else repr(value)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_query(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DIR):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DIR}/{file}'")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    rows = [tuple(map(plain, r)) for r in want.fetchall()]
    got = [tuple(map(plain, r)) for r in QUERIES[name](spark, DIR).select(*columns).collect()]
    assert sorted(got) == sorted(rows)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_payload_document_has_all_schemas(spark, monkeypatch):
    made = []
    monkeypatch.setattr(q_relations.R, "payload", lambda *parts, whole=q_relations.R.payload: made.append(whole(*parts)) or made[0])
    got = QUERIES["q_payload_document"](spark, DIR).collect()
    assert made[0].selectExpr("size(schemas)").first()[0] == spark.read.parquet(f"{DIR}/part.parquet").count() > 0
    con = duckdb.connect()
    for file in os.listdir(DIR):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DIR}/{file}'")
    assert list(map(tuple, got)) == con.execute(ORACLES["q_payload_document"]).fetchall()


def test_entry_points():
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
