import importlib
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from logquarry.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def norm(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(None if pd.isna(v) else round(float(v), 6) if isinstance(v, float) else v for v in row) for row in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    a, b = QUERIES[name](spark, DATA).toPandas(), con.sql(SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and norm(a) == norm(b)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
    if os.path.isdir(DATA):
        assert entry.entry(spark).count() == 17


def test_core_imports_nothing_of_the_llm_folder():
    for name in ("engine", "queries", "render", "config", "sources.table", "streaming.tail"):
        module = importlib.import_module(f"logquarry.{name}")
        assert "llm" not in open(module.__file__).read()
