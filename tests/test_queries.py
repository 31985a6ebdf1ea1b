"""Every registered query against its SQL in DuckDB, over the smallest tables and over empty ones."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
CORE = [m for m in entry.MODULES if ".llm." not in m]


def core(name):
    import importlib

    return {k: v for m in CORE for k, v in getattr(importlib.import_module(m), name).items()}


def plain(df):
    def text(v):
        if v is None or (not isinstance(v, str) and pd.isna(v)):
            return "null"
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v)

    cols = sorted(df.columns)
    return cols, sorted(tuple(text(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(core("QUERIES")))
def test_query_equals_sql(spark, duck, name):
    got = core("QUERIES")[name](spark, DATA)
    if (sql := core("SQL").get(name)) is None:
        assert got.count() >= 0
        return
    assert plain(pd.DataFrame([r.asDict() for r in got.collect()], columns=got.columns)) == plain(duck.sql(sql).df())


def test_all_sql_belongs_to_a_query():
    assert set(core("SQL")) == set(core("QUERIES"))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for f in glob.glob(f"{DATA}/*.parquet"):
        spark.read.parquet(f).limit(0).coalesce(1).write.parquet(str(folder / os.path.basename(f)))
    return str(folder)


@pytest.mark.parametrize("name", sorted(n for n in core("QUERIES") if n[0] == "p" and n[1].isdigit()))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert core("QUERIES")[name](spark, empty).count() == 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
