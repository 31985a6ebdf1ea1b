import glob
import os

import duckdb
import pandas as pd
import pytest

from chunkloom.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, DATA)
    out = [r.asDict() for r in got.collect()]
    if name not in SQL:
        assert out
        return
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    cols = sorted(got.columns)
    text = lambda df: sorted(tuple(map(str, r)) for r in df[cols].itertuples(index=False))
    assert text(pd.DataFrame(out)) == text(con.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ("p4_error_rate", "p6_unused_share", "p6_invariants")))
def test_empty_tables(spark, tmp_path, name):
    for f in glob.glob(f"{DATA}/*.parquet"):
        spark.read.parquet(f).limit(0).coalesce(1).write.parquet(str(tmp_path / os.path.basename(f)))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0
