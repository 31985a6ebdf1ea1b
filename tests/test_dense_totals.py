import random
from collections import defaultdict
from datetime import datetime

import pytest
from conftest import rows

from chunkloom.operators import dense_totals as dt


def test_totals_match_group_by_with_nulls_and_a_hot_key(spark, monkeypatch):
    rng = random.Random(1)
    data = [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([None, rng.randrange(-9, 2**40)]), datetime(2025, 1, rng.randrange(1, 28))) for _ in range(3000)] + [("nul", None, None)]
    df = spark.createDataFrame(data, "key string, n bigint, t timestamp_ntz").repartition(5)
    monkeypatch.setattr(dt, "SPLIT_ROWS", 100)
    got = dt.dense_totals(df, "key", "c", sums={"s": "n"}, least={"lo": "t", "ln": "n"}, most={"hi": "t"})
    want = df.createOrReplaceTempView("d") or spark.sql("SELECT key, count(*) c, sum(n) s, min(t) lo, min(n) ln, max(t) hi FROM d GROUP BY key")
    assert rows(got) == rows(want.select(got.columns))


def test_no_rows_and_overflow(spark):
    df = spark.createDataFrame([], "k string, v bigint")
    assert dt.dense_totals(df, "k", sums={"s": "v"}).count() == 0 and dt.dense_distinct(df, "k", "v", "n").count() == 0
    big = spark.createDataFrame([("a", 2**62)] * 3, "k string, v bigint")
    with pytest.raises(Exception, match="exceeds 63 bits"):
        dt.dense_totals(big, "k", sums={"s": "v"}).collect()


def test_distinct_values_per_key(spark):
    rng = random.Random(2)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)])) for _ in range(500)]
    sets = defaultdict(set)
    for k, v in data:
        if v is not None:
            sets[k].add(v)
    df = spark.createDataFrame(data, "n string, key bigint")
    assert {r[0]: r[1] for r in dt.dense_distinct(df, "n", "key", "m").collect()} == {k: len(v) for k, v in sets.items()}
