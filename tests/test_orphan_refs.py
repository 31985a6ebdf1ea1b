import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from chunkloom.operators import orphan_refs as op


def plain_runs(pairs):
    out = []
    for key in sorted({k for k, p in pairs if k is not None and p is not None}):
        ps = sorted({p for k, p in pairs if k == key and p is not None})
        start = last = ps[0]
        for p in ps[1:] + [None]:
            if p is None or p != last + 1:
                out.append((key, start, last))
                start = p
            last = p
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_runs_match_brute_force_over_word_and_block_edges(spark, seed):
    rng = random.Random(seed)
    span = op.WORD_BITS * op.BLOCK_WORDS
    pairs = [(None, 1), ("a", None)]
    for key in "ab":
        for _ in range(12):
            start = rng.choice([0, -5, 60, 64, span - 70, 2 * span - 3, 128, 5]) + rng.randrange(6)
            pairs += [(key, p) for p in range(start, start + rng.choice([1, 3, 64, 70, 200]))]
    pairs += [("c", p) for p in range(span - 2, 2 * span + 3)]
    df = spark.createDataFrame(pairs, "root string, block bigint")
    got = sorted(tuple(r) for r in op.compress_runs(df, "root", "block").collect())
    assert got == plain_runs(pairs)


def test_runs_of_nothing(spark):
    assert op.compress_runs(spark.createDataFrame([], "root string, o bigint"), "root", "o").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_range_references_match_brute_force(spark, seed):
    rng = random.Random(seed)
    parents = [(k, p) for k in "ab" for p in range(150) if rng.random() < 0.93] + [("a", 3)] * 50 + [(None, 4)]
    refs = [(i, rng.choice(["a", "b", "zz", None]), rng.choice([None, -1, *range(0, 150, 7)]), rng.choice([None, 0, -2, 1, 2, 5, 30, 2**62])) for i in range(300)]
    have = {(k, p) for k, p in parents if k is not None}
    lost = sorted(i for i, k, s, n in refs if s is not None and n is not None and n > 0 and (n > 1000 or any((k, p) not in have for p in range(s, s + n))))
    runs = op.compress_runs(spark.createDataFrame(parents, "k string, p bigint"), "k", "p")
    # the columns' names are those the operator uses inside
    df = spark.createDataFrame(refs, "row bigint, k string, s bigint, run_end bigint")
    got = op.range_orphans(df, runs, "k", "s", "run_end", block=64)
    assert got.columns == df.columns and sorted(r["row"] for r in got.collect()) == lost
    assert op.range_orphans(df.limit(0), runs, "k", "s", "run_end").count() == 0


@pytest.mark.parametrize("block", [10, 1000])
def test_state_references_match_brute_force(spark, block):
    rng = random.Random(block)
    log = [(rng.choice(["a", "b", None]), rng.choice([None, *range(0, 100, 5)]), i, rng.choice(["put", "drop", "put", None])) for i in range(80)]
    refs = [(i, rng.choice(["a", "b", "zz", None]), rng.choice([None, *range(-5, 110)])) for i in range(300)] + [(1000 + i, "a", 50) for i in range(200)]

    def present(k, t):
        lines = [(at, i, o) for key, at, i, o in log if key == k and at is not None and t is not None and at <= t]
        return bool(lines) and max(lines, key=lambda x: x[:2])[2] == "put"

    lost = sorted(i for i, k, t in refs if k is not None and not present(k, t))
    lines = spark.createDataFrame(log, "k string, p bigint, i bigint, o string")
    runs = op.state_runs(lines, "k", "p", "i", F.coalesce(F.col("o") == "put", F.lit(False)), block)
    df = spark.createDataFrame(refs, "i bigint, row string, p bigint")
    got = op.state_orphans(df, runs, "row", "p", block)
    assert got.columns == df.columns and sorted(r["i"] for r in got.collect()) == lost
    none = op.state_orphans(df, runs.limit(0), "row", "p", block)
    assert none.count() == sum(k is not None for _, k, _ in refs)


def test_blocks_follow_the_rows_of_the_most_frequent_key(spark):
    hot = [("hot", i) for i in range(0, 4000)] + [(f"k{i}", i) for i in range(1000)] + [(None, 10**9), ("k1", None)]
    df = spark.createDataFrame(hot, "k string, p bigint")
    few = spark.createDataFrame([("k1", -1000), ("k2", 9000)], "k string, p bigint")
    width = op.block_width((df, "k", "p"), (few, "k", "p"), rows=100)
    assert 240 <= width <= 260  # 10 001 positions, about 40 blocks of 100 rows of the hot key
    twice = df.unionByName(df.withColumn("p", F.col("p") + 4000))
    assert op.block_width((twice, "k", "p"), (few, "k", "p"), rows=100) < 0.6 * width
    assert op.block_width((df.limit(0), "k", "p")) == 1 and op.block_width((few, "k", "p")) == 10_001
