import random

import numpy as np
import pytest
from conftest import rows

from chunkloom.llm import distinct_patterns as dp, seen_before as sb
from pyspark.sql import functions as F


def random_rows(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice(["d1", "d2", None]), rng.choice([None, *map(str, range(40))]), rng.choice(["x", "y", "z", None]), rng.choice(["p", None])) for _ in range(n)]


SCHEMA = "grp string, id string, period string, own0 string"


@pytest.mark.parametrize("seed", range(2))
def test_any_combination_is_exact(spark, seed, monkeypatch):
    monkeypatch.setattr(dp, "WORD", 3)  # several words of bits
    data = random_rows(seed)
    df = spark.createDataFrame(data, SCHEMA)
    dims = ["period", "own0"]
    groups = dp.group_dictionary(df, dims)
    state = dp.membership(df, "grp", "id", dims, groups)
    asked = dp.standard_questions(groups, ["site", "origin"]) | {"not only": [{0, 1}, {2, 3}, {4}]}
    got = {(r["period"], r["combination"]): r["n"] for r in dp.answer(dp.pattern_totals(state), asked).collect()}
    want = {}
    for day in {r[0] for r in data}:
        for name, sets in asked.items():
            ids = [{r[1] for r in data if r[0] == day and r[1] is not None and (r[2], r[3]) in {groups[g] for g in s}} for s in sets]
            if n := len(set.intersection(*ids)):
                want[day, name] = n
    assert got == want


def test_partial_states_and_totals_merge(spark):
    df = spark.createDataFrame(random_rows(5), SCHEMA)
    dims = ["period", "own0"]
    groups = dp.group_dictionary(df, dims)
    parts = [dp.membership(df.where(c), "grp", "id", dims, groups) for c in ("period = 'x'", "period <> 'x' OR period IS NULL")]
    whole = dp.membership(df, "grp", "id", dims, groups)
    assert rows(dp.merge_states(*parts)) == rows(whole)
    shards = [dp.pattern_totals(whole.where(F.pmod(F.xxhash64("id"), F.lit(2)) == k)) for k in (0, 1)]
    assert rows(dp.merge_totals(*shards)) == rows(dp.pattern_totals(whole))
    assert dp.without_period(whole).count() == df.where("id IS NOT NULL").select("id").distinct().count()


def test_nothing_to_count(spark):
    df = spark.createDataFrame([], SCHEMA)
    groups = dp.group_dictionary(df, ["period"])
    assert groups == [] and dp.answer(dp.pattern_totals(dp.membership(df, "grp", "id", ["period"], groups)), dp.standard_questions(groups, ["site"])).count() == 0


def keys(n, seed):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, n, np.uint64), rng.integers(0, 2**64, n, np.uint64)


def test_chain_never_misses_and_keeps_its_bound():
    chain = sb.BloomChain(capacity=500, error=0.01)
    a, b = keys(20_000, 1)
    wrong = sum(int(chain.seen(a[i : i + 700], b[i : i + 700]).sum()) for i in range(0, len(a), 700))
    assert len(chain.layers) > 3 and chain.bound <= 0.02 and wrong / len(a) <= 0.02
    assert all(x.error == 0.01 * 0.5**i and x.capacity == 500 * 2**i for i, x in enumerate(chain.layers))
    assert chain.seen(a, b).all()
    fresh = keys(20_000, 2)
    assert sb.BloomChain.seen(chain, *fresh).mean() < 0.025


def test_repeats_within_one_call_are_seen():
    a, b = keys(5, 3)
    order = np.array([0, 1, 0, 2, 1, 0, 3])
    assert sb.BloomChain().seen(a[order], b[order]).tolist() == [False, False, True, False, True, True, False]


@pytest.mark.parametrize(("seed", "error"), [(1, 5e-4), (2, 0.9)])
def test_verified_answers_match_brute_force_even_with_a_bad_filter(spark, seed, error):
    rng = random.Random(seed)
    data = [(i, rng.choice(["hot", "hot", None, *map(str, range(500))])) for i in rng.sample(range(5000), 1500)]
    base = [("3",), ("3",), ("7",), (None,), ("unused",)]
    seen, want = {"3", "7", "unused"}, set()
    for i, k in sorted(data):
        if k is not None:
            if k not in seen:
                want.add(i)
            seen.add(k)
    df = spark.createDataFrame(data, "at bigint, key string").select("at", F.encode("key", "UTF-8").alias("key"))
    history = spark.createDataFrame(base, "key string").select(F.encode("key", "UTF-8").alias("key"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)  # many calls of the chain
    try:
        got = sb.not_seen(df, "key", "at", history, "key", len(data), shard_keys=1000, capacity=4, error=error).where("at >= 0").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["at"] for r in got} == want
    if error > 0.1:  # the exact check had something to put right
        assert any(r["missed"] for r in got)


def test_answers_depend_on_the_chain(spark, monkeypatch):
    """Constant answers in its place change the result or raise."""
    df = spark.createDataFrame([(i, f"k{i % 300}") for i in range(900)], "at bigint, k string").select("at", F.encode("k", "UTF-8").alias("key"))
    none = spark.createDataFrame([], "key binary")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        right = {r["at"] for r in sb.not_seen(df, "key", "at", none, "key", 900).collect()}
        assert right == set(range(300))
        own = sb.chain_answers
        monkeypatch.setattr(sb, "chain_answers", lambda *a, **k: own(*a, **k).withColumn("seen", F.lit(False)))
        assert {r["at"] for r in sb.not_seen(df, "key", "at", none, "key", 900).collect()} > right
        monkeypatch.setattr(sb, "chain_answers", lambda *a, **k: own(*a, **k).withColumn("seen", F.lit(True)))
        with pytest.raises(RuntimeError, match="wrong answers"):
            sb.not_seen(df, "key", "at", none, "key", 900)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_shards_follow_the_history(spark):
    assert sb.shards_for(0, spark) == 4 and sb.shards_for(100 * sb.SHARD_KEYS + 1, spark) == 101


def test_only_changed_layers_are_saved(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sb, "WHOLE_AFTER", 3)
    kept = sb.SeenFilter(spark, str(tmp_path / "f"), shards=2, capacity=50, error=0.01)
    seen_as = []
    for turn in range(5):
        data = [(turn * 200 + i, f"{turn}-{i}") for i in range(200)] + [(5000 + turn, "0-7")]
        got = {r["at"]: r["seen"] for r in kept.ask(spark.createDataFrame(data, "at bigint, k string"), "k", "at").collect()}
        seen_as.append(got[5000 + turn])
        held = {r["shard"]: r["n"] for r in kept.state().groupBy("shard").agg(F.sum("held").alias("n")).collect()}
        assert 0.95 * 200 * (turn + 1) <= sum(held.values()) <= 200 * (turn + 1)
    assert seen_as == [True] * 5


def test_empty_history_and_rows(spark):
    none = spark.createDataFrame([], "at bigint, key binary")
    assert sb.not_seen(none, "key", "at", none, "key", 0).count() == 0
    assert sb.error_bound(0.001) == 0.002


def test_a_kept_filter_answers_batch_by_batch(spark, tmp_path):
    rng = random.Random(9)
    kept = sb.SeenFilter(spark, str(tmp_path / "f"), shards=3, capacity=20, error=0.01)
    known, wrong, asked = set(), 0, 0
    for batch in range(4):
        data = [(batch * 1000 + i, rng.choice([None, "hot", *map(str, range(800))])) for i in rng.sample(range(1000), 300)]
        got = {r["at"]: r["seen"] for r in kept.ask(spark.createDataFrame(data, "at bigint, seen string"), "seen", "at").collect()}
        assert len(got) == len(data)
        for i, k in sorted(data):
            if k is None:
                assert not got[i]
                continue
            asked += k not in known
            if k in known:
                assert got[i]  # never missed
            else:
                wrong += got[i]
            known.add(k)
    assert wrong <= 0.02 * asked + 3
    layers = kept.state().groupBy("shard").count().collect()
    assert len(layers) == 3 and all(r["count"] > 1 for r in layers)
    assert kept.ask(spark.createDataFrame([], "at bigint, k string"), "k", "at").count() == 0 and kept.state().count() == sum(r["count"] for r in layers)


def test_chains_survive_being_kept():
    a, b = keys(3000, 5)
    one, two = sb.BloomChain(100, 0.01), sb.BloomChain(100, 0.01)
    for i in range(0, 3000, 500):
        x, y = one.seen(a[i : i + 500], b[i : i + 500]), two.seen(a[i : i + 500], b[i : i + 500])
        assert (x == y).all()
        two = sb.BloomChain.of_rows(two.rows(), 100, 0.01)
    assert [r["held"] for r in one.rows()] == [r["held"] for r in two.rows()] and one.bound == two.bound
