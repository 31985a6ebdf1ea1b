import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from chunkloom.operators.message_store import Conflict, MessageStore, merge_in_waves, surplus
from chunkloom.session import shared_dir

SCHEMA = "id bigint, server string, client string, epoch bigint, sig string, day int, part string, digest string, `a.b` string"


def ident():
    return [F.col(c) for c in ("server", "client", "epoch", "sig")]


def fed(spark, data, waves=1, keep=None):
    df = spark.createDataFrame(data, SCHEMA)
    store = MessageStore(spark, shared_dir(spark, "msg"), "id")
    merge_in_waves(store, df, ident(), F.col("day"), waves, keep)
    return df, store


def row(i, key=("s", "c", 1, "g"), day=1):
    return (i, *key, day, "p", "d", "x")


def winners(data):
    best, free = {}, []
    for r in data:
        key = r[1:5]
        if None in key:
            free.append(r[0])
        elif key not in best or r[0] < best[key]:
            best[key] = r[0]
    return sorted(free + list(best.values()))


@pytest.mark.parametrize("waves", [1, 3, 7])
@pytest.mark.parametrize("keep", [None, ["id"]])
def test_random_batches_match_brute_force(spark, waves, keep):
    rng = random.Random(waves)
    data = [row(i, (rng.choice("stu") if rng.random() > 0.1 else None, rng.choice("cd"), rng.choice([0, 1, None]), rng.choice("gh")), rng.randrange(4)) for i in rng.sample(range(200), 60)]
    df, store = fed(spark, data, waves, keep)
    assert [r[0] for r in rows(store.rows().select("id").withColumn("id", F.lpad(F.col("id").cast("string"), 3, "0")))] == [f"{i:03d}" for i in winners(data)]
    lost = {r[0] for r in surplus(df, store, ident()).collect()}
    assert lost == {r[0] for r in data} - set(winners(data))


def test_whole_rows_with_clashing_names_survive(spark):
    df, store = fed(spark, [row(1), row(2), row(3, ("t", "c", 1, "g"))])
    assert store.rows().columns == df.columns
    assert rows(store.rows()) == [row(1), row(3, ("t", "c", 1, "g"))]


def test_only_affected_partitions_are_rewritten(spark):
    store = MessageStore(spark, shared_dir(spark, "msg"), "id")
    frame = lambda data: spark.createDataFrame(data, SCHEMA)
    keys = {d: ("s", "c", d, "g") for d in range(4)}
    assert store.merge(frame([row(10 + d, keys[d], d) for d in range(4)]), ident(), F.col("day")) == []
    before = store.snapshot()["parts"]
    # a copy of day 2's message arrives with a lower number on day 3; a new message on day 9
    assert store.merge(frame([row(1, keys[2], 3), row(50, ("n", "c", 0, "g"), 9)]), ident(), F.col("day")) == ["2"]
    after = store.snapshot()["parts"]
    assert after["0"] == before["0"] and after["1"] == before["1"] and after["3"][:1] == before["3"]
    assert "2" not in after and len(after["3"]) == 2 and len(after["9"]) == 1
    assert sorted(r["id"] for r in store.rows().collect()) == [1, 10, 11, 13, 50]


def test_hot_message_nulls_and_empty_batches(spark):
    data = [row(i) for i in range(300)] + [row(1000 + i, (None, "c", 1, "g")) for i in range(3)]
    _, store = fed(spark, data, 2)
    assert sorted(r["id"] for r in store.rows().collect()) == [0, 1000, 1001, 1002]
    version = store.snapshot()["version"]
    assert store.merge(spark.createDataFrame([], SCHEMA), ident(), F.col("day")) == [] and store.snapshot()["version"] == version
    empty, fresh = fed(spark, [])
    assert fresh.rows() is None and surplus(empty, fresh, ident()).count() == 0


def test_identifiers_do_not_run_together(spark):
    data = [row(1, ("ab", "c", 1, "g")), row(2, ("a", "bc", 1, "g")), row(3, ("a:1", "c", 1, "g")), row(4, ("a", ":1c", 1, "g")), row(5, ("", "", 0, ""))]
    _, store = fed(spark, data)
    assert store.rows().count() == 5


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def ids(store):
    return sorted(r["id"] for r in store.rows().collect())


def test_a_merge_killed_before_its_commit_leaves_a_usable_store(spark, monkeypatch):
    _, store = fed(spark, [row(5), row(6, ("t", "c", 1, "g"), 2)])
    batch = frame(spark, [row(1), row(7, ("u", "c", 1, "g"), 3)])

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store._files, "write_once", die)
        for _ in range(2):
            with pytest.raises(KeyboardInterrupt):
                store.merge(batch, ident(), F.col("day"))
    assert ids(store) == [5, 6] and store.snapshot()["version"] == 1
    assert store.merge(batch, ident(), F.col("day")) == ["1"]
    assert ids(store) == [1, 6, 7] and store.snapshot()["version"] == 2
    assert store.sweep() == []  # within the grace time
    gone = store.sweep(keep=1, grace_s=-60)
    # two dead attempts and what version 2 replaced; the partition it left alone stays
    assert sum("/data/" in p and "part=" not in p for p in gone) == 2 and any(p.endswith("part=1") for p in gone)
    assert ids(store) == [1, 6, 7] and store.sweep(keep=1, grace_s=-60) == []
    assert store.merge(frame(spark, [row(0)]), ident(), F.col("day")) == ["1"] and ids(store) == [0, 6, 7]


def test_of_two_writers_the_second_changes_nothing(spark, monkeypatch):
    _, store = fed(spark, [row(5)])
    other = MessageStore(spark, store.root, "id")
    stale = other.snapshot()
    store.merge(frame(spark, [row(9, ("t", "c", 1, "g"))]), ident(), F.col("day"))
    late = frame(spark, [row(1)])
    with monkeypatch.context() as m:
        m.setattr(other, "snapshot", lambda: stale)
        with pytest.raises(Conflict):
            other.merge(late, ident(), F.col("day"))
    assert ids(store) == [5, 9] and store.snapshot()["version"] == 2
    other.merge(late, ident(), F.col("day"))
    assert ids(store) == [1, 9] and not [n for n in store._files.names(f"{store.root}/manifests") if n.endswith(".tmp")]
