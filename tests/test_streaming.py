import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from chunkloom.operators import protocol as pr, reputation as rp
from chunkloom.streaming import live


@pytest.fixture
def feed(spark, tmp_path):
    """Writes rows as one file per batch; gives the stream over them, one file a batch."""

    def make(batches, schema, name="in"):
        for i, rows_ in enumerate(batches):
            spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name / f"b{i}"))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / name))

    return make


def run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_ledger_equals_batch(spark, feed, tmp_path):
    rng = random.Random(1)
    data = [(rng.choice("pqr"), rng.choice(["received", "served", "credited"]), rng.randrange(100)) for _ in range(60)]
    schema = "peer string, kind string, bytes bigint"
    got = run(live.live_ledger(feed([data[:20], data[20:40], data[40:]], schema)), "ledger", "complete", tmp_path)
    assert rows(got) == rows(rp.ledger(spark.createDataFrame(data, schema)))


def test_choke_equals_batch(spark, feed, tmp_path):
    rng = random.Random(2)
    data = [(rng.choice("ab"), i, rng.random() < 0.2, rng.choice([None, 10, 40])) for i in range(90)]
    schema = "grp string, seq bigint, is_credit boolean, bytes bigint"
    got = run(live.live_choke(feed([data[:30], data[30:60], data[60:]], schema), 60), "choke", "append", tmp_path)
    assert rows(got) == rows(rp.choke_with_credits(spark.createDataFrame(data, schema), "grp", "seq", "is_credit", "bytes", 60))


def test_throttle_equals_batch(spark, feed, tmp_path):
    rng = random.Random(3)
    data = [(rng.choice("ab"), i, i * 30 + rng.randrange(20), rng.random() < 0.1) for i in range(60)]
    schema = "op string, seq bigint, ms bigint, done boolean"
    got = run(live.live_throttle(feed([data[:25], data[25:]], schema), 100), "throttle", "append", tmp_path)
    want = pr.throttled(spark.createDataFrame(data, schema), "op", "ms", "seq", "done").where("emitted")
    assert rows(got.select("seq")) == rows(want.select("seq"))


def test_tracker_expires_peers(spark, feed, tmp_path):
    at = lambda s: f"2025-03-01 {s}"
    batches = [[("c", "p", at("00:00:00")), ("c", "q", at("00:00:00"))], [("c", "p", at("00:20:00")), (None, "z", at("00:20:00"))], [("c", "r", at("01:00:00"))], [("c", "r", at("01:00:01"))]]
    stream = feed([[(c, p, t) for c, p, t in b] for b in batches], "cid string, peer string, t string").select("cid", "peer", F.to_timestamp("t").alias("ts"))
    got = {(r["peer"], r["event"], str(r["ts"])[11:]) for r in run(live.live_tracker(stream), "tracker", "append", tmp_path).collect()}
    fresh = {("p", "fresh", "00:00:00"), ("q", "fresh", "00:00:00"), ("p", "fresh", "00:20:00"), ("r", "fresh", "01:00:00"), ("r", "fresh", "01:00:01")}
    assert fresh <= got and ("q", "gone", "00:00:00") in got and ("r", "gone", "01:00:01") not in got


def test_first_contact_and_index_tail(spark, feed, tmp_path):
    batches = [[("s", "c", "1", "2025-03-01 00:00:00"), ("s", "c", "1", "2025-03-01 00:00:01")], [("s", "c", "1", "2025-03-01 00:10:00"), ("s", "d", "1", "2025-03-01 00:10:00")]]
    stream = feed(batches, "server string, client string, session string, t string").select("server", "client", "session", F.to_timestamp("t").alias("ts"))
    assert rows(run(live.live_first_contact(stream), "first", "append", tmp_path).select("client")) == [("c",), ("d",)]
    h = "0a" * 32
    folder = tmp_path / "lines"
    folder.mkdir()
    (folder / "1.tsv").write_text(f"{h}\t1\t2\t3\ntorn\t1\n")

    def tail():
        q = live.live_index(spark, str(folder)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp-tail")).option("path", str(tmp_path / "o")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return rows(spark.read.parquet(str(tmp_path / "o")))

    assert tail() == [(h, 1, 2, 3)]
    (folder / "2.tsv").write_text(f"{h}\t4\t5\t6\n")
    assert tail() == [(h, 1, 2, 3), (h, 4, 5, 6)]  # nothing is read twice


def test_request_stream(spark, tmp_path):
    folder = tmp_path / "req"
    folder.mkdir()
    (folder / "a.ndjson").write_text('{"id":1,"cmd":"status"}\n\n{"id":2,"cmd":"fetch"}\n')
    got = run(live.live_requests(spark, str(folder)), "req", "append", tmp_path)
    assert rows(got.select("id", "error")) == [(1, None), (2, "MissingField")]
