"""The operators of the event loop as Structured Streaming queries.

Batch forms are in ``operators``; with the same input to its end each of these gives
the batch result (tests compare them).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chunkloom.operators.discovery import FRESH_S
from chunkloom.operators.protocol import parse_requests
from chunkloom.operators.reputation import ledger


def live_ledger(events: DataFrame) -> DataFrame:
    """Counters per peer, updated as events ``(peer, kind, bytes)`` arrive (update or complete mode)."""
    return ledger(events)


def live_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed request lines of files that appear in a folder; whole lines only."""
    lines = spark.readStream.schema("value string").text(folder).where(F.trim("value") != "")
    return parse_requests(lines.select("value"), "value")


def live_index(spark: SparkSession, folder: str) -> DataFrame:
    """Index lines as they are appended as files; offsets are in the query's checkpoint, nothing is read twice."""
    f = F.split("value", "\t", 4)
    lines = spark.readStream.schema("value string").text(folder)
    cols = lines.select(F.get(f, 0).alias("h"), *(F.get(f, i).alias(c) for i, c in ((1, "a"), (2, "b"), (3, "c"))))
    return cols.select(
        F.when(F.col("h").rlike(r"\A[0-9a-fA-F]{64}\z"), F.lower("h")).alias("hash"), F.expr("try_cast(a AS int)").alias("pack_id"),
        F.expr("try_cast(b AS bigint)").alias("pack_offset"), F.expr("try_cast(c AS bigint)").alias("length"),
    ).dropna()


def live_tracker(announces: DataFrame, ttl_s: int = FRESH_S, delay: str = "10 minutes") -> DataFrame:
    """Changes of freshness ``(cid, peer, event, ts)``: ``fresh`` with each newer announcement, ``gone`` once it is ``ttl_s`` old.

    Time is event time: ``ts`` with a watermark. State is one timestamp per (cid, peer).
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cid, peer = key
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"cid": [cid], "peer": [peer], "event": ["gone"], "ts": [pd.Timestamp(last, unit="ms")]})
            return
        last = state.get[0] if state.exists else -1
        newest = max([last, *(int(f["ts"].max().timestamp() * 1000) for f in frames if len(f))])
        if newest > last:
            state.update((newest,))
            yield pd.DataFrame({"cid": [cid], "peer": [peer], "event": ["fresh"], "ts": [pd.Timestamp(newest, unit="ms")]})
        state.setTimeoutTimestamp(max(newest + ttl_s * 1000, state.getCurrentWatermarkMs() + 1))

    known = announces.where(F.col("cid").isNotNull() & F.col("peer").isNotNull()).withWatermark("ts", delay)
    return known.groupBy("cid", "peer").applyInPandasWithState(
        step, "cid string, peer string, event string, ts timestamp", "last bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def live_choke(events: DataFrame, threshold: int) -> DataFrame:
    """Admissions ``(seq, admitted)`` of events ``(grp, seq, is_credit, bytes)``, in order of ``seq`` within a group and batch.

    State is one balance per group; groups are what requests of one peer to one node
    are keyed by, and a batch of a group is folded at once.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        balance = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("seq")
        admitted = []
        for credit, n in zip(rows["is_credit"].fillna(False), rows["bytes"].fillna(0).astype(int), strict=True):
            ok = bool(credit) or balance >= -threshold
            balance += n if credit else (-n if ok else 0)
            admitted.append(ok)
        state.update((int(balance),))
        yield pd.DataFrame({"seq": rows["seq"].to_numpy(), "admitted": admitted})

    return events.groupBy("grp").applyInPandasWithState(step, "seq bigint, admitted boolean", "balance bigint", "append", GroupStateTimeout.NoTimeout)


def live_throttle(updates: DataFrame, interval: int) -> DataFrame:
    """Progress updates ``(op, seq, ms, done)`` that are passed on: ``(op, seq)``; state is the time of the last one emitted."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ms", "seq"])
        out = []
        for seq, ms, done in zip(rows["seq"], rows["ms"], rows["done"].fillna(False), strict=True):
            if last is None or done or ms - last >= interval:
                last = int(ms)
                out.append(seq)
        state.update((last,))
        yield pd.DataFrame({"op": [key[0]] * len(out), "seq": out})

    return updates.groupBy("op").applyInPandasWithState(step, "op string, seq bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


def live_first_contact(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first request of each (server, client, session); late repeats within the delay are dropped with bounded state."""
    return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["server", "client", "session"])
