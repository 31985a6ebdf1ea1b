"""Receipts, the ledger of who served whom, and the decisions made from it.

Ledger events are rows ``(peer, kind, bytes)`` with kind ``received`` (the peer
served us), ``served`` (we served the peer) or ``credited`` (a verified receipt).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from chunkloom.functions.identity import public_key_udf, sign_udf, verify_udf
from chunkloom.operators.prefix import dense_index, group_spans, running_total

#: Receipts a peer keeps; tag of the signed bytes.
BAG_SIZE, RECEIPT_TAG = 50, b"chunkloom-receipt-v1"
COUNTERS = {"served_to_us": "received", "we_served": "served", "credited_by_receipts": "credited"}


def ledger(events: DataFrame) -> DataFrame:
    """``(peer, served_to_us, we_served, credited_by_receipts)``; null bytes count 0, null peers are no peers."""
    sums = [F.sum(F.when(F.col("kind") == kind, F.coalesce("bytes", F.lit(0).cast("bigint"))).otherwise(0)).alias(name) for name, kind in COUNTERS.items()]
    return events.where(F.col("peer").isNotNull()).groupBy("peer").agg(*sums)


def counters_of(peers: DataFrame, book: DataFrame) -> DataFrame:
    """The counters of asked ``peer``s; zeros for unknown ones."""
    met = peers.join(book.withColumnRenamed("peer", "__p"), F.col("peer") == F.col("__p"), "left").drop("__p")
    return met.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in COUNTERS})


def reputation() -> Column:
    """What the peer gave, directly and by receipts, less what it took."""
    return F.col("served_to_us") + F.col("credited_by_receipts") - F.col("we_served")


def totals(book: DataFrame) -> DataFrame:
    return book.agg(F.count("*").alias("n_peers"), *(F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in COUNTERS))


def unchoke_rank(candidates: DataFrame, book: DataFrame, context: str, slots: int) -> DataFrame:
    """The first ``slots`` distinct peers of each context by reputation, ties by peer; unknown peers have 0.

    Catalyst limits each context's rows before the shuffle, so a hot context doesn't gather.
    """
    ranked = counters_of(candidates.where(F.col("peer").isNotNull()).distinct(), book).withColumn("reputation", reputation())
    w = Window.partitionBy(context).orderBy(F.desc("reputation"), F.asc("peer"))
    return ranked.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= slots).select(context, "peer", "reputation", "slot")


def _little_endian(c: Column) -> Column:
    digits = F.lpad(F.hex(c), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, i, 2) for i in range(15, 0, -2))))


def canonical_bytes(server: Column, client: Column, n_bytes: Column, epoch: Column, tag: bytes = RECEIPT_TAG) -> Column:
    """The bytes that are signed: tag, server, client, and both numbers in little-endian 64 bits; null if any is null."""
    return F.concat(F.lit(tag), server, client, _little_endian(n_bytes), _little_endian(epoch))


def issued_receipts(rows: DataFrame, seed: str) -> DataFrame:
    """``rows (server, bytes, epoch, seed)`` with ``client`` and ``sig``: the client, whose secret ``seed`` is given, signs for what it received.

    ``server`` is a public key of 32 bytes. A null in any signed field or a seed of
    another size gives a null signature.
    """
    keyed = rows.withColumn("client", public_key_udf(seed))
    return keyed.withColumn("sig", sign_udf(F.col(seed), canonical_bytes(F.col("server"), F.col("client"), F.col("bytes"), F.col("epoch"))))


def verified_receipts(receipts: DataFrame) -> DataFrame:
    """``receipts (server, client, bytes, epoch, sig)`` with ``sig_ok``: the client's signature over exactly these fields."""
    message = canonical_bytes(F.col("server"), F.col("client"), F.col("bytes"), F.col("epoch"))
    return receipts.withColumn("sig_ok", verify_udf("client", message, "sig"))


def receipt_bag(receipts: DataFrame, holder: str, identity: list[str], size: str, arrival: str, keep: int = BAG_SIZE) -> DataFrame:
    """What each holder keeps: exact duplicates dropped, the ``keep`` largest, ties to the earlier.

    The same as inserting one by one: a receipt once pushed out can't come back.
    """
    first = receipts.groupBy(*identity).agg(F.min(arrival).alias("__a")).select("__a")
    own = receipts.join(first, F.col(arrival) == F.col("__a"), "left_semi")
    w = Window.partitionBy(holder).orderBy(F.desc_nulls_last(size), F.asc(arrival))
    return own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def submitted(receipts: DataFrame, holder: Column | None = None) -> Column:
    """Whether a submitted receipt is taken: signature valid, for its holder, and not signed for oneself."""
    ok = F.coalesce(F.col("sig_ok") & (F.col("client") != F.col("server")), F.lit(False))
    return ok if holder is None else ok & F.coalesce(F.col("server") == holder, F.lit(False))


def presentation_credit(receipts: DataFrame, response: list[str], order: str, strict: bool = False) -> DataFrame:
    """``(server, credited)``: verified receipts of a response, the first of each (client, epoch) in it.

    A receipt signed for oneself counts here unless ``strict``. Firsts are a partially
    aggregated minimum over the unique ``order``.
    """
    ok = receipts.where(F.coalesce("sig_ok", F.lit(False)) & F.col("server").isNotNull())
    if strict:
        ok = ok.where(F.col("client") != F.col("server"))
    first = ok.groupBy(*response, "server", "client", "epoch").agg(F.min(order).alias("__o")).select("__o")
    own = ok.join(first, F.col(order) == F.col("__o"), "left_semi")
    return own.groupBy("server").agg(F.sum(F.coalesce("bytes", F.lit(0).cast("bigint"))).alias("credited"), F.count("*").alias("n_receipts"))


def choke_admission(requests: DataFrame, group: str, order: str, size: str, credit: Column, threshold: int | None) -> DataFrame:
    """``requests`` with ``admitted``, when nothing is credited in between.

    A request is judged before it counts, so a threshold of 0 gives one free chunk.
    Refusals don't end, so the sum over all earlier requests decides as well as the
    sum over admitted ones. ``threshold`` None refuses nothing.
    """
    placed = running_total(requests, group, order, F.col(size), "taken")
    ok = F.lit(True) if threshold is None else credit - F.col("taken") >= -threshold
    return placed.withColumn("admitted", ok)


def _first_below(sums: np.ndarray, start: int, limit: int) -> int:
    """The first position from ``start`` with a sum below ``limit``; the length if there's none."""
    width = 256
    while start < len(sums):
        below = np.flatnonzero(sums[start : start + width] < limit)
        if len(below):
            return start + int(below[0])
        start, width = start + width, 4 * width
    return len(sums)


def _judge(credit: np.ndarray, size: np.ndarray, balance: int, threshold: int, out: np.ndarray) -> int:
    """Marks the refused requests of one group's next rows in ``out``; returns the balance after them.

    While the peer is served all rows count, up to the one that takes the balance below
    the limit; then only credits count, up to the one that lifts it again. Both ends are
    found in running sums, so the loop turns once per change and not once per row.
    """
    both, credits = np.cumsum(np.where(credit, size, -size)), np.cumsum(np.where(credit, size, 0))
    at, n = 0, len(size)
    while at < n:
        if balance >= -threshold:
            base = int(both[at - 1]) if at else 0
            end = _first_below(both, at, base - threshold - balance)
            last = min(end, n - 1)
            balance += int(both[last]) - base
        else:
            base = int(credits[at - 1]) if at else 0
            last = min(int(np.searchsorted(credits, base - threshold - balance)), n - 1)
            out[at : last + 1] = credit[at : last + 1]
            balance += int(credits[last]) - base
        at = last + 1
    return balance


def _fold_choke(threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, balance = None, 0
        for b in batches:
            credit, size = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            out = np.ones(b.num_rows, bool)
            for name, start, end in group_spans(b.column(0)):
                if (name,) != at:
                    at, balance = (name,), 0
                balance = _judge(credit[start:end], size[start:end], balance, threshold, out[start:end])
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out)], names=["__o", "admitted"])

    return run


def choke_with_credits(events: DataFrame, group: str, order: str, is_credit: str, size: str, threshold: int) -> DataFrame:
    """``(order, admitted)`` of requests and credits in strict order; credits are always admitted.

    Admission feeds back into the balance, so this is a fold: rows stream through it
    sorted by the shuffle, with one number of state per group. Null sizes are 0.
    """
    slim = events.select(F.col(group).alias("g"), F.col(order).cast("bigint").alias("o"), F.coalesce(is_credit, F.lit(False)).alias("c"), F.coalesce(F.col(size).cast("bigint"), F.lit(0).cast("bigint")).alias("n"))
    folded = slim.repartition("g").sortWithinPartitions("g", "o").mapInArrow(_fold_choke(threshold), "__o bigint, admitted boolean")
    return folded.withColumnRenamed("__o", order)


def issued(transfers: DataFrame, download: list[str], client: str, server: str, size: str, order: str) -> DataFrame:
    """Receipts to issue after downloads: one per server with bytes; epochs 0, 1, ... of each client in order of its first chunk."""
    known = transfers.where(F.col(server).isNotNull() & F.col(client).isNotNull())
    sums = known.groupBy(*dict.fromkeys([*download, client, server])).agg(F.sum(size).alias("bytes"), F.min(order).alias("__first")).where(F.col("bytes") > 0)
    return dense_index(sums, client, "__first", "epoch").drop("__first")


def first_contact(requests: DataFrame, book: DataFrame, server: str, client: str) -> DataFrame:
    """The (server, client) pairs of clients without any counter: whom to ask for receipts, once each."""
    pairs = requests.where(F.col(client).isNotNull() & F.col(server).isNotNull()).select(server, client).distinct()
    return pairs.join(book.select(F.col("peer").alias("__p")), F.col(client) == F.col("__p"), "left_anti")
