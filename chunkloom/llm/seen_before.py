"""Has this key been seen before? Scalable Bloom chains over sharded history.

Rows are taken in order of arrival. Each shard of the key space keeps a chain of
Bloom layers: a layer of twice the capacity and half the error rate is added once
the last one's bits are half set, so the compounded false-positive rate stays below
``2 * first_error`` however long the history grows.

The chain decides. A negative answer is always right and is taken as it is: that row
is the first of its key. Of the positives only those that no passed row or history
key explains can be wrong (their rate is bounded), and an exact look-up among the
passed keys finds them; of each such key the first asked row is put right.

Before the shuffle, rows of one key within an Arrow batch are reduced to the first
one (the others have an earlier row, whatever else there is), so a hot key sends one
row per batch of some thousand rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from chunkloom.session import materialize
from chunkloom.sources.state import load_state, parts_since_whole, save_part, save_state

#: First layer: keys, and error rate; further layers grow and tighten geometrically.
FIRST_CAPACITY, FIRST_ERROR, GROWTH, TIGHTENING = 1 << 16, 5e-4, 2, 0.5
#: Keys, known and new, that a shard should hold; saved batches after which the chains are saved whole again.
SHARD_KEYS, WHOLE_AFTER = 1 << 21, 8


class BloomLayer:
    """One filter of fixed size over pairs of 64-bit hashes."""

    def __init__(self, capacity: int, error: float):
        self.capacity, self.error, self.held = capacity, error, 0
        self.hashes = max(1, math.ceil(math.log2(1 / error)))
        self.size = max(64, math.ceil(capacity * self.hashes / math.log(2) / 64) * 64)
        self.words, self.bits_set = np.zeros(self.size // 64, np.uint64), 0

    def _at(self, h1: np.ndarray, h2: np.ndarray, i: int) -> np.ndarray:
        return (h1 + np.uint64(i) * (h2 | np.uint64(1))) % np.uint64(self.size)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        yes = np.arange(len(h1))
        for i in range(self.hashes):
            at = self._at(h1[yes], h2[yes], i)
            yes = yes[(self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
            if not len(yes):
                break
        out = np.zeros(len(h1), bool)
        out[yes] = True
        return out

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        at = np.unique(np.concatenate([self._at(h1, h2, i) for i in range(self.hashes)]))
        word = at >> np.uint64(6)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        masks = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
        where = word[first].astype(np.int64)
        before = self.words[where]
        self.words[where] = before | masks
        self.bits_set += int(np.bitwise_count(masks & ~before).sum())
        self.held += len(h1)

    @property
    def full(self) -> bool:
        return self.held >= self.capacity or 2 * self.bits_set >= self.size


class BloomChain:
    """Layers with tightening error rates; see the module's text."""

    def __init__(self, capacity: int = FIRST_CAPACITY, error: float = FIRST_ERROR):
        self.layers = [BloomLayer(capacity, error)]

    def rows(self) -> list[dict]:
        """The layers as rows, to be kept between batches."""
        return [
            {"layer": i, "capacity": x.capacity, "error": x.error, "held": x.held, "bits_set": x.bits_set, "words": x.words.tobytes()}
            for i, x in enumerate(self.layers)
        ]

    @classmethod
    def of_rows(cls, rows: list[dict], capacity: int, error: float) -> BloomChain:
        """The chain kept by ``rows``; a new one for none."""
        chain = cls(capacity, error)
        for i, r in enumerate(sorted(rows, key=lambda r: r["layer"])):
            layer = BloomLayer(int(r["capacity"]), float(r["error"]))
            layer.words, layer.held, layer.bits_set = np.frombuffer(bytes(r["words"]), np.uint64).copy(), int(r["held"]), int(r["bits_set"])
            chain.layers[i:] = [layer]
        return chain

    @property
    def bound(self) -> float:
        """Upper bound of the false-positive rate so far."""
        return 1 - math.prod(1 - x.error for x in self.layers)

    def seen(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Answers for keys in order, each taken in afterwards if new."""
        pair = np.empty(len(h1), [("a", np.uint64), ("b", np.uint64)])
        pair["a"], pair["b"] = h1, h2
        _, first = np.unique(pair, return_index=True)
        answer = np.ones(len(h1), bool)  # repeated within this call: seen
        first.sort()
        a, b = h1[first], h2[first]
        known = np.zeros(len(first), bool)
        for layer in self.layers:
            ask = np.flatnonzero(~known)
            if not len(ask):
                break
            known[ask] = layer.has(a[ask], b[ask])
        answer[first] = known
        a, b = a[~known], b[~known]
        while len(a):
            top = self.layers[-1]
            if top.full:
                top = BloomLayer(top.capacity * GROWTH, top.error * TIGHTENING)
                self.layers.append(top)
            room = max(1, top.capacity - top.held)
            top.add(a[:room], b[:room])
            a, b = a[room:], b[room:]
        return answer


def error_bound(first_error: float = FIRST_ERROR) -> float:
    """Bound of the compounded false-positive rate for any number of layers."""
    return first_error / (1 - TIGHTENING)


def first_in_batch(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row ``(key, at)`` of each key within each Arrow batch of a task, without a shuffle; null keys are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = pa.Table.from_batches([b]).group_by("key").aggregate([("at", "min")])
            yield from least.select(["key", "at_min"]).rename_columns(["key", "at"]).to_batches()

    picked = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("binary").alias("key"), F.col(order).cast("bigint").alias("at"))
    return picked.mapInArrow(run, "key binary, at bigint")


def _hashes() -> list:
    """Two 64-bit hashes; the shard follows the second one's whole value, filter positions follow other bits of both."""
    return [F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(77), "key").alias("h2")]


def shards_for(n_keys: int, spark: SparkSession, shard_keys: int = SHARD_KEYS) -> int:
    """Shards for so many keys, history and new ones together."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_keys // shard_keys))


def chain_answers(
    firsts: DataFrame, shards: int, capacity: int = FIRST_CAPACITY, error: float = FIRST_ERROR
) -> DataFrame:
    """``firsts`` (key, at) with the chain's answer ``seen``, rows of a shard taken in order of ``at``."""
    placed = firsts.select("key", "at", *_hashes()).repartition(shards, "h2").sortWithinPartitions("at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = BloomChain(capacity, error)
        for b in batches:
            h = [b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (2, 3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(chain.seen(*h))], names=["key", "at", "seen"])

    return placed.mapInArrow(run, "key binary, at bigint, seen boolean")


def settled(answers: DataFrame, error: float = FIRST_ERROR) -> DataFrame:
    """First rows ``(key, at, missed)`` from the chain's answers, which must be a table (they are read several times).

    Rows the chain passed as new are new. Positives whose key it never passed are its
    wrong answers (``missed``), of which the first row of each key is new. More of
    them than the chain's bound allows for mean a broken filter, and raise.
    """
    passed = answers.where(~F.col("seen"))
    doubtful = answers.where("seen").groupBy("key").agg(F.min("at").alias("at"))
    missed = materialize(doubtful.join(passed.select("key"), "key", "left_anti"), "unexplained")
    n_new, n_wrong = passed.count(), missed.count()
    if n_wrong > 4 * error_bound(error) * (n_new + n_wrong) + 20:
        raise RuntimeError(f"{n_wrong} wrong answers for {n_new + n_wrong} new keys: more than the chain's bound allows for")
    return passed.select("key", "at", F.lit(False).alias("missed")).unionByName(missed.select("key", "at", F.lit(True).alias("missed")))


def not_seen(
    rows: DataFrame, key: str, order: str, history: DataFrame, history_key: str, n_rows: int,
    shard_keys: int = SHARD_KEYS, capacity: int = FIRST_CAPACITY, error: float = FIRST_ERROR,
) -> DataFrame:
    """Rows ``(key, at, missed)`` that are the first of their key, in order of ``order`` (unique, not negative).

    ``history`` holds keys known beforehand; they enter the chain ahead of all rows
    and come out with ``at`` = -1. Null keys are neither seen nor taken in. Empty
    tables give no rows.
    """
    before = history.where(F.col(history_key).isNotNull()).select(F.col(history_key).cast("binary").alias("key"), F.lit(-1).cast("bigint").alias("at")).distinct()
    shards = shards_for(n_rows + before.count(), rows.sparkSession, shard_keys)
    firsts = before.unionByName(first_in_batch(rows, key, order))
    return settled(materialize(chain_answers(firsts, shards, capacity, error), "answers"), error)


STATE = "shard int, layer int, capacity bigint, error double, held bigint, bits_set bigint, words binary"
_NAMES = [f.split()[0] for f in STATE.split(", ")]


class SeenFilter:
    """A filter that is kept in a folder and asked batch by batch; memory of a task is one shard's chain and an Arrow batch.

    The number of shards is fixed with the first batch (``shards_for`` the keys it is
    to hold in the end). A batch saves only the layers it changed. Answers "not seen"
    are always right; "seen" is wrong with a rate of at most ``error_bound(error)``.
    """

    def __init__(self, spark: SparkSession, folder: str, shards: int, capacity: int = FIRST_CAPACITY, error: float = FIRST_ERROR):
        self.spark, self.folder, self.shards, self.capacity, self.error = spark, folder, shards, capacity, error

    def state(self) -> DataFrame:
        """The chains' layers by shard."""
        kept = load_state(self.spark, self.folder, STATE)
        return kept.groupBy("shard", "layer").agg(F.max_by(F.struct(*_NAMES[2:]), "held").alias("s")).select("shard", "layer", "s.*")

    def ask(self, batch: DataFrame, key: str, order: str) -> DataFrame:
        """``(order, seen)`` of every row of a batch, in order of arrival; its keys are then known. Null keys are not seen."""
        shards, capacity, error = self.shards, self.capacity, self.error
        rows = batch.select(F.col(order).cast("bigint").alias("at"), F.col(key).cast("binary").alias("key"))
        firsts = first_in_batch(rows, "key", "at").select("at", *_hashes())
        asked = firsts.select(F.pmod("h2", F.lit(shards)).cast("int").alias("shard"), "at", "h1", "h2", *(F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in STATE.split(", ")[1:]))
        kept = load_state(self.spark, self.folder, STATE).select("shard", *(F.lit(None).cast("bigint").alias(n) for n in ("at", "h1", "h2")), *_NAMES[1:])
        # a shard's layers come first, older states of a layer before newer ones, then its rows in order
        both = kept.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", F.col("layer").isNull(), "layer", "held", "at")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, chain, layers, held = None, None, {}, []
            for b in batches:
                shard = b.column(0).to_numpy(zero_copy_only=False)
                for part in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(shard)) + 1):
                    if not len(part):
                        continue
                    if own != int(shard[part[0]]):
                        yield from _changed(own, chain, held)
                        own, chain, layers = int(shard[part[0]]), None, {}
                    piece = b.slice(int(part[0]), len(part))
                    n_layers = piece.num_rows - piece.column(4).null_count
                    for r in piece.slice(0, n_layers).to_pylist():
                        layers[r["layer"]] = r
                    asks = piece.slice(n_layers)
                    if not asks.num_rows:
                        continue
                    if chain is None:
                        chain = BloomChain.of_rows(list(layers.values()), capacity, error)
                        held = [x.held for x in chain.layers] if layers else []
                    h = [asks.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (2, 3)]
                    yield _told(own, asks.column(1), chain.seen(*h))
            yield from _changed(own, chain, held)

        done = materialize(both.mapInArrow(run, f"{STATE}, at bigint, seen boolean"), "asked")  # once: the new state and the answers come from the same run
        save_part(done.where(F.col("layer").isNotNull()).select(_NAMES), self.folder)
        if parts_since_whole(self.spark, self.folder) >= WHOLE_AFTER:
            save_state(self.state(), self.folder)
        first = done.where(F.col("layer").isNull()).select(F.col("at").alias("first_at"), "seen")
        # a key's later rows in an Arrow batch have been seen in it
        met = rows.join(first, F.col("at") == F.col("first_at"), "left")
        return met.select(F.col("at").alias(order), (F.col("key").isNotNull() & F.coalesce("seen", F.lit(True))).alias("seen"))


_OUT = pa.schema([("shard", pa.int32()), ("layer", pa.int32()), ("capacity", pa.int64()), ("error", pa.float64()), ("held", pa.int64()), ("bits_set", pa.int64()), ("words", pa.binary()), ("at", pa.int64()), ("seen", pa.bool_())])


def _told(shard: int, at: pa.Array, seen: np.ndarray) -> pa.RecordBatch:
    none = [pa.nulls(len(at), f.type) for f in _OUT][1:7]
    return pa.RecordBatch.from_arrays([pa.array([shard] * len(at), pa.int32()), *none, at, pa.array(seen)], schema=_OUT)


def _changed(shard: int | None, chain: BloomChain | None, held: list[int]) -> Iterator[pa.RecordBatch]:
    """The layers that took in keys since ``held``."""
    if chain is not None:
        new = [r for r in chain.rows() if r["layer"] >= len(held) or r["held"] != held[r["layer"]]]
        for r in new:
            yield pa.RecordBatch.from_pylist([{"shard": shard} | r], schema=_OUT)
