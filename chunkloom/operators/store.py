"""The chunk store: index, membership, deduplicating puts, reads, packs and index lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chunkloom.operators.prefix import group_spans, running_total

#: A pack is closed before a write once it holds so many bytes.
PACK_BYTES = 256 << 20
#: Kinds of places by priority of reading.
KINDS = ("packed", "legacy", "ref")


def current_index(log: DataFrame, key: str, order: list[str], op: str = "line_op", put: str = "put") -> DataFrame:
    """The last line of each key by ``order``, if it's a put; partially aggregated, so hot keys don't gather. Null keys are no keys."""
    rest = [c for c in log.columns if c != key]
    last = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__l"))
    return last.select(key, "__l.*").where(F.col(op) == put)


def membership(rows: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``has``: whether the key is held. A null key isn't. Repeated held keys don't multiply rows."""
    there = held.select(F.col(key).alias("__k")).where(F.col("__k").isNotNull()).distinct()
    return rows.join(there, F.col(key) == F.col("__k"), "left").select(*rows.columns, F.col("__k").isNotNull().alias("has"))


def missing(rows: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't held, repeats included; null keys are missing."""
    return rows.join(held.select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")


def put(rows: DataFrame, held: DataFrame, key: str, order: str) -> DataFrame:
    """``rows`` with ``is_new``: the first row of its key, and the key isn't held yet. ``order`` is unique.

    First rows come from a partially aggregated minimum, joined by the unique order, so
    one hot key loads no task. Null keys are never new.
    """
    first = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.min(order).alias("__o"))
    known = held.select(F.col(key).alias("__h"))
    new = first.join(known, F.col("__k") == F.col("__h"), "left_anti").select("__o")
    return rows.join(new, F.col(order) == F.col("__o"), "left").select(*rows.columns, F.col("__o").isNotNull().alias("is_new"))


def locate(rows: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of the place of best kind; nulls where there's none."""
    rest = [c for c in places.columns if c != key]
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    best = places.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.min_by(F.struct(*rest), rank).alias("__p"))
    return rows.join(best, F.col(key) == F.col("__k"), "left").select(*rows.columns, "__p.*")


def read_packs(places: DataFrame, packs: DataFrame, key: str, digest: Column | None = None) -> DataFrame:
    """``(key, bytes, corrupt)``: slices of ``packs (pack_id, content)``; corrupt if the hash of the slice isn't the key."""
    met = places.join(packs.withColumnRenamed("pack_id", "__p"), F.col("pack_id") == F.col("__p"), "left")
    part = F.substring(F.col("content"), (F.col("pack_offset") + 1).cast("int"), F.col("length").cast("int"))
    got = met.select(key, part.alias("bytes"))
    return got.withColumn("corrupt", F.when(F.col("bytes").isNotNull(), F.unhex(F.sha2("bytes", 256)) != (F.col(key) if digest is None else digest)))


def object_count(places: DataFrame, key: str, kind: str) -> DataFrame:
    """``n_objects``: distinct keys packed or stored singly; mere references don't count."""
    return places.where(F.col(kind) != "ref").where(F.col(key).isNotNull()).select(key).distinct().agg(F.count("*").alias("n_objects"))


def dedup_ratio(refs: DataFrame, group: str, key: str, length: str) -> DataFrame:
    """``(group, n_refs, n_unique, dedup_pct)``; two steps, so a hot group's keys spread out."""
    per_key = refs.groupBy(group, key).agg(F.count("*").alias("n"))
    own = per_key.groupBy(group).agg(F.sum("n").alias("n_refs"), F.count("*").alias("n_unique"))
    return own.select("*", (F.lit(100.0) * (1 - F.col("n_unique") / F.col("n_refs"))).alias("dedup_pct"))


def progress(chunks: DataFrame, tree: str, ordinal: str, length: str, key: str, order: str) -> DataFrame:
    """Ingest progress per chunk: bytes done with it, bytes in all, and whether it was new to the store."""
    placed = running_total(chunks, tree, ordinal, F.col(length), "before")
    totals = chunks.groupBy(F.col(tree).alias("__t")).agg(F.sum(length).alias("bytes_total"))
    first = chunks.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("__o")).select("__o")
    met = placed.join(totals, F.col(tree).eqNullSafe(F.col("__t"))).join(first, F.col(order) == F.col("__o"), "left")
    return met.select(order, tree, ordinal, (F.col("before") + F.col(length)).alias("bytes_done"), "bytes_total", F.col("__o").isNotNull().alias("is_new"))


def parse_index_lines(lines: DataFrame, line: str, number: str) -> DataFrame:
    """``(hash, pack_id, pack_offset, length)`` of tab-separated lines; malformed ones are skipped, the last line of a hash wins."""
    f = F.split(line, "\t", 4)
    # ANSI casts raise, so fields are tried
    cols = lines.select(F.col(number).alias("__n"), F.get(f, 0).alias("h"), *(F.get(f, i).alias(c) for i, c in ((1, "a"), (2, "b"), (3, "c"))))
    typed = cols.select(
        "__n", F.when(F.col("h").rlike(r"\A[0-9a-fA-F]{64}\z"), F.lower("h")).alias("hash"),
        F.expr("try_cast(a AS int)").alias("pack_id"), F.expr("try_cast(b AS bigint)").alias("pack_offset"), F.expr("try_cast(c AS bigint)").alias("length"),
    ).dropna()
    last = typed.groupBy("hash").agg(F.max_by(F.struct("pack_id", "pack_offset", "length"), "__n").alias("l"))
    return last.select("hash", "l.*")


def parse_reference_lines(lines: DataFrame, line: str, number: str) -> DataFrame:
    """``(hash, offset, length, path)`` of tab-separated lines of referenced chunks; the path is whatever follows the third tab.

    Malformed lines (a torn last one, say) are skipped; the last line of a hash wins.
    """
    f = F.split(line, "\t", 4)
    cols = lines.select(F.col(number).alias("__n"), *(F.get(f, i).alias(c) for i, c in enumerate(("h", "a", "b", "path"))))
    unsigned = lambda c: F.when(F.col(c).rlike(r"\A[0-9]+\z"), F.col(c).try_cast("bigint"))
    typed = cols.select(
        "__n", F.when(F.col("h").rlike(r"\A[0-9a-fA-F]{64}\z"), F.lower("h")).alias("hash"), unsigned("a").alias("offset"),
        F.when(unsigned("b") < 2**32, unsigned("b")).alias("length"), "path",
    ).dropna()
    last = typed.groupBy("hash").agg(F.max_by(F.struct("offset", "length", "path"), "__n").alias("l"))
    return last.select("hash", "l.*")


def shard_path(hash_text: Column) -> Column:
    """Path of a singly stored object: ``objects/`` two digits ``/`` the whole hash."""
    return F.concat_ws("/", F.lit("objects"), F.substring(hash_text, 1, 2), hash_text)


def index_line(key: Column, pack: Column, offset: Column, length: Column) -> Column:
    return F.concat_ws("\t", key, pack.cast("string"), offset.cast("string"), length.cast("string"))


def reference_line(key: Column, offset: Column, length: Column, path: Column) -> Column:
    return F.concat_ws("\t", key, offset.cast("string"), length.cast("string"), path)


def pack_placement(chunks: DataFrame, writer: str, order: str, length: str, cap: int = PACK_BYTES) -> DataFrame:
    """``(writer, order, pack_no, pack_offset, length)``: packs filled in order, a new one begun once the last holds ``cap``.

    Every writer fills its own packs. The rule is a sum that starts again at the pack
    after next to no rows, so it isn't a window; rows stream through an Arrow fold
    that keeps two numbers, sorted by the shuffle, never gathered. Null lengths are 0.
    """
    slim = chunks.select(F.col(writer).alias("w"), F.col(order).cast("bigint").alias("o"), F.coalesce(F.col(length).cast("bigint"), F.lit(0).cast("bigint")).alias("n"))
    kind = chunks.schema[writer].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pack, used = None, 0, 0
        for b in batches:
            w, n = b.column(0), b.column(2).to_numpy(zero_copy_only=False)
            packs, offsets = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for name, start, end in group_spans(w):
                if (name,) != at:
                    at, pack, used = (name,), 0, 0
                while start < end:
                    # all rows up to the one that fills the pack go into it
                    before = used + np.cumsum(n[start:end]) - n[start:end]
                    k = int(np.searchsorted(before, cap)) or 0
                    if k == 0:
                        pack, used = pack + 1, 0
                        continue
                    packs[start : start + k], offsets[start : start + k] = pack, before[:k]
                    used = int(before[k - 1] + n[start + k - 1])
                    start += k
            yield pa.RecordBatch.from_arrays([w, b.column(1), pa.array(packs), pa.array(offsets), b.column(2)], names=[writer, order, "pack_no", "pack_offset", "length"])

    return slim.repartition("w").sortWithinPartitions("w", "o").mapInArrow(run, f"{writer} {kind}, {order} bigint, pack_no bigint, pack_offset bigint, length bigint")


def registry(manifests: DataFrame, key: str, order: str) -> DataFrame:
    """One manifest per key: the first by the unique ``order``; registering again changes nothing."""
    first = manifests.groupBy(key).agg(F.min(order).alias("__o")).select("__o")
    return manifests.join(first, F.col(order) == F.col("__o"), "left_semi")
