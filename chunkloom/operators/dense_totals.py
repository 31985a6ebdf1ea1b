"""Per-key totals that no hot key can unbalance.

Keys of each equal input split are dictionary-encoded and reduced into dense numpy
arrays (bincount for counts, scatter-reduce for sums, minima and maxima). The
arrays, one slot per distinct key of a split, are then summed by a second
distributed reduction over blocks of keys, which come sorted, so a task holds the
slots of one batch. A key with a third of all rows sends one slot per ``SPLIT_ROWS``
rows, like any other key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

#: Rows reduced at once within a split; bounds a worker's memory.
SPLIT_ROWS = 400_000

_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _reduce(table: pa.Table, key: str, sums: list[str], least: list[str], most: list[str], fields: pa.Schema) -> pa.RecordBatch:
    codes_of = table[key].combine_chunks().dictionary_encode(null_encoding="encode")
    codes = codes_of.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    slots = len(codes_of.dictionary)
    out = {key: codes_of.dictionary}
    for name in sums:
        col = table[name].combine_chunks()
        there = col.is_valid().to_numpy(zero_copy_only=False)
        values = pc.fill_null(col, 0).to_numpy(zero_copy_only=False)
        total = np.zeros(slots, np.int64)
        np.add.at(total, codes, values)
        rough = np.bincount(codes, values.astype(np.float64), slots)
        if len(rough) and np.abs(rough).max() > 9.2e18:
            raise OverflowError(f"the sum of {name} of one key exceeds 63 bits")
        out[name] = pa.array(total, pa.int64(), mask=np.bincount(codes[there], minlength=slots) == 0)
    for names, empty, ufunc in ((least, _HIGH, np.minimum), (most, _LOW, np.maximum)):
        for name in names:
            col = table[name].combine_chunks()
            there = col.is_valid().to_numpy(zero_copy_only=False)
            values = pc.fill_null(col.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
            total = np.full(slots, empty, np.int64)
            ufunc.at(total, codes[there], values[there])
            out[name] = pa.array(total, pa.int64(), mask=np.bincount(codes[there], minlength=slots) == 0).cast(col.type)
    return pa.RecordBatch.from_arrays([out[f.name].cast(f.type) for f in fields], schema=fields)


def dense_totals(
    df: DataFrame, key: str, count: str = "n", sums: dict[str, str] | None = None,
    least: dict[str, str] | None = None, most: dict[str, str] | None = None,
) -> DataFrame:
    """``key``, the number of its rows, and sums (64-bit integers), minima and maxima of further columns.

    ``sums``, ``least`` and ``most`` map result names to columns; minima and maxima
    take integers or timestamps. Like GROUP BY: null keys are one key, nulls in a
    value are left out, a key with nothing but nulls gets null, no rows give no
    rows. A sum beyond 63 bits raises.
    """
    sums, least, most = sums or {}, least or {}, most or {}
    picked = df.select(
        F.col(key).alias("key"), F.lit(1).cast("bigint").alias(count),
        *(F.col(c).cast("bigint").alias(n) for n, c in sums.items()),
        *(F.col(c).alias(n) for n, c in (least | most).items()),
    )
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in picked.schema])

    args = ("key", [count, *sums], [*least], [*most])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= SPLIT_ROWS:
                yield _reduce(pa.Table.from_batches(held), *args, held[0].schema)
                held = []
        if held:
            yield _reduce(pa.Table.from_batches(held), *args, held[0].schema)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key: list[pa.RecordBatch] = []
        for b in batches:
            done = _reduce(pa.Table.from_batches([*open_key, b]), *args, b.schema)
            if done.num_rows > 1:
                yield done.slice(0, done.num_rows - 1)
            open_key = [done.slice(done.num_rows - 1)] if done.num_rows else open_key  # may go on in the next batch
        yield from open_key

    partial = picked.mapInArrow(split, schema)
    return partial.repartition("key").sortWithinPartitions("key").mapInArrow(block, schema).withColumnRenamed("key", key)


def dense_distinct(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``key`` and the number of distinct non-null values of ``value``; null keys are one key.

    Pairs are made distinct by pair, not by key, so a hot key's pairs spread out;
    the pairs are then counted by ``dense_totals``.
    """
    pairs = df.where(F.col(value).isNotNull()).select(key, value).distinct()
    return dense_totals(pairs, key, count=name)
