"""Running totals and dense positions per group that spread a hot group over blocks.

A window per group would put a group with a third of all rows into one task. Here
rows are windowed per (group, block of the order column), and a window over one row
per (group, block) adds what came before the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Width of a block in units of the order column, which is unique in a group: rows of a block at most.
BLOCK = 1 << 16


def running_total(df: DataFrame, group: str, order: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over earlier rows of the group, 0 for its first row.

    ``order`` is an integer column, unique within a group. Null groups are one group;
    null values count as 0; rows with a null order come first, as one block.
    """
    marked = df.withColumn("__v", F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint"))).withColumn(
        "__b", F.coalesce(F.floor(F.col(order) / block).cast("bigint"), F.lit(-(2**62)).cast("bigint"))
    )
    per_block = marked.groupBy(F.col(group).alias("__g"), F.col("__b").alias("__bb")).agg(F.sum("__v").alias("__t"))
    before = Window.partitionBy("__g").orderBy("__bb").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_block.select("__g", "__bb", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__carry"))
    inside = Window.partitionBy(group, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = marked.withColumn("__in", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    joined = own.join(carry, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__b") == F.col("__bb")))
    return joined.select(*df.columns, (F.col("__in") + F.col("__carry")).alias(name))


def dense_index(df: DataFrame, group: str, order: str, name: str = "idx", block: int = BLOCK) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in the order of ``order`` within each group."""
    return running_total(df, group, order, F.lit(1), name, block)


def group_spans(column: pa.Array) -> Iterator[tuple[Any, int, int]]:
    """(value, start, end) of the stretches of equal values of a column, nulls equal to each other."""
    codes = column.dictionary_encode(null_encoding="encode")
    names, code = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
    if len(code):
        cuts = np.flatnonzero(np.diff(code)) + 1
        for start, end in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(code)].tolist(), strict=True):
            yield names[code[start]], start, end
