"""Measurements over the other operators, as rows ``(experiment, metric, value)``."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

# The generator xorshift64* and how it is seeded.
SEED_START, SEED_STEP, MULTIPLIER = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x2545F4914F6CDD1D
_MASK = (1 << 64) - 1


def sample_bytes(n: int, seed: int) -> bytes:
    """``n`` reproducible bytes of high entropy."""
    x, out = (SEED_START ^ (seed * SEED_STEP & _MASK)) or 1, np.empty(n, np.uint8)
    for i in range(n):
        x ^= x >> 12
        x = x ^ (x << 25) & _MASK
        x ^= x >> 27
        out[i] = ((x * MULTIPLIER & _MASK) >> 33) & 0xFF
    return out.tobytes()


def edited_copy(data: bytes, at: int, insert: bytes) -> bytes:
    return data[:at] + insert + data[at:]


def dedup_of_edit(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """``(total_chunks, unique_chunks, dedup_pct)`` of two versions' chunks in one store."""
    both = first.select(key).unionByName(second.select(key)).groupBy(key).agg(F.count("*").alias("n"))
    own = both.agg(F.sum("n").alias("total_chunks"), F.count("*").alias("unique_chunks"))
    return own.select("*", (F.lit(100.0) * (1 - F.col("unique_chunks") / F.col("total_chunks"))).alias("dedup_pct"))


def permanence(provided: DataFrame, root: str, peer: str, order: str) -> DataFrame:
    """``(root, seeder, n_others, survives)``: whether anyone but the first provider still has the content."""
    first = provided.where(F.col(peer).isNotNull()).groupBy(root, peer).agg(F.min(order).alias("o"))
    seeder = first.groupBy(F.col(root).alias("__r")).agg(F.min_by(peer, "o").alias("seeder"), F.count("*").alias("__n"))
    return seeder.select(F.col("__r").alias(root), "seeder", (F.col("__n") - 1).alias("n_others"), (F.col("__n") > 1).alias("survives"))


def completed(admissions: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, n_requests, n_refused, completes)`` of downloads whose requests were judged one by one."""
    own = admissions.groupBy(*keys).agg(F.count("*").alias("n_requests"), F.count_if(~F.col("admitted")).alias("n_refused"))
    return own.withColumn("completes", F.col("n_refused") == 0)


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """One-row frames as long rows ``(experiment, metric, value)``."""
    long = []
    for name, df in parts.items():
        pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns))
        long.append(df.select(F.lit(name).alias("experiment"), F.explode(pairs).alias("p")).select("experiment", "p.metric", "p.value"))
    return reduce(DataFrame.unionByName, long)


def markdown(rows: list[tuple[str, str, float]], title: str = "Report") -> str:
    """A table of report rows, which are as few as there are metrics."""
    body = [f"| {e} | {m} | {v:.2f} |" for e, m, v in rows]
    return "\n".join([f"# {title}", "", "| Experiment | Metric | Value |", "|---|---|---|", *body, ""])
