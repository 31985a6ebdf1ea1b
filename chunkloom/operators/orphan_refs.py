"""References to records that do not exist.

Sorted integer parent keys are compressed into contiguous runs; each reference is
matched to the preceding run start (an as-of match) and reported when it lies
beyond that run's end.

Both the compression and the match work per (key, block of positions), never per
key, so a key that holds a third of all rows is spread over its blocks. What an
earlier block leaves open is carried over by a window over one row per (key,
block). Positions of parents are compressed on the map side into 64-bit masks.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Parents of one mask word; words of one block, so a block has 65 536 positions.
WORD_BITS, BLOCK_WORDS = 64, 1024
#: Rows that a block of the most frequent key should have; buckets that keys are counted in.
BLOCK_ROWS, COUNT_BUCKETS = 1 << 15, 1 << 16


def block_width(*tables: tuple[DataFrame, str, str], rows: int = BLOCK_ROWS) -> int:
    """A width of position blocks that gives the most frequent key about ``rows`` rows a block, if they lie evenly.

    ``tables`` are (rows, key, position). The most frequent key is estimated from counts
    of keys in hashed buckets, less an even share; the estimate only sets the width, so
    it grows no task however large the tables and never changes a result.
    """
    picked = [df.where(F.col(k).isNotNull() & F.col(p).isNotNull()).select(F.lit(i).alias("t"), F.pmod(F.xxhash64(k), F.lit(COUNT_BUCKETS)).alias("b"), F.col(p).cast("bigint").alias("p")) for i, (df, k, p) in enumerate(tables)]
    each = reduce(DataFrame.unionByName, picked).groupBy("t", "b").agg(F.count("*").alias("n"), F.min("p").alias("low"), F.max("p").alias("high"))
    told = each.groupBy("t").agg((F.max("n") - F.sum("n") / COUNT_BUCKETS).alias("hot"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    if not told:
        return 1
    span = max(r["high"] for r in told) - min(r["low"] for r in told) + 1
    return max(1, -(-span // max(1, math.ceil(max(r["hot"] for r in told) / rows))))


def compress_runs(parents: DataFrame, key: str, pos: str) -> DataFrame:
    """Contiguous runs ``(key, run_start, run_end)`` of the distinct positions of each key, both ends included.

    Rows with a null key or position are no parents; repeated rows count once; no
    parents give no runs. Negative positions are allowed.
    """
    bit = F.pmod(F.col(pos), F.lit(WORD_BITS))
    words = (
        parents.where(F.col(key).isNotNull() & F.col(pos).isNotNull())
        .select(F.col(key).alias("key"), (F.col(pos) - bit).alias("base"), bit.cast("int").alias("bit"))
        .groupBy("key", "base")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    )
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD_BITS - 1)), lambda i: F.call_function("getbit", F.col("mask"), i) == 1)
    short = words.select("key", "base", F.when(F.col("mask") == -1, F.array(F.struct(F.lit(0).alias("a"), F.lit(63).alias("b")))).otherwise(_runs_of(bits)).alias("runs"))
    pieces = short.select("key", "base", F.explode("runs").alias("r")).select(
        "key",
        (F.col("base") + F.col("r.a")).alias("run_start"),
        (F.col("base") + F.col("r.b")).alias("run_end"),
        F.floor(F.col("base") / (WORD_BITS * BLOCK_WORDS)).cast("bigint").alias("block"),
    )
    in_block = _join_adjacent(pieces, ["key", "block"])
    # only runs that touch a block's edge can go on in the next block: a few rows per block
    span = WORD_BITS * BLOCK_WORDS
    edge = (F.pmod(F.col("run_start"), F.lit(span)) == 0) | (F.pmod(F.col("run_end"), F.lit(span)) == span - 1)
    inner = in_block.where(~edge).select("key", "run_start", "run_end")
    return _join_adjacent(in_block.where(edge), ["key"]).select("key", "run_start", "run_end").unionByName(inner)


def _runs_of(bits: Column) -> Column:
    starts = F.filter(bits, lambda i: (i == 0) | (F.call_function("getbit", F.col("mask"), F.greatest(i - 1, F.lit(0))) == 0))
    ends = F.filter(bits, lambda i: (i == WORD_BITS - 1) | (F.call_function("getbit", F.col("mask"), F.least(i + 1, F.lit(WORD_BITS - 1))) == 0))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _join_adjacent(runs: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("run_start")
    opens = runs.withColumn("opens", F.coalesce((F.lag("run_end").over(w) + 1 != F.col("run_start")).cast("int"), F.lit(1)))
    numbered = opens.withColumn("nr", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "nr").agg(F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"))


def state_runs(log: DataFrame, key: str, pos: str, tie: str, present: Column, block: int) -> DataFrame:
    """Runs of presence ``(key, run_start, run_end)`` from a log of puts and drops, the end excluded.

    The last line of a position (by ``tie``) decides. A run ends at the next change
    within its block, else it is open (end at the largest long) until a later run
    start of the key; a drop is an empty run. Lines that repeat the state within a
    block are left out. Null keys or positions are no lines.
    """
    lines = log.where(F.col(key).isNotNull() & F.col(pos).isNotNull())
    last = lines.groupBy(F.col(key).alias("key"), F.col(pos).alias("at")).agg(F.max_by(present.cast("boolean"), F.col(tie)).alias("on"))
    w = Window.partitionBy("key", F.floor(F.col("at") / block)).orderBy("at")
    changes = last.withColumn("before", F.lag("on").over(w)).where(F.col("before").isNull() | (F.col("before") != F.col("on")))
    return changes.select(
        "key",
        F.col("at").alias("run_start"),
        F.when(~F.col("on"), F.col("at")).otherwise(F.coalesce(F.lead("at").over(w), F.lit(2**63 - 1))).alias("run_end"),
    )


def asof_run_end(refs: DataFrame, runs: DataFrame, key: str, pos: str, block: int) -> DataFrame:
    """``refs`` with ``run_end`` of the run that starts last at or before ``pos``; null where there is none.

    A window over (key, block of positions) finds starts within the block; one over a
    row per (key, block) carries the last run of earlier blocks in. References with a
    null key or position have no run and come out with a null; none is lost.
    """
    blk = lambda c: F.floor(F.col(c) / block).cast("bigint")
    rest = [c for c in refs.columns if c not in (key, pos)]
    asked = refs.where(F.col(key).isNotNull() & F.col(pos).isNotNull())
    lost = refs.where(F.col(key).isNull() | F.col(pos).isNull()).select("*", F.lit(None).cast("bigint").alias("run_end"))
    left = asked.select(F.col(key).alias("__key"), blk(pos).alias("__block"), F.col(pos).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast("bigint").alias("__end"), F.struct(F.lit(0).alias("__"), *rest).alias("__row"))
    right = runs.select(F.col("key").alias("__key"), blk("run_start").alias("__block"), F.col("run_start").alias("__at"), F.lit(0).alias("__kind"), F.col("run_end").alias("__end"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"))
    w = Window.partitionBy("__key", "__block").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    inside = left.unionByName(right).withColumn("__found", F.last("__end", True).over(w)).where(F.col("__kind") == 1)
    # one row per (key, block) that has a run or an unmatched reference
    tails = runs.groupBy(F.col("key").alias("__key"), blk("run_start").alias("__block")).agg(F.max_by("run_end", "run_start").alias("__tail"))
    wanted = asked.select(F.col(key).alias("__key"), blk(pos).alias("__block"), F.lit(None).cast("bigint").alias("__tail")).distinct()
    wb = Window.partitionBy("__key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        tails.unionByName(wanted).groupBy("__key", "__block").agg(F.max("__tail").alias("__tail"))
        .withColumn("__carry", F.last("__tail", True).over(wb))
        .where(F.col("__carry").isNotNull()).select("__key", "__block", "__carry")
    )
    found = inside.join(carried, ["__key", "__block"], "left")
    own = [F.col("__row")[c].alias(c) for c in rest]
    return found.select(F.col("__key").alias(key), F.col("__at").alias(pos), *own, F.coalesce("__found", "__carry").alias("run_end")).unionByName(lost)


def range_orphans(refs: DataFrame, runs: DataFrame, key: str, start: str, count: str, block: int = 1 << 16) -> DataFrame:
    """The ``refs`` that cover a position no run holds: rows with a start and a count above 0.

    Starts are matched once per distinct (key, start), so repeated references cost
    nothing in the match. A null key refers to nothing that exists: an orphan.
    """
    asked = refs.where(F.col(start).isNotNull() & (F.col(count) > 0)).select(
        F.col(key).alias("k"), F.col(start).cast("bigint").alias("s"), F.col(count).cast("bigint").alias("c"), F.struct("*").alias("row")
    )
    starts = asked.select(F.col("k").alias("mk"), F.col("s").alias("ms")).distinct()
    matched = asof_run_end(starts, runs, "mk", "ms", block)
    joined = asked.join(matched, (F.col("k") == F.col("mk")) & (F.col("s") == F.col("ms")), "left")
    gone = F.col("run_end").isNull() | (F.col("run_end") < F.col("s")) | (F.col("c") - 1 > F.col("run_end") - F.col("s"))
    return joined.where(gone).select("row.*")


def state_orphans(refs: DataFrame, runs: DataFrame, key: str, pos: str, block: int) -> DataFrame:
    """The ``refs`` with a key that isn't present at their position, see ``state_runs``; a null position is before all runs."""
    asked = refs.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(pos).alias("p"), F.struct("*").alias("row"))
    matched = asof_run_end(asked, runs, "k", "p", block)
    return matched.where(F.col("run_end").isNull() | (F.col("p") >= F.col("run_end"))).select("row.*")
