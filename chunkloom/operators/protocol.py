"""Request and event lines (one JSON object each) and the checks over them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chunkloom.operators.prefix import group_spans

# Commands and their required fields (a container is given as ``manifest``).
REQUIRED = {"fetch": ["uri", "out"], "torrent": ["input"], "provide": ["manifest"], "unprovide": ["root"], "status": [], "shutdown": []}
OPTIONAL, CONVERT, CONVERT_SHAPES = {"torrent": ["out"]}, ["torrent", "data", "path"], [("STRING", "STRING", "VOID"), ("VOID", "VOID", "STRING")]
FIELDS = ["uri", "out", "torrent", "data", "path", "input", "manifest", "root"]
LINE_LIMIT, PROGRESS_MS, WARN_MS, MOST_ID = 8 << 20, 100, 600_000, 2**64 - 1

_HASH, _PARSED, _TOP = "__hash", "__parsed", "__top"


def _kind(name: str) -> Column:
    """STRING, VOID (absent or null) or another type of a top-level field."""
    return F.coalesce(F.schema_of_variant(F.col(f"{_TOP}.{name}")), F.lit("VOID"))


def parse_requests(lines: DataFrame, line: str) -> DataFrame:
    """``lines`` with ``id, cmd, error`` of each, one JSON parse a line.

    ``error`` is null, ``NotJson``, ``NoId``, ``UnknownCommand``, ``MissingField``,
    ``BadShape`` or ``TooLong``; ``cmd`` is null where there is an error. ``id`` is an
    unsigned 64-bit number as decimal(20, 0), taken from the top level of any line that
    is one JSON object, even if it isn't a request; 0 otherwise. A line with a key
    given twice, a null line and whatever isn't one object are ``NotJson``.
    """
    text, kept = F.col(f"`{line}`"), [F.col(f"`{c}`") for c in lines.columns]
    short = F.when(F.coalesce(F.octet_length(text) <= LINE_LIMIT, F.lit(False)), text)
    # each step is a projection of its own, so that nothing is parsed or looked up twice
    hashed = lines.select(*kept, F.sha1(short).alias(_HASH))
    # the parser stops after one value, so whatever follows it would go unnoticed: the
    # hash is the second and last element only if the line is exactly one value
    parsed = hashed.select(*kept, _HASH, F.try_parse_json(F.concat(F.lit("["), short, F.lit(',"'), F.col(_HASH), F.lit('"]'))).alias(_PARSED))
    whole = (F.try_variant_get(F.col(_PARSED), "$[1]", "string") == F.col(_HASH)) & F.try_variant_get(F.col(_PARSED), "$[2]", "variant").isNull()
    shape = ", ".join(f"{n}: variant" for n in ["id", "cmd", *FIELDS])
    top = parsed.select(*kept, F.when(whole & text.rlike(r"\A[ \t\r\n]*\{"), F.try_variant_get(F.col(_PARSED), "$[0]", f"struct<{shape}>")).alias(_TOP))
    # numbers beyond 63 bits are decimals without a fraction
    number = F.when(_kind("id").rlike(r"\A(BIGINT|DECIMAL\((19|20),0\))\z"), F.try_variant_get(F.col(f"{_TOP}.id"), "$", "decimal(20,0)"))
    named = top.select(*kept, _TOP, number.alias("__number"), F.when(_kind("cmd") == "STRING", F.try_variant_get(F.col(f"{_TOP}.cmd"), "$", "string")).alias("__cmd"))
    cmd = F.col("__cmd")
    ident = F.when(F.col("__number").between(F.lit(0), F.lit(str(MOST_ID)).cast("decimal(20,0)")), F.col("__number"))
    # only the fields of the line's own command are looked at
    wrong = F.when(cmd == "convert", F.when(~F.array(*(_kind(f) for f in CONVERT)).isin(*(F.array(*map(F.lit, kinds)) for kinds in CONVERT_SHAPES)), "BadShape"))
    for name, need in REQUIRED.items():
        lacks = reduce(Column.__or__, ((_kind(f) != "STRING") for f in need), F.lit(False))
        odd = reduce(Column.__or__, (~_kind(f).isin("STRING", "VOID") for f in OPTIONAL.get(name, [])), F.lit(False))
        wrong = wrong.when(cmd == name, F.when(lacks, "MissingField").when(odd, "BadShape"))
    error = (
        F.when(F.coalesce(F.octet_length(text) > LINE_LIMIT, F.lit(False)), "TooLong")
        .when(F.col(_TOP).isNull(), "NotJson")
        .when(ident.isNull(), "NoId")
        .when(F.coalesce(~cmd.isin(*REQUIRED, "convert", "dial"), F.lit(True)), "UnknownCommand")
        .otherwise(wrong)
    )
    told = named.select(*kept, F.coalesce(ident, F.lit(0)).cast("decimal(20,0)").alias("__id"), "__cmd", error.alias("__error"))
    return told.select(*kept, F.col("__id").alias("id"), F.when(F.col("__error").isNull(), F.col("__cmd")).alias("cmd"), F.col("__error").alias("error"))


def progress_event(ident: Column, op: Column, done: Column, total: Column) -> Column:
    return F.to_json(F.struct(ident.alias("id"), F.lit("progress").alias("event"), op.alias("op"), done.alias("done"), total.alias("total")))


def result_event(ident: Column, **fields: Column) -> Column:
    return F.to_json(F.struct(ident.alias("id"), F.lit("result").alias("event"), F.lit(True).alias("ok"), *(c.alias(n) for n, c in fields.items())))


def error_event(ident: Column, message: Column) -> Column:
    return F.to_json(F.struct(ident.alias("id"), F.lit("error").alias("event"), F.lit(False).alias("ok"), message.alias("message")))


def ready_event(version: Column) -> Column:
    return F.to_json(F.struct(F.lit("ready").alias("event"), version.alias("version")))


def warn_event(message: Column) -> Column:
    return F.to_json(F.struct(F.lit("warn").alias("event"), message.alias("message")))


def throttled(updates: DataFrame, op: str, at_ms: str, order: str, complete: str, interval: int = PROGRESS_MS) -> DataFrame:
    """``(order, emitted)``: the first update of each operation, then those ``interval`` after the last emitted; completions always.

    Each decision rests on the one before, so rows stream through a fold, sorted by
    the shuffle, with one number of state per operation; it leaps from one emitted
    update to the next. Times must not be null.
    """
    slim = updates.select(F.col(op).alias("g"), F.col(order).cast("bigint").alias("o"), F.col(at_ms).cast("bigint").alias("t"), F.coalesce(complete, F.lit(False)).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, 0
        for b in batches:
            time, done = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            out = done.copy()
            for name, start, end in group_spans(b.column(0)):
                ends = np.r_[np.flatnonzero(done[start:end]) + start, end]
                k = start
                if (name,) == at:  # the first update that is due
                    k += int(np.searchsorted(time[start:end], last + interval))
                at = (name,)
                while True:  # from one emitted update to the next
                    k = min(k, int(ends[np.searchsorted(ends, start)]))  # or a completion before
                    if k >= end:
                        break
                    out[k], last = True, int(time[k])
                    start = k + 1
                    k = start + int(np.searchsorted(time[start:end], last + interval))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out)], names=[order, "emitted"])

    return slim.repartition("g").sortWithinPartitions("g", "t", "o").mapInArrow(run, f"{order} bigint, emitted boolean")


def terminal_check(events: DataFrame, ident: str, kind: str) -> DataFrame:
    """``(ident, n_terminal, ok)``: exactly one ``result`` or ``error`` per id."""
    n = F.count_if(F.col(kind).isin("result", "error"))
    return events.groupBy(ident).agg(n.alias("n_terminal")).withColumn("ok", F.col("n_terminal") == 1)
