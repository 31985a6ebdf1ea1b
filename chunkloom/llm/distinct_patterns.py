"""Distinct counts over huge identifier sets by membership patterns.

Each identifier of a day is reduced to the set of groups that contain it, a bit
pattern; identical patterns are counted. Any union, intersection or difference of
groups is then answered exactly (error bound 0) from the pattern totals, a table
whose size doesn't depend on the number of identifiers. No set is ever held: the
patterns are made by a partially aggregated bitwise or.

States ``(period, id, pattern words)`` of parts of the data merge by a bitwise or per
identifier (``merge_states``); totals of parts with disjoint identifiers add up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Bits used of each pattern word.
WORD = 63


def group_dictionary(df: DataFrame, dims: list[str]) -> list[tuple]:
    """The distinct group values, nulls as a value, in a fixed order; one entry per group, not per row."""
    return sorted((tuple(r) for r in df.select(*dims).distinct().collect()), key=lambda t: [(x is None, x or "") for x in t])


def membership(df: DataFrame, period: str, ident: str, dims: list[str], groups: list[tuple]) -> DataFrame:
    """State ``(period, id, w0, w1, ...)``: bit g of the words tells that the identifier occurs in group g.

    Null identifiers are not counted; null groups are groups; a null period is a period.
    """
    spark = df.sparkSession
    names, own = [f"d{i}" for i in range(len(dims))], [f"own{i}" for i in range(len(dims))]
    fields = ", ".join(f"{n} string" for n in names) + ", grp int"
    known = spark.createDataFrame([(*g, i) for i, g in enumerate(groups)], fields)
    match = reduce(lambda a, b: a & b, (F.col(d).eqNullSafe(F.col(n)) for d, n in zip(own, names, strict=True)))
    rows = df.where(F.col(ident).isNotNull()).select(F.col(period).alias("period"), F.col(ident).alias("id"), *(F.col(d).alias(o) for d, o in zip(dims, own, strict=True)))
    marked = rows.join(known, match, "left").select("period", "id", "grp")
    bits = [
        F.when(F.floor(F.col("grp") / WORD) == w, F.expr(f"shiftleft(1L, grp % {WORD})")).otherwise(F.lit(0).cast("bigint"))
        for w in range(-(-max(1, len(groups)) // WORD))
    ]
    return marked.groupBy("period", "id").agg(*(F.bit_or(b).alias(f"w{w}") for w, b in enumerate(bits)))


def words_of(state: DataFrame) -> list[str]:
    return [c for c in state.columns if c[0] == "w" and c[1:].isdigit()]


def merge_states(*states: DataFrame) -> DataFrame:
    """States of any parts of the data as one, identifiers met in several parts included."""
    both = reduce(DataFrame.unionByName, states)
    return both.groupBy("period", "id").agg(*(F.bit_or(w).alias(w) for w in words_of(both)))


def without_period(state: DataFrame) -> DataFrame:
    """The state over all periods together (``period`` null)."""
    words = words_of(state)
    whole = state.groupBy("id").agg(*(F.bit_or(w).alias(w) for w in words))
    return whole.select(F.lit(None).cast(state.schema["period"].dataType).alias("period"), "id", *words)


def pattern_totals(state: DataFrame) -> DataFrame:
    """``(period, w0, ..., n)``: how many identifiers have each pattern; totals of disjoint identifiers add up."""
    return state.groupBy("period", *words_of(state)).agg(F.count("*").alias("n"))


def merge_totals(*totals: DataFrame) -> DataFrame:
    """Sum of totals whose identifiers are disjoint, such as shards of the identifier space."""
    both = reduce(DataFrame.unionByName, totals)
    return both.groupBy("period", *words_of(both)).agg(F.sum("n").alias("n"))


def _mask(cells: set[int], words: int) -> list[int]:
    return [sum(1 << (g % WORD) for g in cells if g // WORD == w) for w in range(words)]


def answer(totals: DataFrame, questions: dict[str, list[set[int]]]) -> DataFrame:
    """``(period, combination, n)``: identifiers that occur in at least one group of each listed set.

    ``{"x": [{1, 2}]}`` asks for the union of groups 1 and 2, ``{"x": [{1}, {2}]}`` for
    their intersection. Combinations nobody belongs to in a period have no row.
    """
    words = words_of(totals)

    def holds(cells: set[int]) -> Column:
        hit = [F.col(w).bitwiseAND(F.lit(m).cast("bigint")) != 0 for w, m in zip(words, _mask(cells, len(words)), strict=True) if m]
        return reduce(lambda a, b: a | b, hit, F.lit(False))

    told = F.array(*(F.when(reduce(lambda a, b: a & b, map(holds, sets)), F.lit(name)) for name, sets in questions.items()))
    each = totals.select("period", "n", F.explode(F.array_compact(told)).alias("combination"))
    return each.groupBy("period", "combination").agg(F.sum("n").alias("n"))


def standard_questions(groups: list[tuple], labels: list[str]) -> dict[str, list[set[int]]]:
    """All, each value of each dimension, each group, and for pairs of values of the first dimension any and both."""
    text = lambda v: "(none)" if v is None else v
    out = {"all": [set(range(len(groups)))]}
    for d, label in enumerate(labels):
        for v in dict.fromkeys(g[d] for g in groups):
            out[f"{label}={text(v)}"] = [{i for i, g in enumerate(groups) if g[d] == v}]
    for i, g in enumerate(groups):
        out["|".join(f"{label}={text(v)}" for label, v in zip(labels, g, strict=True))] = [{i}]
    first = [v for v in dict.fromkeys(g[0] for g in groups) if v is not None]
    own = {v: {i for i, g in enumerate(groups) if g[0] == v} for v in first}
    for i, a in enumerate(first):
        for b in first[i + 1 :]:
            out[f"any {a}+{b}"] = [own[a] | own[b]]
            out[f"both {a}+{b}"] = [own[a], own[b]]
    return out
