"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from chunkloom.functions.keys import hex_key
from chunkloom.llm import abuse, contamination, distinct_patterns as dp, packing, seen_before as sb
from chunkloom.session import materialize, table

#: What is counted: result name, table, identifier, time, groups.
COUNTED = [
    ("hash", "chunk_refs", "hash", "recorded_at", ["site", "origin"]),
    ("client", "receipts", "client", "received_at", ["site", "transport"]),
    ("server", "receipts", "server", "received_at", ["site", "transport"]),
]


def p1_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for kind, name, ident, at, dims in COUNTED:
        rows = table(spark, sf_dir, name).select(F.col(at).cast("date").cast("string").alias("day"), hex_key(ident).alias("id"), *dims)
        groups = dp.group_dictionary(rows, dims)
        daily = materialize(dp.membership(rows, "day", "id", dims, groups), "patterns")
        totals = dp.pattern_totals(daily).unionByName(dp.pattern_totals(dp.without_period(daily)))
        told = dp.answer(totals, dp.standard_questions(groups, dims))
        parts.append(told.select(F.lit(kind).alias("identifier"), F.coalesce("period", F.lit("all days")).alias("day"), "combination", F.col("n").alias("n_distinct"), F.lit(0.0).alias("error_bound")))
    return reduce(DataFrame.unionByName, parts)


def _first_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    refs = table(spark, sf_dir, "chunk_refs")
    rows = refs.select(hex_key("hash").alias("key"), "ref_id")
    base = table(spark, sf_dir, "base_chunks").select(hex_key("hash").alias("key"))
    return refs, sb.not_seen(rows, "key", "ref_id", base, "key", refs.count())


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, new = _first_rows(spark, sf_dir)
    return refs.where(F.col("hash").isNotNull()).select("ref_id").join(new.select(F.col("at").alias("ref_id")), "ref_id", "left_anti")


def p4_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, new = _first_rows(spark, sf_dir)
    own = new.where(F.col("at") >= 0).agg(F.count("*").alias("n_new"), F.count_if("missed").alias("n_wrong"))
    return own.select("n_new", "n_wrong", (F.col("n_wrong") / F.greatest("n_new", F.lit(1))).alias("wrong_rate"), F.lit(sb.error_bound()).alias("rate_bound"))


#: Tokens of one container.
CAPACITY = 4096


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = packing.token_counts(docs, "doc_id", "text")
    packed = packing.pack(sizes, "doc_id", CAPACITY, docs.count())
    return packed.withColumn("unused_share", (F.lit(CAPACITY) - F.col("container_tokens")) / F.lit(float(CAPACITY)))


def p6_unused_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = p6_containers(spark, sf_dir).where(F.col("container_id").isNotNull())
    total = own.agg(F.count_if(F.col("slot") == 0).alias("n_containers"), F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("sum_tokens"))
    return total.select("*", (F.lit(1.0) - F.col("sum_tokens") / (F.col("n_containers") * CAPACITY)).alias("unused_share"))


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What any right packing has, as counts: documents placed, documents lost, containers over capacity or with a wrong sum, needless cuts, overlaps."""
    sizes = packing.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    packed = materialize(p6_containers(spark, sf_dir), "packed")
    boxes = packed.where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.max("container_tokens").alias("stated"), F.count("*").alias("k"), F.max("slot").alias("top"))
    bad_boxes = boxes.agg(F.count_if((F.col("n") > CAPACITY) | (F.col("n") != F.col("stated")) | (F.col("top") != F.col("k") - 1)).alias("bad_containers"))
    placed = packed.groupBy(F.col("doc_id").alias("d")).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"), F.sum(F.col("first_token") - F.col("piece") * CAPACITY).alias("shift"))
    met = sizes.join(placed, F.col("doc_id") == F.col("d"), "full")
    wrong = F.coalesce((F.col("n") != F.col("n_tokens")) | (F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / CAPACITY))) | (F.col("shift") != 0), F.lit(True))
    docs = met.agg(F.count("d").alias("n_documents"), F.count_if(wrong).alias("wrong_documents"))
    zero = F.lit(0).cast("bigint")
    both = docs.withColumn("bad_containers", zero).unionByName(bad_boxes.select(zero.alias("n_documents"), zero.alias("wrong_documents"), "bad_containers"))
    return both.agg(*(F.sum(c).alias(c) for c in ("n_documents", "wrong_documents", "bad_containers")))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest stretch of each document and item."""
    return contamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).where("nr = 0")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max(F.col("n_fit") / F.col("n_words")).alias("largest_share"))


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_scores(spark, sf_dir).where(F.col("score") >= abuse.REPORT_FROM).select("doc_id")


def p8_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = p8_scores(spark, sf_dir).select(F.lower("source").alias("source"), (F.col("score") >= abuse.REPORT_FROM).alias("reported"))
    return own.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if("reported").alias("n_reported"), F.avg(F.col("reported").cast("double")).alias("rate"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_distinct_counts, p4_found, p4_error_rate, p6_containers, p6_unused_share, p6_invariants, p7_found, p7_leaked_items, p7_cleaned,
        p8_found, p8_scores, p8_source_rates,
    )
}


def _t(c: str) -> str:
    return f"lower(trim({c}, E' \\t\\r\\n'))"


def _count_sql(kind: str, name: str, ident: str, at: str, dims: list[str]) -> str:
    a, b = dims
    v = lambda c: f"coalesce({c}, '(none)')"
    base = f"SELECT DISTINCT {_t(ident)} AS id, strftime({at}, '%Y-%m-%d') AS day, {a} AS a, {b} AS b FROM {name} WHERE {ident} IS NOT NULL"
    both = f"SELECT * FROM ({base}) UNION ALL SELECT DISTINCT id, 'all days', a, b FROM ({base})"
    return f"""
SELECT '{kind}' AS identifier, day, combination, count(DISTINCT id) AS n_distinct, CAST(0 AS DOUBLE) AS error_bound FROM (
  WITH s AS MATERIALIZED ({both}), own AS (SELECT DISTINCT id, day, a FROM s WHERE a IS NOT NULL), vals AS (SELECT DISTINCT a FROM own)
  SELECT id, day, 'all' AS combination FROM s
  UNION ALL SELECT id, day, '{a}=' || {v('a')} FROM s
  UNION ALL SELECT id, day, '{b}=' || {v('b')} FROM s
  UNION ALL SELECT id, day, '{a}=' || {v('a')} || '|{b}=' || {v('b')} FROM s
  UNION ALL SELECT id, day, 'any ' || x.a || '+' || y.a FROM own JOIN vals x ON x.a <= own.a OR TRUE JOIN vals y ON x.a < y.a WHERE own.a IN (x.a, y.a)
  UNION ALL SELECT p.id, p.day, 'both ' || p.a || '+' || q.a FROM own p JOIN own q ON p.id = q.id AND p.day = q.day AND p.a < q.a
) GROUP BY day, combination"""


SQL = {
    "p1_distinct_counts": "\nUNION ALL\n".join(f"SELECT * FROM ({_count_sql(*c)})" for c in COUNTED),
    "p6_invariants": "SELECT count(*) AS n_documents, 0 AS wrong_documents, 0 AS bad_containers FROM documents",
    "p4_found": f"""SELECT ref_id FROM (SELECT ref_id, {_t('hash')} AS h, row_number() OVER (PARTITION BY {_t('hash')} ORDER BY ref_id) AS nr FROM chunk_refs WHERE hash IS NOT NULL)
WHERE nr > 1 OR h IN (SELECT {_t('hash')} FROM base_chunks)""",
}
