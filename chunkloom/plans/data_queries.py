"""Queries of the core's data operators (repeated messages, orphan references, uneven keys) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chunkloom.functions.keys import hex_key, hex_of_key, hex_text
from chunkloom.operators.dense_totals import dense_distinct, dense_totals
from chunkloom.operators.message_store import MessageStore, merge_in_waves, surplus
from chunkloom.operators.orphan_refs import block_width, compress_runs, range_orphans, state_orphans, state_runs
from chunkloom.session import materialize, shared_dir, table

#: Batches that the whole table of receipts is fed in.
WAVES = 3
#: Share of all rows from which a key counts as hot.
HOT_SHARE = 0.01


def _identifier():
    return [hex_text("server"), hex_text("client"), F.col("epoch"), hex_text("sig")]


def _received_day():
    return F.coalesce(F.datediff(F.col("received_at").cast("date"), F.lit("1970-01-01").cast("date")), F.lit(0))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "receipts")
    store = MessageStore(spark, shared_dir(spark, "receipt-ids"), "delivery_id")
    slim = rows.select("delivery_id", "server", "client", "epoch", "sig", "received_at")
    merge_in_waves(store, slim, _identifier(), _received_day(), WAVES, keep=["delivery_id"])
    return surplus(rows, store, _identifier())


def p2_unique_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "receipts")
    store = MessageStore(spark, shared_dir(spark, "receipts"), "delivery_id")
    merge_in_waves(store, rows, _identifier(), _received_day(), WAVES)
    kept = store.rows()
    return (rows.limit(0) if kept is None else kept).select(rows.columns)


def _micros(col: str):
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {col})")


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, entries = table(spark, sf_dir, "chunk_refs"), table(spark, sf_dir, "file_entries")
    log, base = table(spark, sf_dir, "chunk_index"), table(spark, sf_dir, "base_chunks")
    # base_chunks: Catalyst broadcasts it only below its size threshold
    asked = refs.select(hex_key("hash").alias("key"), _micros("recorded_at").alias("at"), "ref_id").join(
        base.select(hex_key("hash").alias("key")), "key", "left_anti"
    )
    lines = log.select(hex_key("hash").alias("key"), _micros("indexed_at").alias("at"), "line_id", (F.col("line_op") == "put").alias("put"))
    # the spelling of a hash doesn't matter for the width
    width = block_width((refs.select("hash", _micros("recorded_at").alias("at")), "hash", "at"), (log.select("hash", _micros("indexed_at").alias("at")), "hash", "at"))
    # runs are used twice in a match: as starts and as what earlier blocks carry over
    held = materialize(state_runs(lines, "key", "at", "line_id", F.coalesce("put", F.lit(False)), width), "held")
    of_chunks = state_orphans(asked, held, "key", "at", width)
    runs = materialize(compress_runs(refs.select(hex_key("root").alias("key"), "ordinal"), "key", "ordinal"), "runs")
    wanted = entries.select(hex_key("root").alias("key"), "chunk_start", "chunk_count", "entry_id", _micros("recorded_at").alias("at"))
    of_files = range_orphans(wanted, runs, "key", "chunk_start", "chunk_count")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("at") / 86_400_000_000).cast("int")).cast("string")
    return of_chunks.select(F.lit("chunk_refs").alias("ref_table"), F.col("ref_id").alias("row_id"), day.alias("ref_day")).unionByName(
        of_files.select(F.lit("file_entries").alias("ref_table"), F.col("entry_id").alias("row_id"), day.alias("ref_day"))
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir)


def p3_orphans_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).groupBy("ref_table", "ref_day").agg(F.count("*").alias("n_orphans"))


def _hot(spark: SparkSession, sf_dir: str, name: str, column: str) -> DataFrame:
    rows = table(spark, sf_dir, name)
    totals = dense_totals(rows.select(hex_key(column).alias("key")), "key")
    least = rows.count() * HOT_SHARE
    hot = totals.where(F.col("key").isNotNull() & (F.col("n") >= least))
    return hot.select(F.lit(name).alias("in_table"), hex_of_key("key").alias("hot_key"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hot(spark, sf_dir, "chunk_refs", "hash").unionByName(_hot(spark, sf_dir, "receipts", "server"))


def p5_server_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "receipts").select(hex_key("server").alias("key"), hex_key("client").alias("client"), "bytes")
    totals = dense_totals(rows, "key", "n_receipts", sums={"sum_bytes": "bytes"})
    clients = dense_distinct(rows, "key", "client", "n_clients")
    both = totals.join(clients.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k")), "left")
    return both.select(hex_of_key("key").alias("server"), "n_receipts", "sum_bytes", F.coalesce("n_clients", F.lit(0).cast("bigint")).alias("n_clients"))


def p5_hash_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "chunk_refs").select(hex_key("hash").alias("key"), hex_key("root").alias("root"), _micros("recorded_at").alias("at"))
    totals = dense_totals(rows, "key", "n_refs", least={"first_us": "at"}, most={"last_us": "at"})
    roots = dense_distinct(rows, "key", "root", "n_roots")
    both = totals.join(roots.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k")), "left")
    return both.select(hex_of_key("key").alias("hash"), "n_refs", F.coalesce("n_roots", F.lit(0).cast("bigint")).alias("n_roots"), "first_us", "last_us")


QUERIES = {f.__name__: f for f in (p2_found, p2_unique_receipts, p3_found, p3_orphans_per_day, p5_found, p5_server_totals, p5_hash_totals)}

_T = "lower(trim({0}, E' \\t\\r\\n'))"


def _t(c: str) -> str:
    return _T.format(c)


_KEY = f"{_t('server')}, {_t('client')}, epoch, {_t('sig')}"
_RANK = f"""SELECT *, CASE WHEN server IS NULL OR client IS NULL OR epoch IS NULL OR sig IS NULL THEN 1
  ELSE row_number() OVER (PARTITION BY {_KEY} ORDER BY delivery_id) END AS nr FROM receipts"""
_ORPHANS = f"""
WITH lines AS (SELECT {_t('hash')} AS h, indexed_at, line_op FROM chunk_index
    QUALIFY row_number() OVER (PARTITION BY {_t('hash')}, indexed_at ORDER BY line_id DESC) = 1),
refs AS (SELECT ref_id, {_t('hash')} AS h, recorded_at FROM chunk_refs
    WHERE hash IS NOT NULL AND {_t('hash')} NOT IN (SELECT {_t('hash')} FROM base_chunks)),
ords AS (SELECT DISTINCT {_t('root')} AS r, ordinal FROM chunk_refs),
runs AS (SELECT r, min(ordinal) AS a, max(ordinal) AS b FROM
    (SELECT r, ordinal, ordinal - row_number() OVER (PARTITION BY r ORDER BY ordinal) AS g FROM ords) GROUP BY r, g),
files AS (SELECT entry_id, {_t('root')} AS r, chunk_start, chunk_count, recorded_at FROM file_entries WHERE chunk_start IS NOT NULL AND chunk_count > 0)
SELECT 'chunk_refs' AS ref_table, ref_id AS row_id, strftime(recorded_at, '%Y-%m-%d') AS ref_day
FROM refs ASOF LEFT JOIN lines ON refs.h = lines.h AND refs.recorded_at >= lines.indexed_at
WHERE lines.line_op IS NULL OR lines.line_op <> 'put'
UNION ALL
SELECT 'file_entries', entry_id, strftime(recorded_at, '%Y-%m-%d') FROM files f
WHERE NOT EXISTS (SELECT 1 FROM runs WHERE runs.r = f.r AND a <= chunk_start AND b >= chunk_start + chunk_count - 1)"""

SQL = {
    "p2_found": f"SELECT delivery_id FROM ({_RANK}) WHERE nr > 1",
    "p2_unique_receipts": f"SELECT * EXCLUDE (nr) FROM ({_RANK}) WHERE nr = 1",
    "p3_found": _ORPHANS,
    "p3_orphans_per_day": f"SELECT ref_table, ref_day, count(*) AS n_orphans FROM ({_ORPHANS}) GROUP BY ref_table, ref_day",
    "p5_found": f"""SELECT 'chunk_refs' AS in_table, {_t('hash')} AS hot_key FROM chunk_refs WHERE hash IS NOT NULL GROUP BY 2 HAVING count(*) >= 0.01 * (SELECT count(*) FROM chunk_refs)
UNION ALL SELECT 'receipts', {_t('server')} FROM receipts WHERE server IS NOT NULL GROUP BY 2 HAVING count(*) >= 0.01 * (SELECT count(*) FROM receipts)""",
    "p5_server_totals": f"""SELECT {_t('server')} AS server, count(*) AS n_receipts, CAST(sum(bytes) AS BIGINT) AS sum_bytes, count(DISTINCT {_t('client')}) AS n_clients FROM receipts GROUP BY 1""",
    "p5_hash_totals": f"""SELECT {_t('hash')} AS hash, count(*) AS n_refs, count(DISTINCT {_t('root')}) AS n_roots, min(epoch_us(recorded_at)) AS first_us, max(epoch_us(recorded_at)) AS last_us FROM chunk_refs GROUP BY 1""",
}
