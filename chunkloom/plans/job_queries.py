"""Queries of whole jobs over files and saved tables, and their SQL.

Files and tables are written to the shared folder first and read back through the
sources, so each query shows a sink and its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chunkloom.api import Store
from chunkloom.functions import digest as dg
from chunkloom.functions.keys import hex_text
from chunkloom.operators import chunking as ck, fec, manifest as mf, protocol as pr, reputation as rp, scenarios as sc
from chunkloom.plans.store_queries import AVERAGE, LEAST, MOST, _DOCS, _SHA_EMPTY, _WHOLE, _docs, _levels, _t, cdc_sql
from chunkloom.plans.swarm_queries import _events, _receipts
from chunkloom.plans.swarm_sql import _LEDGER, _R
from chunkloom.session import shared_dir, table
from chunkloom.sources.files import append_index, read_index, scan_tree
from chunkloom.sources.state import load_state, save_part, save_state
from chunkloom.sources.streams import write_files

SIZES = (LEAST, AVERAGE, MOST)


def _folder_of_docs(spark: SparkSession, sf_dir: str) -> str:
    """The documents as files below a shared folder, in a few subfolders."""
    folder = shared_dir(spark, "docs")
    path = F.concat(F.lit("d"), F.pmod("doc_id", F.lit(7)).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    write_files(_docs(spark, sf_dir).select(path.alias("path"), F.lit(0).alias("ordinal"), "data"), folder)
    return folder


def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, packed into a store in streams, exported from it and read again."""
    store = Store(spark, shared_dir(spark, "store"), SIZES)
    root = store.pack(_folder_of_docs(spark, sf_dir), "docs")
    out = shared_dir(spark, "exported")
    store.export(root, out)
    return scan_tree(spark, out).select("path", "size", F.sha2("data", 256).alias("hash"))


def no_copy_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed without copying: every chunk read from its source file and checked."""
    store = Store(spark, shared_dir(spark, "store"), SIZES)
    store.pack(_folder_of_docs(spark, sf_dir), copy=False)
    got = store.read(store.table("refs"))
    return got.select(dg.hash_text("hash").alias("hash"), F.length("bytes").cast("bigint").alias("length"), "error")


def single_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as content of one file: size, chunks and root."""
    docs = _docs(spark, sf_dir).select("doc_id", F.col("doc_id").alias("tree"), "data")
    laid, refs = mf.tree_layout(docs.select("tree", "doc_id"), ck.content_chunks(docs, "doc_id", "data", *SIZES), "tree", "doc_id", "doc_id")
    # no document has more chunks than the longest has bytes in chunks of the least size
    longest = docs.agg(F.max(F.length("data"))).first()[0] or 0
    roots = mf.content_ids(refs, "tree", max(1, -(-longest // LEAST))).select(F.col("tree").alias("t"), dg.hash_text("root").alias("root"))
    met = laid.join(roots, F.col("tree") == F.col("t"), "left")
    return met.select("doc_id", "size", F.col("chunk_count").alias("n_chunks"), F.coalesce("root", dg.hash_text(dg.empty_root())).alias("root"))


def container_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of each document as container bytes and back; every fifth torn, every seventh with another header."""
    docs = _docs(spark, sf_dir)
    cut = ck.content_chunks(docs, "doc_id", "data", *SIZES)
    own = cut.groupBy(F.col("doc_id").alias("d")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "file_offset", "length", "hash"))).alias("cs"))
    met = docs.join(own, F.col("doc_id") == F.col("d"), "left").select("doc_id", "tree", F.length("data").cast("bigint").alias("size"), "cs")

    def run(batches):
        import hashlib

        import pyarrow as pa

        for b in batches:
            out = []
            for m in b.to_pylist():
                chunks = [(c["hash"], c["file_offset"], c["length"]) for c in m["cs"] or []]
                raw = mf.encode_manifest({"root": hashlib.sha256(m["tree"].encode()).digest(), "total_size": m["size"], "name": m["tree"], "chunks": chunks, "files": [(f"{m['doc_id']}.txt", m["size"], 0, len(chunks))]})
                out.append(raw[:-1] if m["doc_id"] % 5 == 0 else b"XX" + raw[2:] if m["doc_id"] % 7 == 0 else raw)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "content"])

    back = mf.decode_containers(met.mapInArrow(run, "doc_id bigint, content binary"), "doc_id", "content")
    return back.select("doc_id", "name", "total_size", F.lower(F.hex("root")).alias("root"), F.size("chunks").cast("bigint").alias("n_chunks"), F.col("files")[0]["path"].alias("path"), "error")


def index_append_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of every hash appended to an index, then the last ones of some, read as an index: what came later wins."""
    log = table(spark, sf_dir, "chunk_index").select("line_id", dg.hash_from_text(hex_text("hash")).alias("hash"), "pack_id", "pack_offset", F.col("chunk_length").alias("length")).dropna()
    ends = log.groupBy("hash").agg(*(f(F.struct("pack_id", "pack_offset", "length"), "line_id").alias(n) for n, f in (("first", F.min_by), ("last", F.max_by))))
    path = shared_dir(spark, "index") + "/lines"
    append_index(ends.select("hash", "first.*"), path)
    append_index(ends.where(F.lower(F.hex("hash")) < "8").select("hash", "last.*"), path)
    return read_index(spark, path)


def ledger_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger saved, saved again, and read back."""
    book, folder = rp.ledger(_events(spark, sf_dir)), shared_dir(spark, "ledger") + "/book"
    save_state(book.limit(0), folder)
    save_state(book, folder)
    return load_state(spark, folder, "peer string, served_to_us bigint, we_served bigint, credited_by_receipts bigint")


def bag_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The receipts that each server keeps, saved in a whole and a part, listed again."""
    bag = rp.receipt_bag(_receipts(spark, sf_dir).where("server IS NOT NULL AND client IS NOT NULL AND epoch IS NOT NULL AND sig IS NOT NULL"), "server", ["server", "client", "epoch", "sig"], "bytes", "delivery_id")
    folder = shared_dir(spark, "bag") + "/receipts"
    slim = bag.select("server", "rank", "delivery_id")
    save_state(slim.where("rank <= 10"), folder)
    save_part(slim.where("rank > 10"), folder)
    return load_state(spark, folder, "server string, rank int, delivery_id bigint")


def request_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of about the largest length allowed, a byte more for each region."""
    head, tail = '{"id":3,"cmd":"status","x":"', '"}'
    n = F.lit(pr.LINE_LIMIT - len(head) - len(tail) - 2) + F.col("r_regionkey")
    lines = table(spark, sf_dir, "region").withColumn("n", n.cast("int")).select("r_regionkey", F.concat(F.lit(head), F.expr("repeat('y', n)"), F.lit(tail)).alias("line"))
    return pr.parse_requests(lines, "line").select("r_regionkey", F.length("line").cast("bigint").alias("n_bytes"), F.col("id").cast("string").alias("id"), "cmd", "error")


def generator_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 12 bytes of the generator for the seed of each region."""
    made = F.udf(lambda k: sc.sample_bytes(12, k).hex(), "string", useArrow=True)
    return table(spark, sf_dir, "region").select("r_regionkey", made("r_regionkey").alias("bytes"))


def symbols_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols made for odd documents first, then for all: only those of even ones are new."""
    docs = _docs(spark, sf_dir)
    cache = fec.SymbolCache(spark, shared_dir(spark, "symbols") + "/table", "doc_id", repair=2)
    cache.symbols(docs.where("doc_id % 2 = 1"), "data")
    return cache.symbols(docs, "data").groupBy("doc_id").agg(F.count("*").alias("n_symbols"), F.count_distinct("esi").alias("n_numbers"))


QUERIES = {
    f.__name__: f
    for f in (store_roundtrip, no_copy_read, single_manifests, container_roundtrip, index_append_read, ledger_saved, bag_saved, request_limit, generator_bytes, symbols_cached)
}

_CHUNKS = f"SELECT doc_id, count(*) AS n_chunks FROM ({cdc_sql(_WHOLE)}) GROUP BY doc_id"
_GOOD = f"SELECT line_id, {_t('hash')} AS hash, pack_id, pack_offset, chunk_length AS length FROM chunk_index WHERE regexp_full_match({_t('hash')}, '[0-9a-f]{{64}}') AND pack_id IS NOT NULL AND pack_offset IS NOT NULL AND chunk_length IS NOT NULL"

SQL = {
    "store_roundtrip": f"SELECT 'd' || doc_id % 7 || '/' || doc_id || '.txt' AS path, strlen(txt) AS size, sha256(txt) AS hash FROM ({_DOCS})",
    "no_copy_read": f"SELECT DISTINCT hash, length, CAST(NULL AS VARCHAR) AS error FROM ({cdc_sql(_WHOLE)})",
    "single_manifests": f"""WITH RECURSIVE ch AS MATERIALIZED ({cdc_sql(_WHOLE)}), {_levels("SELECT doc_id AS tree, ordinal AS idx, hash AS h FROM ch")}
SELECT d.doc_id, strlen(txt) AS size, coalesce(n_chunks, 0) AS n_chunks, coalesce(l[1], {_SHA_EMPTY}) AS root FROM ({_DOCS}) d
LEFT JOIN (SELECT doc_id, count(*) AS n_chunks FROM ch GROUP BY doc_id) c ON c.doc_id = d.doc_id LEFT JOIN (SELECT tree, l FROM lists WHERE len(l) = 1) r ON r.tree = d.doc_id""",
    "container_roundtrip": f"""SELECT d.doc_id, CASE WHEN ok THEN tree END AS name, CASE WHEN ok THEN strlen(txt) END AS total_size, CASE WHEN ok THEN sha256(tree) END AS root,
CASE WHEN ok THEN coalesce(n_chunks, 0) END AS n_chunks, CASE WHEN ok THEN d.doc_id || '.txt' END AS path, CASE WHEN d.doc_id % 5 = 0 THEN 'Truncated' WHEN d.doc_id % 7 = 0 THEN 'BadMagic' END AS error
FROM (SELECT *, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS ok FROM ({_DOCS})) d LEFT JOIN ({_CHUNKS}) c ON c.doc_id = d.doc_id""",
    "index_append_read": f"""SELECT hash, CASE WHEN hash < '8' THEN l.pack_id ELSE f.pack_id END AS pack_id, CASE WHEN hash < '8' THEN l.pack_offset ELSE f.pack_offset END AS pack_offset, CASE WHEN hash < '8' THEN l.length ELSE f.length END AS length
FROM (SELECT hash, arg_min(struct_pack(pack_id, pack_offset, length), line_id) AS f, arg_max(struct_pack(pack_id, pack_offset, length), line_id) AS l FROM ({_GOOD}) GROUP BY hash)""",
    "ledger_saved": f"SELECT * FROM {_LEDGER}",
    "bag_saved": f"""SELECT server, rank, delivery_id FROM (SELECT server, delivery_id, row_number() OVER (PARTITION BY server ORDER BY bytes DESC NULLS LAST, delivery_id) AS rank FROM
(SELECT * FROM {_R} WHERE server IS NOT NULL AND client IS NOT NULL AND epoch IS NOT NULL AND sig IS NOT NULL QUALIFY row_number() OVER (PARTITION BY server, client, epoch, sig ORDER BY delivery_id) = 1)) WHERE rank <= 50""",
    "request_limit": f"""SELECT r_regionkey, {pr.LINE_LIMIT} - 2 + r_regionkey AS n_bytes, CASE WHEN r_regionkey > 2 THEN '0' ELSE '3' END AS id, CASE WHEN r_regionkey <= 2 THEN 'status' END AS cmd, CASE WHEN r_regionkey > 2 THEN 'TooLong' END AS error FROM region""",
    "generator_bytes": f"""WITH RECURSIVE m AS (SELECT CAST(18446744073709551615 AS HUGEINT) AS low64),
s AS (SELECT r_regionkey, 0 AS i, xor(CAST({sc.SEED_START} AS HUGEINT), (CAST(r_regionkey AS HUGEINT) * CAST({sc.SEED_STEP} AS HUGEINT)) & low64) AS x FROM region, m
  UNION ALL SELECT r_regionkey, i + 1, xor(c, c >> 27) FROM (SELECT r_regionkey, i, xor(b, (b & CAST({(1 << 39) - 1} AS HUGEINT)) << 25) AS c FROM (SELECT r_regionkey, i, xor(x, x >> 12) AS b FROM s WHERE i < 12)))
SELECT r_regionkey, string_agg(printf('%02x', CAST((((((x >> 32) * {sc.MULTIPLIER}) & 4294967295) << 32) + (x & 4294967295) * {sc.MULTIPLIER} >> 33) & 255 AS INT)), '' ORDER BY i) AS bytes FROM s WHERE i > 0 GROUP BY r_regionkey""",
    "symbols_cached": f"SELECT doc_id, CAST(ceil(strlen(txt) / 1200.0) AS BIGINT) + 2 AS n_symbols, CAST(ceil(strlen(txt) / 1200.0) AS BIGINT) + 2 AS n_numbers FROM ({_DOCS}) WHERE txt <> ''",
}
