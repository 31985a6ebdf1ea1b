"""Queries of hashing, hash trees, chunking, manifests and the store, and their SQL.

Trees of files: the documents of a source, in order of ``doc_id``. Manifests and
stores: the tables ``manifests``, ``file_entries``, ``chunk_refs``, ``chunk_index``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chunkloom.functions import digest as dg
from chunkloom.functions.keys import hex_key, hex_text
from chunkloom.operators import chunking as ck, manifest as mf, merkle as mk, store as st
from chunkloom.operators.prefix import dense_index, running_total
from chunkloom.session import materialize, shared_dir, table
from chunkloom.sources.streams import read_slices, write_files

#: Chunk sizes that suit documents of some kilobytes; bytes of a piece; bytes after which a pack is closed.
LEAST, AVERAGE, MOST = 256, 1024, 4096
PIECE, PACK = 16_384, 4 << 20


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.coalesce("source", F.lit("(none)")).alias("tree"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "tree", dg.content_hash("data").alias("h"))
    return dense_index(docs, "tree", "doc_id")


def _most(spark: SparkSession, sf_dir: str) -> int:
    """No tree of documents has more leaves than there are documents: a count from file footers."""
    return table(spark, sf_dir, "documents").count()


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = dg.content_hash("data")
    return _docs(spark, sf_dir).select("doc_id", dg.hash_text(h).alias("hash"), dg.short_form(h).alias("short_form"))


def hex_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = dg.hash_from_text(hex_text("hash"))
    return table(spark, sf_dir, "chunk_refs").select("ref_id", dg.hash_text(raw).alias("hash"), F.length(raw).alias("n_bytes"), (F.col("hash").isNotNull() & raw.isNull()).alias("damaged"))


def node_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = dg.content_hash("data")
    leaf = dg.leaf_node(h)
    return _docs(spark, sf_dir).select("doc_id", dg.hash_text(leaf).alias("leaf"), dg.hash_text(dg.inner_node(leaf, h)).alias("node"))


def merkle_root_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mk.merkle_roots(_leaves(spark, sf_dir), "tree", "idx", "h", _most(spark, sf_dir)).select("tree", dg.hash_text("root").alias("root"))


def merkle_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = mk.merkle_nodes(_leaves(spark, sf_dir), "tree", "idx", "h", _most(spark, sf_dir))
    return nodes.select("tree", "level", "i", dg.hash_text("h").alias("h"))


def merkle_proof_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = _leaves(spark, sf_dir)
    proofs = mk.merkle_proofs(mk.merkle_nodes(leaves, "tree", "idx", "h", _most(spark, sf_dir)), "tree", leaves, "idx")
    steps = proofs.select("tree", "idx", F.posexplode("steps").alias("step_no", "s"))
    return steps.select("tree", "idx", "step_no", "s.sibling_on_left", dg.hash_text("s.hash").alias("hash"))


def merkle_verify_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = _leaves(spark, sf_dir)
    proofs = mk.merkle_proofs(mk.merkle_nodes(leaves, "tree", "idx", "h", _most(spark, sf_dir)), "tree", leaves, "idx").withColumnsRenamed({"tree": "t", "idx": "i"})
    roots = mk.merkle_roots(leaves, "tree", "idx", "h", _most(spark, sf_dir)).withColumnRenamed("tree", "rt")
    met = leaves.join(proofs, (F.col("tree") == F.col("t")) & (F.col("idx") == F.col("i"))).join(roots, F.col("tree") == F.col("rt"))
    return met.select("doc_id", mk.proof_holds("h", "steps", "root").alias("holds"), mk.proof_holds(dg.leaf_node("h"), "steps", "root").alias("forged_holds"))


def cdc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = ck.content_chunks(_docs(spark, sf_dir), "doc_id", "data", LEAST, AVERAGE, MOST)
    return cut.select("doc_id", "ordinal", "file_offset", "length", dg.hash_text("hash").alias("hash"))


def cdc_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    cut = ck.content_chunks(docs, "doc_id", "data", LEAST, AVERAGE, MOST, with_bytes=True)
    # a document is a bounded row, and so are its chunks put together again
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.hex("bytes").alias("hx")))), lambda x: x["hx"]), "")
    again = cut.groupBy("doc_id").agg(F.sum("length").alias("n_bytes"), F.max("length").alias("m"), F.sha2(F.unhex(parts), 256).alias("hash"))
    return again.select("doc_id", "n_bytes", "hash", (F.col("m") <= MOST).alias("in_bounds"))


def fixed_pieces_sha1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = ck.fixed_pieces(_docs(spark, sf_dir), "tree", "doc_id", F.col("data"), PIECE)
    return pieces.select("tree", "piece", "length", F.sha1("bytes").alias("sha1"))


def piece_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every tree against those of the trees as they'd be without error pages (status 404)."""
    docs = _docs(spark, sf_dir)
    ok = table(spark, sf_dir, "documents").where(F.coalesce(F.col("http_status") != 404, F.lit(True))).select("doc_id")
    want = ck.fixed_pieces(docs.join(ok, "doc_id", "left_semi"), "tree", "doc_id", F.col("data"), PIECE)
    return ck.verify_pieces(ck.fixed_pieces(docs, "tree", "doc_id", F.col("data"), PIECE), want.select("tree", "piece", F.sha1("bytes").alias("sha1")), "tree")


def manifest_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and chunk ranges of every source's tree, with the content id, from content-defined chunks."""
    docs = _docs(spark, sf_dir)
    files, chunks = mf.tree_layout(docs.select("tree", "doc_id"), ck.content_chunks(docs, "doc_id", "data", LEAST, AVERAGE, MOST), "tree", "doc_id", "doc_id")
    roots = mf.content_ids(chunks, "tree").select(F.col("tree").alias("t"), dg.hash_text("root").alias("root"))
    empty = dg.hash_text(dg.empty_root())
    return files.join(roots, F.col("tree") == F.col("t"), "left").select("tree", "doc_id", "size", "base", "chunk_start", "chunk_count", F.coalesce("root", empty).alias("root"))


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout of trees whose files are single chunks: sizes, offsets and ordinals of every file."""
    docs = _docs(spark, sf_dir)
    chunks = docs.where(F.length("data") > 0).select(
        "doc_id", F.lit(0).cast("bigint").alias("ordinal"), F.lit(0).cast("bigint").alias("file_offset"), F.length("data").cast("bigint").alias("length"), dg.content_hash("data").alias("hash")
    )
    files, _ = mf.tree_layout(docs.select("tree", "doc_id"), chunks, "tree", "doc_id", "doc_id")
    return files.select("tree", "doc_id", "size", "base", "chunk_start", "chunk_count")


def _arrived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk rows of manifests, the first that arrived of each (root, ordinal)."""
    refs = table(spark, sf_dir, "chunk_refs")
    first = refs.groupBy(hex_text("root").alias("root"), "ordinal").agg(F.min("ref_id").alias("ref_id")).select("ref_id")
    return refs.join(first, "ref_id", "left_semi").select("ref_id", hex_text("root").alias("root"), "ordinal", hex_text("hash").alias("hash"), "chunk_offset", "chunk_length", "site", "origin")


def _registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests, the first registration of each root."""
    m = table(spark, sf_dir, "manifests")
    first = m.groupBy(hex_text("root").alias("r")).agg(F.min("manifest_id").alias("manifest_id")).select("manifest_id")
    return m.join(first, "manifest_id", "left_semi").withColumn("root", hex_text("root"))


def root_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded roots of registered manifests; damaged and null hashes count as the hash of their text."""
    leaves = _arrived(spark, sf_dir).select("root", "ordinal", F.coalesce(dg.hash_from_text("hash"), dg.content_hash(F.coalesce("hash", F.lit("")))).alias("h"))
    placed = dense_index(leaves, "root", "ordinal")
    stated = _registered(spark, sf_dir).select("root", dg.hash_from_text("root").alias("stated"))
    out = mf.consistent(stated, placed.select(F.col("root"), F.col("idx").alias("ordinal"), F.col("h").alias("hash")), "root", "stated", table(spark, sf_dir, "chunk_refs").count())
    return out.select("root", dg.hash_text("folded").alias("folded"), "is_consistent")


def manifest_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "manifests").select(F.col("manifest_id").alias("row_id"), mf.address("root").alias("uri"))
    urls = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("url").alias("uri"))
    bad = table(spark, sf_dir, "chunk_refs").select(F.col("ref_id").alias("row_id"), mf.address("hash").alias("uri"))
    every = m.unionByName(urls).unionByName(bad)
    root, error = mf.parsed_address("uri")
    return every.select("row_id", "uri", root.alias("root"), error.alias("error"))


def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether stated chunk offsets are the running sums of the lengths (null lengths count as 0)."""
    placed = running_total(_arrived(spark, sf_dir), "root", "ordinal", F.col("chunk_length"), "base")
    return placed.select("ref_id", "base", (F.col("base") == F.col("chunk_offset")).alias("fits"))


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "chunk_index").select(hex_key("hash").alias("key"), "line_id", "line_op", "indexed_at", "pack_id", "pack_offset", "chunk_length")
    return st.current_index(log, "key", ["indexed_at", "line_id"])


def reconstruct_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _arrived(spark, sf_dir).select("root", "ordinal", F.col("chunk_length").alias("length"), hex_key("hash").alias("key"))
    base = table(spark, sf_dir, "base_chunks").select(hex_key("hash").alias("key"))
    sizes = _registered(spark, sf_dir).select("root", F.col("total_size").alias("size"))
    return mf.rebuild_status(chunks, _held(spark, sf_dir).select("key").unionByName(base), "root", "key", sizes)


def split_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's joined stream (pieces of 16 KiB put in order would be its bytes) cut back into documents by stated sizes.

    Here one stream per document: its text, to be split into the stated ``n_chars``.
    """
    d = table(spark, sf_dir, "documents")
    files = d.select("doc_id", F.lit(0).cast("bigint").alias("ord"), F.col("n_chars").alias("size"))
    streams = d.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("stream"))
    out = mf.split_stream(files, streams, "doc_id", "ord")
    return out.select("doc_id", F.length("bytes").cast("bigint").alias("n_bytes"), "error")


def info_top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "file_entries").select("entry_id", hex_text("root").alias("root"), "file_path", "file_size")
    return mf.first_files(e, "root", "entry_id")


def tree_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mf.tree_shape(table(spark, sf_dir, "file_entries").select(hex_text("root").alias("root"), "file_path"), "root", "file_path")


def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "file_entries").select("entry_id", mf.unsafe_path("file_path").alias("is_unsafe"))


def store_has(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "chunk_refs").select("ref_id", hex_key("hash").alias("key"))
    base = table(spark, sf_dir, "base_chunks").select(hex_key("hash").alias("key"))
    return st.membership(refs, _held(spark, sf_dir).select("key").unionByName(base), "key").select("ref_id", "has")


def store_put_is_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "chunk_refs").where(F.col("hash").isNotNull()).select("ref_id", hex_key("hash").alias("key"))
    base = table(spark, sf_dir, "base_chunks").select(hex_key("hash").alias("key"))
    return st.put(refs, base, "key", "ref_id").select("ref_id", "is_new")


def store_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each referenced chunk would be read from, by priority of its kinds."""
    refs = table(spark, sf_dir, "chunk_refs").select("ref_id", hex_key("hash").alias("key"))
    packed = _held(spark, sf_dir).select("key", F.lit("packed").alias("kind"), "pack_id", "pack_offset")
    legacy = table(spark, sf_dir, "base_chunks").select(hex_key("hash").alias("key"), F.lit("legacy").alias("kind"), "pack_id", F.lit(None).cast("bigint").alias("pack_offset"))
    return st.locate(refs, packed.unionByName(legacy), "key").select("ref_id", "kind", "pack_id", "pack_offset")


def object_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = _held(spark, sf_dir).select("key", F.lit("packed").alias("kind"))
    legacy = table(spark, sf_dir, "base_chunks").select(hex_key("hash").alias("key"), F.lit("legacy").alias("kind"))
    noted = table(spark, sf_dir, "chunk_refs").where(F.col("origin") == "path").select(hex_key("hash").alias("key"), F.lit("ref").alias("kind"))
    return st.object_count(packed.unionByName(legacy).unionByName(noted), "key", "kind")


def dedup_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "chunk_refs").where(F.col("hash").isNotNull()).select(F.col("site"), hex_key("hash").alias("key"), "chunk_length")
    return st.dedup_ratio(refs, "site", "key", "chunk_length")


def ingest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _arrived(spark, sf_dir)
    return st.progress(refs.select("ref_id", "root", "ordinal", F.coalesce("chunk_length", F.lit(0).cast("bigint")).alias("length"), hex_key("hash").alias("key")), "root", "ordinal", "length", "key", "ref_id")


def refs_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index lines as text, with what the log has of damage, parsed again; the last line of a hash wins."""
    log = table(spark, sf_dir, "chunk_index")
    lines = log.select("line_id", F.concat_ws("\t", "hash", F.coalesce(F.col("pack_id").cast("string"), F.lit("?")), F.coalesce(F.col("pack_offset").cast("string"), F.lit("-")), F.col("chunk_length").cast("string")).alias("line"))
    return st.parse_index_lines(lines, "line", "line_id")


def reference_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of referenced chunks as text, with damage and paths that hold tabs, parsed again; the last line of a hash wins."""
    r = table(spark, sf_dir, "chunk_refs")
    path = F.concat(F.lit("/srv/"), F.coalesce("site", F.lit("?")), F.when(F.col("ref_id") % 3 == 0, "\tb").otherwise("/b"))
    fields = F.concat_ws("\t", "hash", F.coalesce(F.col("chunk_offset").cast("string"), F.lit("-")), F.coalesce(F.col("chunk_length").cast("string"), F.lit("?")))
    line = F.when(F.col("ref_id") % 7 == 0, fields).otherwise(F.concat_ws("\t", fields, path))
    return st.parse_reference_lines(r.where(F.col("hash").isNotNull()).select("ref_id", line.alias("line")), "line", "ref_id")


def pack_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts put into pack files, read back by place and checked; places of hashes that end in 7 are a byte off."""
    docs = _docs(spark, sf_dir).where(F.length("data") > 0)
    new = docs.groupBy(dg.content_hash("data").alias("hash")).agg(F.min("doc_id").alias("doc_id"))
    texts = docs.join(new, "doc_id").select("hash", "data", F.pmod("doc_id", F.lit(8)).alias("writer"), "doc_id", F.length("data").cast("bigint").alias("length"))
    placed = materialize(st.pack_placement(texts.select("writer", "doc_id", "length"), "writer", "doc_id", "length", PACK), "placed")
    name = F.concat("w", F.lit("-"), "p", F.lit(".pack"))
    parts = placed.select(F.col("writer").alias("w"), F.col("doc_id").alias("d"), F.col("pack_no").alias("p"), F.col("pack_offset").alias("at"), F.col("length").alias("n"))
    folder = shared_dir(spark, "packs")
    write_files(parts.join(texts, F.col("d") == F.col("doc_id")).select(name.alias("path"), F.col("at").alias("ordinal"), "data"), folder)
    off = F.when(F.lower(F.hex("hash")).endswith("7"), 1).otherwise(0)
    index = parts.join(texts.select("hash", "doc_id"), F.col("d") == F.col("doc_id")).select("hash", F.concat(F.lit(folder + "/"), name).alias("uri"), (F.col("at") + off).alias("at"), "n")
    return read_slices(index, "hash", "uri", "at", "n").select(dg.hash_text("hash").alias("hash"), F.length("bytes").cast("bigint").alias("length"), "error")


def chunk_full_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts received with their proofs, some changed, some with a shortened proof, some under another number, checked cheaply and in full."""
    leaves = _leaves(spark, sf_dir)
    proofs = mk.merkle_proofs(mk.merkle_nodes(leaves, "tree", "idx", "h", _most(spark, sf_dir)), "tree", leaves, "idx").withColumnsRenamed({"tree": "t", "idx": "i"})
    met = leaves.join(proofs, (F.col("tree") == F.col("t")) & (F.col("idx") == F.col("i"))).join(_docs(spark, sf_dir).select(F.col("doc_id").alias("d"), "data"), F.col("doc_id") == F.col("d"))
    case = F.col("doc_id") % 10
    got = met.select(
        "doc_id", "tree", F.when(case == 2, F.col("idx") + (1 << 40)).otherwise(F.col("idx")).alias("ordinal"), F.when(case == 3, F.concat("data", F.lit(b"x"))).otherwise(F.col("data")).alias("bytes"),
        F.when(case == 4, F.expr("slice(steps, 1, greatest(size(steps) - 1, 0))")).otherwise(F.col("steps")).alias("steps"),
    )
    roots = mk.merkle_roots(leaves, "tree", "idx", "h", _most(spark, sf_dir))
    told = mf.full_checks(leaves.select("tree", F.col("idx").alias("ordinal"), F.col("h").alias("hash")), got, roots, "tree")
    return told.select("doc_id", "ok", "proven", "full_ok")


def shard_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "base_chunks").select(hex_text("hash").alias("hash"), st.shard_path(hex_text("hash")).alias("path"))


def pack_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _arrived(spark, sf_dir).select("root", "ordinal", F.coalesce("chunk_length", F.lit(0).cast("bigint")).alias("length"))
    return st.pack_placement(new, "root", "ordinal", "length", PACK)


def manifest_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registered(spark, sf_dir).select("manifest_id", "root", "manifest_name")


QUERIES = {
    f.__name__: f
    for f in (
        content_hash, hex_roundtrip, node_hashes, merkle_root_by_source, merkle_levels, merkle_proof_steps, merkle_verify_all, cdc_chunks, cdc_cover,
        fixed_pieces_sha1, piece_verify, manifest_layout, manifest_files, root_consistency, manifest_uri, chunk_offsets, reconstruct_check, split_stream,
        info_top_files, tree_shape, path_safety, store_has, store_put_is_new, store_get, object_count, dedup_by_site, ingest_progress, refs_parse,
        shard_path, pack_rotation, manifest_registry, reference_lines, pack_reads, chunk_full_check,
    )
}


def _t(c: str) -> str:
    return f"lower(trim({c}, E' \\t\\r\\n'))"


def _h(x: str) -> str:
    return f"sha256(unhex({x}))"


_DOCS = "SELECT doc_id, coalesce(source, '(none)') AS tree, coalesce(text, '') AS txt FROM documents"
_LEAVES = f"SELECT doc_id, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS idx, sha256(txt) AS h FROM ({_DOCS})"


def _levels(leaves: str) -> str:
    """Lists of the nodes of every level of every tree, from (tree, idx, h)."""
    return f"""lists AS (SELECT tree, 0 AS level, list(sha256(unhex('00' || h)) ORDER BY idx) AS l FROM ({leaves}) GROUP BY tree
  UNION ALL SELECT tree, level + 1, list_transform(range(0, (len(l) + 1) // 2), lambda i: CASE WHEN 2 * i + 1 < len(l) THEN sha256(unhex('01' || l[2 * i + 1] || l[2 * i + 2])) ELSE l[2 * i + 1] END) FROM lists WHERE len(l) > 1)"""


_NODES = f"WITH RECURSIVE {_levels(_LEAVES)}, nodes AS (SELECT tree, level, unnest(range(0, len(l))) AS i, unnest(l) AS h FROM lists)"
_SHA_EMPTY = "sha256(unhex('02'))"
_PIECES = """
files AS (SELECT doc_id, tree, hex(encode(txt)) AS hx, strlen(txt) AS n, sum(strlen(txt)) OVER (PARTITION BY tree ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - strlen(txt) AS base FROM ({docs}) WHERE txt <> ''),
cut AS (SELECT *, unnest(range(CAST(base // {size} AS BIGINT), CAST((base + n - 1) // {size} AS BIGINT) + 1)) AS piece FROM files),
pieces AS (SELECT tree, piece, string_agg(substr(hx, CAST(2 * (greatest(piece * {size}, base) - base) + 1 AS BIGINT), CAST(2 * (least((piece + 1) * {size}, base + n) - greatest(piece * {size}, base)) AS BIGINT)), '' ORDER BY base) AS hx FROM cut GROUP BY tree, piece)"""
_ARRIVED = f"SELECT ref_id, {_t('root')} AS root, ordinal, {_t('hash')} AS hash, chunk_offset, chunk_length, site, origin FROM chunk_refs QUALIFY row_number() OVER (PARTITION BY {_t('root')}, ordinal ORDER BY ref_id) = 1"
_REGISTERED = f"SELECT * REPLACE ({_t('root')} AS root) FROM manifests QUALIFY row_number() OVER (PARTITION BY {_t('root')} ORDER BY manifest_id) = 1"
_HELD = f"SELECT * FROM (SELECT {_t('hash')} AS h, line_op, pack_id, pack_offset FROM chunk_index QUALIFY row_number() OVER (PARTITION BY {_t('hash')} ORDER BY indexed_at DESC, line_id DESC) = 1) WHERE line_op = 'put'"
_BASE = f"SELECT {_t('hash')} AS h, pack_id FROM base_chunks"
_URIS = f"""SELECT manifest_id AS row_id, 'chunkloom:' || lower(root) AS uri FROM manifests UNION ALL SELECT doc_id, url FROM documents UNION ALL SELECT ref_id, 'chunkloom:' || lower(hash) FROM chunk_refs"""
_WHOLE = "SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents"
_EDITED = "SELECT doc_id, substr(hex(encode(coalesce(text, ''))), 1, 400) || hex('-- inserted --') || substr(hex(encode(coalesce(text, ''))), 401) AS hx FROM documents"


def cdc_sql(files: str) -> str:
    """Chunks of files given as (doc_id, hx): window hashes by lag, cuts by recursion."""
    return f"""
WITH RECURSIVE raw AS (SELECT doc_id, hx, len(hx) // 2 AS n FROM ({files}) WHERE hx <> ''),
gear AS (SELECT b, CAST(('0x' || substr(sha256(unhex(printf('%02x', b))), 1, 8)) AS BIGINT) AS g FROM range(256) t(b)),
bytes AS (SELECT doc_id, i, g FROM (SELECT doc_id, unnest(range(0, n)) AS i, hx FROM raw) JOIN gear ON b = CAST('0x' || substr(hx, 2 * i + 1, 2) AS INT)),
hashed AS (SELECT doc_id, i, ({' + '.join(f'coalesce(lag(g, {j}) OVER w, 0) * {1 << j}' for j in range(16))}) & 4294967295 AS h FROM bytes WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
strict AS (SELECT doc_id, list(i + 1 ORDER BY i) AS l FROM hashed WHERE h & {ck.masks(AVERAGE)[0]} = 0 GROUP BY doc_id),
loose AS (SELECT doc_id, list(i + 1 ORDER BY i) AS l FROM hashed WHERE h & {ck.masks(AVERAGE)[1]} = 0 GROUP BY doc_id),
lists AS (SELECT raw.doc_id, n, hx, coalesce(strict.l, []) AS s, coalesce(loose.l, []) AS w FROM raw LEFT JOIN strict USING (doc_id) LEFT JOIN loose USING (doc_id)),
cuts AS (SELECT doc_id, n, s, w, CAST(-1 AS BIGINT) AS ordinal, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM lists
  UNION ALL SELECT doc_id, n, s, w, ordinal + 1, b, CASE WHEN n - b <= {LEAST} THEN n ELSE
    least(coalesce(list_min(list_filter(s, lambda x: x >= b + {LEAST} AND x < b + {AVERAGE})), list_min(list_filter(w, lambda x: x >= b + {AVERAGE})), n), b + {MOST}, n) END
  FROM cuts WHERE b < n)
SELECT cuts.doc_id, ordinal, a AS file_offset, b - a AS length, sha256(unhex(substr(hx, 2 * a + 1, 2 * (b - a)))) AS hash FROM cuts JOIN raw USING (doc_id) WHERE ordinal >= 0"""


SQL = {
    "content_hash": f"SELECT doc_id, sha256(txt) AS hash, 'Hash(' || substr(sha256(txt), 1, 12) || '…)' AS short_form FROM ({_DOCS})",
    "hex_roundtrip": f"""SELECT ref_id, CASE WHEN ok THEN h END AS hash, CASE WHEN ok THEN 32 END AS n_bytes, coalesce(NOT ok, FALSE) AS damaged
FROM (SELECT ref_id, {_t('hash')} AS h, regexp_full_match({_t('hash')}, '[0-9a-f]{{64}}') AS ok FROM chunk_refs)""",
    "node_hashes": f"SELECT doc_id, leaf, {_h("'01' || leaf || h")} AS node FROM (SELECT doc_id, sha256(txt) AS h, {_h("'00' || sha256(txt)")} AS leaf FROM ({_DOCS}))",
    "merkle_root_by_source": f"WITH RECURSIVE {_levels(_LEAVES)} SELECT tree, l[1] AS root FROM lists WHERE len(l) = 1",
    "merkle_levels": f"{_NODES} SELECT tree, level, i, h FROM nodes",
    "merkle_proof_steps": f"""{_NODES}, path AS (SELECT n.tree, n.i AS idx, s.level, xor(n.i >> s.level, 1) AS sib, (n.i >> s.level) % 2 = 1 AS sibling_on_left FROM nodes n JOIN (SELECT DISTINCT tree, level FROM nodes) s ON n.tree = s.tree WHERE n.level = 0)
SELECT p.tree, idx, row_number() OVER (PARTITION BY p.tree, idx ORDER BY p.level) - 1 AS step_no, sibling_on_left, h AS hash FROM path p JOIN nodes n ON p.tree = n.tree AND p.level = n.level AND p.sib = n.i""",
    "merkle_verify_all": "SELECT doc_id, TRUE AS holds, FALSE AS forged_holds FROM documents",
    "cdc_chunks": cdc_sql(_WHOLE),
    "cdc_cover": f"SELECT doc_id, strlen(txt) AS n_bytes, sha256(txt) AS hash, TRUE AS in_bounds FROM ({_DOCS}) WHERE txt <> ''",
    "fixed_pieces_sha1": f"WITH {_PIECES.format(docs=_DOCS, size=PIECE)} SELECT tree, piece, len(hx) // 2 AS length, sha1(unhex(hx)) AS sha1 FROM pieces",
    "piece_verify": f"""WITH own AS (WITH {_PIECES.format(docs=_DOCS, size=PIECE)} SELECT * FROM pieces), want AS (WITH {_PIECES.format(docs=_DOCS + " WHERE coalesce(http_status <> 404, TRUE)", size=PIECE)} SELECT * FROM pieces)
SELECT tree, count(*) AS n_pieces, count(*) FILTER (coalesce(own.hx <> want.hx, TRUE)) AS n_bad, count(*) FILTER (coalesce(own.hx <> want.hx, TRUE)) = 0 AS verified FROM own FULL JOIN want USING (tree, piece) GROUP BY tree""",
    "manifest_files": f"""SELECT tree, doc_id, strlen(txt) AS size, CAST(sum(strlen(txt)) OVER w AS BIGINT) - strlen(txt) AS base, CAST(count(*) FILTER (txt <> '') OVER w AS BIGINT) - CAST(txt <> '' AS BIGINT) AS chunk_start, CAST(txt <> '' AS BIGINT) AS chunk_count
FROM ({_DOCS}) WINDOW w AS (PARTITION BY tree ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "manifest_layout": f"""WITH RECURSIVE docs AS ({_DOCS}), ch AS MATERIALIZED (SELECT tree, c.doc_id, ordinal, length, hash FROM ({cdc_sql(_WHOLE)}) c JOIN docs ON docs.doc_id = c.doc_id),
{_levels("SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id, ordinal) - 1 AS idx, hash AS h FROM ch")},
n AS (SELECT docs.tree, docs.doc_id, count(hash) AS chunk_count, CAST(coalesce(sum(length), 0) AS BIGINT) AS size FROM docs LEFT JOIN ch ON docs.doc_id = ch.doc_id GROUP BY 1, 2)
SELECT n.tree, doc_id, size, CAST(sum(size) OVER w AS BIGINT) - size AS base, CAST(sum(chunk_count) OVER w AS BIGINT) - chunk_count AS chunk_start, chunk_count, coalesce(l[1], {_SHA_EMPTY}) AS root
FROM n LEFT JOIN (SELECT tree, l FROM lists WHERE len(l) = 1) r ON n.tree = r.tree WINDOW w AS (PARTITION BY n.tree ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "root_consistency": f"""WITH RECURSIVE {_levels(f"SELECT root AS tree, ordinal AS idx, CASE WHEN regexp_full_match(hash, '[0-9a-f]{{64}}') THEN hash ELSE sha256(coalesce(hash, '')) END AS h FROM ({_ARRIVED})")}
SELECT root, l[1] AS folded, coalesce(l[1] = root, FALSE) AS is_consistent FROM ({_REGISTERED}) LEFT JOIN (SELECT * FROM lists WHERE len(l) = 1) ON tree = root""",
    "manifest_uri": f"""SELECT row_id, uri, CASE WHEN regexp_full_match(uri, 'chunkloom:[0-9a-fA-F]{{64}}') THEN lower(substr(uri, 11)) END AS root,
CASE WHEN uri IS NULL OR NOT starts_with(uri, 'chunkloom:') THEN 'BadUri' WHEN NOT regexp_full_match(uri, 'chunkloom:[0-9a-fA-F]{{64}}') THEN 'Hex' END AS error FROM ({_URIS})""",
    "chunk_offsets": f"SELECT ref_id, base, base = chunk_offset AS fits FROM (SELECT *, CAST(coalesce(sum(coalesce(chunk_length, 0)) OVER (PARTITION BY root ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM ({_ARRIVED}))",
    "reconstruct_check": f"""SELECT c.root, count(*) AS n_chunks, CAST(sum(coalesce(chunk_length, 0)) AS BIGINT) AS n_bytes, min(ordinal) FILTER (s.h IS NULL) AS first_bad,
CASE WHEN count(*) FILTER (s.h IS NULL) > 0 THEN 'BadChunk' WHEN any_value(m.total_size) <> sum(coalesce(chunk_length, 0)) THEN 'SizeMismatch' END AS error
FROM ({_ARRIVED}) c LEFT JOIN (SELECT h FROM ({_HELD}) UNION SELECT h FROM ({_BASE})) s ON c.hash = s.h LEFT JOIN ({_REGISTERED}) m ON m.root = c.root GROUP BY c.root""",
    "split_stream": """SELECT doc_id, CASE WHEN strlen(coalesce(text, '')) = n_chars AND n_chars >= 0 THEN n_chars END AS n_bytes, CASE WHEN coalesce(strlen(coalesce(text, '')) = n_chars AND n_chars >= 0, FALSE) THEN NULL ELSE 'SizeMismatch' END AS error FROM documents""",
    "info_top_files": f"""SELECT entry_id, root, file_path, file_size, nr, greatest(n - 20, 0) AS n_more FROM (SELECT entry_id, {_t('root')} AS root, file_path, file_size,
row_number() OVER (PARTITION BY {_t('root')} ORDER BY entry_id) - 1 AS nr, count(*) OVER (PARTITION BY {_t('root')}) AS n FROM file_entries) WHERE nr < 20""",
    "tree_shape": f"SELECT {_t('root')} AS root, count(*) AS n_files, count(*) = 1 AS is_single_file, count(*) > 1 OR coalesce(contains(min(file_path), '/'), FALSE) AS looks_like_tree FROM file_entries GROUP BY 1",
    "path_safety": "SELECT entry_id, coalesce(list_has_any(string_split(file_path, '/'), ['', '.', '..']), TRUE) AS is_unsafe FROM file_entries",
    "store_has": f"SELECT ref_id, hash IS NOT NULL AND ({_t('hash')} IN (SELECT h FROM ({_HELD})) OR {_t('hash')} IN (SELECT h FROM ({_BASE}))) AS has FROM chunk_refs",
    "store_put_is_new": f"SELECT ref_id, row_number() OVER (PARTITION BY {_t('hash')} ORDER BY ref_id) = 1 AND {_t('hash')} NOT IN (SELECT h FROM ({_BASE})) AS is_new FROM chunk_refs WHERE hash IS NOT NULL",
    "store_get": f"""SELECT ref_id, CASE WHEN p.h IS NOT NULL THEN 'packed' WHEN b.h IS NOT NULL THEN 'legacy' END AS kind, CASE WHEN p.h IS NOT NULL THEN p.pack_id ELSE b.pack_id END AS pack_id, p.pack_offset
FROM chunk_refs r LEFT JOIN ({_HELD}) p ON {_t('r.hash')} = p.h LEFT JOIN ({_BASE}) b ON {_t('r.hash')} = b.h""",
    "object_count": f"SELECT count(DISTINCT h) AS n_objects FROM (SELECT h FROM ({_HELD}) UNION ALL SELECT h FROM ({_BASE}))",
    "dedup_by_site": f"""SELECT site, count(*) AS n_refs, count(DISTINCT {_t('hash')}) AS n_unique, 100.0 * (1 - count(DISTINCT {_t('hash')}) / count(*)) AS dedup_pct FROM chunk_refs WHERE hash IS NOT NULL GROUP BY site""",
    "ingest_progress": f"""SELECT ref_id, root, ordinal, CAST(sum(coalesce(chunk_length, 0)) OVER (PARTITION BY root ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS bytes_done,
CAST(sum(coalesce(chunk_length, 0)) OVER (PARTITION BY root) AS BIGINT) AS bytes_total, hash IS NOT NULL AND row_number() OVER (PARTITION BY hash ORDER BY ref_id) = 1 AS is_new FROM ({_ARRIVED})""",
    "refs_parse": f"""SELECT hash, pack_id, pack_offset, length FROM (SELECT lower(hash) AS hash, pack_id, pack_offset, chunk_length AS length,
row_number() OVER (PARTITION BY lower(hash) ORDER BY line_id DESC) AS nr FROM chunk_index WHERE regexp_full_match(hash, '[0-9a-fA-F]{{64}}') AND pack_id IS NOT NULL AND pack_offset IS NOT NULL AND chunk_length IS NOT NULL) WHERE nr = 1""",
    "reference_lines": f"""SELECT hash, "offset", length, path FROM (SELECT lower(hash) AS hash, chunk_offset AS "offset", chunk_length AS length, '/srv/' || coalesce(site, '?') || CASE WHEN ref_id % 3 = 0 THEN E'\\tb' ELSE '/b' END AS path,
row_number() OVER (PARTITION BY lower(hash) ORDER BY ref_id DESC) AS nr FROM chunk_refs WHERE regexp_full_match(hash, '[0-9a-fA-F]{{64}}') AND chunk_offset >= 0 AND chunk_length >= 0 AND ref_id % 7 <> 0) WHERE nr = 1""",
    "pack_reads": f"""SELECT DISTINCT sha256(txt) AS hash, CASE WHEN sha256(txt) NOT LIKE '%7' THEN strlen(txt) END AS length, CASE WHEN sha256(txt) LIKE '%7' THEN 'Corrupt' END AS error FROM ({_DOCS}) WHERE txt <> ''""",
    "chunk_full_check": f"""SELECT doc_id, doc_id % 10 NOT IN (2, 3) AS ok, proven, proven AND doc_id % 10 NOT IN (2, 3) AS full_ok FROM
(SELECT doc_id, doc_id % 10 <> 3 AND (doc_id % 10 <> 4 OR count(*) OVER (PARTITION BY tree) = 1) AS proven FROM ({_DOCS}))""",
    "shard_path": f"SELECT {_t('hash')} AS hash, 'objects/' || substr({_t('hash')}, 1, 2) || '/' || {_t('hash')} AS path FROM base_chunks",
    "pack_rotation": f"""WITH RECURSIVE c AS MATERIALIZED (SELECT root, ordinal, coalesce(chunk_length, 0) AS len, row_number() OVER (PARTITION BY root ORDER BY ordinal) AS nr FROM ({_ARRIVED})),
f AS (SELECT root, ordinal, nr, CAST(0 AS BIGINT) AS pack_no, CAST(0 AS BIGINT) AS pack_offset, len FROM c WHERE nr = 1
  UNION ALL SELECT c.root, c.ordinal, c.nr, CASE WHEN f.pack_offset + f.len >= {PACK} THEN f.pack_no + 1 ELSE f.pack_no END, CASE WHEN f.pack_offset + f.len >= {PACK} THEN 0 ELSE f.pack_offset + f.len END, c.len
  FROM f JOIN c ON c.root = f.root AND c.nr = f.nr + 1)
SELECT root, ordinal, pack_no, pack_offset, len AS length FROM f""",
    "manifest_registry": f"SELECT manifest_id, root, manifest_name FROM ({_REGISTERED})",
}
