"""Manifests: the layout of a file tree's chunks, its address, checks and rebuilding.

A manifest is normalised into rows: ``files`` (tree, path, size, chunk_start,
chunk_count) and ``chunks`` (tree, ordinal, hash, offset, length). Its content id is
the hash-tree root over the chunk hashes in order; names and sizes aren't part of it.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, functions as F

from chunkloom.functions.digest import hash_from_text
from chunkloom.operators.merkle import merkle_roots, proof_holds
from chunkloom.operators.prefix import running_total

#: Address scheme and container header of this project.
SCHEME, MAGIC, VERSION = "chunkloom", b"CKLM", 1


def tree_layout(files: DataFrame, chunks: DataFrame, tree: str, order: str, ident: str) -> tuple[DataFrame, DataFrame]:
    """(files, chunks) of trees: files get ``chunk_start, chunk_count, size, base``, chunks ``ordinal, offset`` over the tree.

    ``files`` has (tree, order, ident); ``chunks`` the file chunks (ident, ordinal,
    file_offset, length, hash). Files without chunks have size 0 and count 0.
    """
    sums = chunks.groupBy(F.col(ident).alias("__f")).agg(F.count("*").alias("chunk_count"), F.sum("length").alias("size"))
    sized = files.join(sums, F.col(ident) == F.col("__f"), "left").drop("__f").withColumns(
        {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("chunk_count", "size")}
    )
    based = running_total(running_total(sized, tree, order, F.col("size"), "base"), tree, order, F.col("chunk_count"), "chunk_start")
    keys = based.select(F.col(ident).alias("__f"), F.col(tree), "base", "chunk_start")
    placed = chunks.join(keys, F.col(ident) == F.col("__f")).select(
        tree, (F.col("chunk_start") + F.col("ordinal")).alias("ordinal"), (F.col("base") + F.col("file_offset")).alias("offset"), "length", "hash"
    )
    return based, placed


def content_ids(chunks: DataFrame, tree: str, most: int | None = None) -> DataFrame:
    """``(tree, root)`` from the chunk rows of ``tree_layout``; ``most`` as in ``merkle_roots``."""
    return merkle_roots(chunks, tree, "ordinal", "hash", most)


def address(root: Column | str, scheme: str = SCHEME) -> Column:
    """``scheme:`` and the root in lower-case hex."""
    root = F.col(root) if isinstance(root, str) else root
    return F.concat(F.lit(f"{scheme}:"), F.lower(root))


def parsed_address(uri: Column | str, scheme: str = SCHEME) -> tuple[Column, Column]:
    """(root as hex or null, error or null): ``BadUri`` for another scheme, ``Hex`` for what isn't 64 hex digits."""
    uri = F.col(uri) if isinstance(uri, str) else uri
    rest = F.when(uri.startswith(f"{scheme}:"), F.substring(uri, len(scheme) + 2, 2147483647))
    root = hash_from_text(rest)
    error = F.when(F.coalesce(rest.isNull(), F.lit(True)), "BadUri").when(root.isNull(), "Hex")
    return F.lower(F.hex(root)), error


def consistent(stated: DataFrame, chunks: DataFrame, tree: str, root: str, most: int | None = None) -> DataFrame:
    """``stated`` with ``folded`` (root of the chunk rows, null without any) and ``is_consistent``."""
    own = content_ids(chunks.withColumnRenamed(tree, "__t"), "__t", most).withColumnRenamed("root", "folded")
    return stated.join(own, F.col(tree).eqNullSafe(F.col("__t")), "left").drop("__t").withColumn("is_consistent", F.coalesce(F.col("folded") == F.col(root), F.lit(False)))


def chunk_checks(chunks: DataFrame, got: DataFrame, tree: str) -> DataFrame:
    """Every received ``(tree, ordinal, bytes)`` with ``ok``: its hash equals the manifest's; out of range is not ok."""
    want = chunks.select(F.col(tree).alias("__t"), F.col("ordinal").alias("__o"), F.col("hash").alias("__h"))
    met = got.join(want, F.col(tree).eqNullSafe(F.col("__t")) & (F.col("ordinal") == F.col("__o")), "left")
    return met.select(*got.columns, F.coalesce(F.unhex(F.sha2("bytes", 256)) == F.col("__h"), F.lit(False)).alias("ok"))


def full_checks(chunks: DataFrame, got: DataFrame, roots: DataFrame, tree: str) -> DataFrame:
    """Every received ``(tree, ordinal, bytes, steps)`` with ``ok`` (as in ``chunk_checks``), ``proven`` and ``full_ok``.

    ``steps`` is the inclusion proof that came with the bytes (``merkle_proofs``); it
    must lead from the hash of the bytes to the tree's root in ``roots (tree, root)``.
    """
    cheap = chunk_checks(chunks, got, tree)
    met = cheap.join(roots.select(F.col(tree).alias("__t"), F.col("root").alias("__r")), F.col(tree).eqNullSafe(F.col("__t")), "left")
    proven = proof_holds(F.unhex(F.sha2("bytes", 256)), F.coalesce("steps", F.array().cast(got.schema["steps"].dataType)), "__r")
    return met.select(*got.columns, "ok", proven.alias("proven"), (F.col("ok") & proven).alias("full_ok"))


def rebuild_status(chunks: DataFrame, held: DataFrame, tree: str, key: str, stated_size: DataFrame | None = None) -> DataFrame:
    """``(tree, n_chunks, n_bytes, first_bad, error)``: what rebuilding from the store would give.

    ``held`` has the keys of chunks that can be read and pass their check. The first
    failing ordinal makes ``BadChunk``; then a stated size that differs makes
    ``SizeMismatch``; null means success.
    """
    there = held.select(F.col(key).alias("__k")).where(F.col("__k").isNotNull()).distinct()
    met = chunks.join(there, F.col(key) == F.col("__k"), "left")
    own = met.groupBy(tree).agg(
        F.count("*").alias("n_chunks"), F.sum(F.coalesce("length", F.lit(0).cast("bigint"))).alias("n_bytes"),
        F.min(F.when(F.col("__k").isNull(), F.col("ordinal"))).alias("first_bad"),
    )
    size_error = F.lit(None).cast("string")
    if stated_size is not None:
        own = own.join(stated_size.select(F.col(tree).alias("__t"), F.col("size").alias("__s")), F.col(tree).eqNullSafe(F.col("__t")), "left")
        size_error = F.when(F.col("__s") != F.col("n_bytes"), "SizeMismatch")
    return own.select(tree, "n_chunks", "n_bytes", "first_bad", F.when(F.col("first_bad").isNotNull(), "BadChunk").otherwise(size_error).alias("error"))


def split_stream(files: DataFrame, streams: DataFrame, tree: str, order: str) -> DataFrame:
    """Files ``(tree, order, size)`` with their slice ``bytes`` of the tree's stream ``(tree, stream)``, and ``error``.

    A stream of another length than the sizes' sum makes ``SizeMismatch`` for each of
    its files, which then have no bytes; negative sizes count as a mismatch.
    """
    placed = running_total(files, tree, order, F.col("size"), "base")
    totals = files.groupBy(F.col(tree).alias("__g")).agg(F.sum("size").alias("__sum"), F.min("size").alias("__least"))
    s = streams.select(F.col(tree).alias("__t"), "stream")
    met = placed.join(totals, F.col(tree).eqNullSafe(F.col("__g"))).join(s, F.col(tree).eqNullSafe(F.col("__t")), "left")
    bad = F.coalesce((F.length("stream") != F.col("__sum")) | (F.col("__least") < 0), F.lit(True))
    cut = F.substring(F.col("stream"), (F.col("base") + 1).cast("int"), F.col("size").cast("int"))
    return met.select(*files.columns, F.when(~bad, cut).alias("bytes"), F.when(bad, "SizeMismatch").alias("error"))


def first_files(files: DataFrame, tree: str, order: str, shown: int = 20) -> DataFrame:
    """The first files of each tree, as a listing shows them, with ``n_more`` left out."""
    from chunkloom.operators.prefix import dense_index

    placed = dense_index(files, tree, order, "nr")
    sizes = files.groupBy(F.col(tree).alias("__g")).agg(F.count("*").alias("__n"))
    met = placed.where(F.col("nr") < shown).join(sizes, F.col(tree).eqNullSafe(F.col("__g")))
    return met.select(*files.columns, "nr", F.greatest(F.col("__n") - shown, F.lit(0)).alias("n_more"))


def tree_shape(files: DataFrame, tree: str, path: str) -> DataFrame:
    """``(tree, n_files, is_single_file, looks_like_tree)``: more than one file, or a first path with a slash."""
    own = files.groupBy(tree).agg(F.count("*").alias("n_files"), F.min(path).alias("__first"))
    return own.select(tree, "n_files", (F.col("n_files") == 1).alias("is_single_file"), ((F.col("n_files") > 1) | F.coalesce(F.col("__first").contains("/"), F.lit(False))).alias("looks_like_tree"))


def unsafe_path(path: Column | str) -> Column:
    """Whether a path has an empty, ``.`` or ``..`` part; null is unsafe."""
    path = F.col(path) if isinstance(path, str) else path
    return F.coalesce(F.exists(F.split(path, "/", -1), lambda c: c.isin("", ".", "..")), F.lit(True))


# The container: header, then little-endian 64-bit counts and fixed-size numbers.


def encode_manifest(m: dict) -> bytes:
    """Container bytes of ``{root, total_size, chunks [(hash, offset, length)], files [(path, size, start, count)], name}``."""
    text = lambda s: struct.pack("<Q", len(s.encode())) + s.encode()
    out = [MAGIC, bytes([VERSION]), m["root"], struct.pack("<QQ", m["total_size"], len(m["chunks"]))]
    out += [h + struct.pack("<QI", o, n) for h, o, n in m["chunks"]]
    out.append(struct.pack("<Q", len(m["files"])))
    out += [text(p) + struct.pack("<QQQ", s, a, n) for p, s, a, n in m["files"]]
    out.append(b"\x00" if m.get("name") is None else b"\x01" + text(m["name"]))
    return b"".join(out)


class ContainerError(ValueError):
    """``BadMagic``, ``UnsupportedVersion`` or ``Truncated``."""


def decode_manifest(raw: bytes) -> dict:
    """The inverse of ``encode_manifest``; raises ``ContainerError``, never anything else."""
    if len(raw) < 5 or raw[:4] != MAGIC:
        raise ContainerError("BadMagic")
    if raw[4] != VERSION:
        raise ContainerError("UnsupportedVersion")
    at = 5

    def take(n: int) -> bytes:
        nonlocal at
        if n < 0 or at + n > len(raw):
            raise ContainerError("Truncated")
        at += n
        return raw[at - n : at]

    def number() -> int:
        return struct.unpack("<Q", take(8))[0]

    def text() -> str:
        try:
            return take(number()).decode()
        except UnicodeDecodeError:
            raise ContainerError("Truncated") from None

    root, total = take(32), number()
    chunks = []
    for _ in range(number()):
        h = take(32)
        chunks.append((h, *struct.unpack("<QI", take(12))))
    files = []
    for _ in range(number()):
        p = text()
        files.append((p, *struct.unpack("<QQQ", take(24))))
    name = text() if take(1) == b"\x01" else None
    if at != len(raw):
        raise ContainerError("Truncated")
    return {"root": root, "total_size": total, "chunks": chunks, "files": files, "name": name}


def header_error(content: Column | str) -> Column:
    """The header's error (``BadMagic``, ``UnsupportedVersion``) or null, without decoding the body."""
    c = F.col(content) if isinstance(content, str) else content
    bad = F.coalesce((F.length(c) < 5) | (F.substring(c, 1, 4) != F.lit(MAGIC)), F.lit(True))
    return F.when(bad, "BadMagic").when(F.substring(c, 5, 1) != F.lit(bytes([VERSION])), "UnsupportedVersion")


FIELDS = (
    "root binary, total_size bigint, chunks array<struct<hash:binary,offset:bigint,length:bigint>>, "
    "files array<struct<path:string,size:bigint,chunk_start:bigint,chunk_count:bigint>>, name string, error string"
)


def decode_containers(df: DataFrame, ident: str, content: str) -> DataFrame:
    """``ident`` and the manifest's fields of each container, or ``error``."""
    import pyarrow as pa

    kind = df.schema[ident].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for raw in b.column(1).to_pylist():
                try:
                    m = decode_manifest(raw or b"")
                    rows.append({
                        "root": m["root"], "total_size": m["total_size"], "name": m["name"], "error": None,
                        "chunks": [{"hash": h, "offset": o, "length": n} for h, o, n in m["chunks"]],
                        "files": [{"path": p, "size": s, "chunk_start": a, "chunk_count": n} for p, s, a, n in m["files"]],
                    })
                except ContainerError as e:
                    rows.append({"root": None, "total_size": None, "name": None, "error": str(e), "chunks": None, "files": None})
            chunk = pa.struct([("hash", pa.binary()), ("offset", pa.int64()), ("length", pa.int64())])
            file = pa.struct([("path", pa.string()), ("size", pa.int64()), ("chunk_start", pa.int64()), ("chunk_count", pa.int64())])
            kinds = {"root": pa.binary(), "total_size": pa.int64(), "chunks": pa.list_(chunk), "files": pa.list_(file), "name": pa.string(), "error": pa.string()}
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in kinds.items())], names=[ident, *kinds])

    return df.select(ident, F.col(content).cast("binary")).mapInArrow(run, f"{ident} {kind}, {FIELDS}")
