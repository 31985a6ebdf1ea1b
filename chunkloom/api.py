"""Whole jobs over folders: pack a tree into a store, describe, verify and export it, serve its manifests.

A store is a folder that all executors reach: ``chunks`` (hash, length, bytes),
``places`` (chunks left in their source files) and the normalised ``manifests``,
``files`` and ``refs``, appended as parquet. Appending the same tree again adds no
chunk and no manifest. Files are cut and written piece by piece, so they may be of any
size; only bytes of chunks that are new are copied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chunkloom.functions.digest import empty_root, hash_text
from chunkloom.operators import bridge, chunking, fec, manifest as mf
from chunkloom.operators.prefix import dense_index
from chunkloom.session import materialize
from chunkloom.sources.files import scan_tree
from chunkloom.sources.streams import list_files, read_slices, stream_chunks, write_files

SHAPES = {
    "places": "hash binary, uri string, offset bigint, length bigint",
    "chunks": "hash binary, length bigint, bytes binary", "manifests": "root string, name string, total_size bigint, n_files bigint, n_chunks bigint",
    "files": "root string, nr bigint, path string, size bigint, chunk_start bigint, chunk_count bigint", "refs": "root string, ordinal bigint, offset bigint, length bigint, hash binary",
}


class Store:
    """A chunk store below a folder."""

    def __init__(self, spark: SparkSession, folder: str, sizes: tuple[int, int, int] = (chunking.MIN_SIZE, chunking.AVG_SIZE, chunking.MAX_SIZE)):
        self.spark, self.folder, self.sizes = spark, folder.rstrip("/"), sizes
        for name, shape in SHAPES.items():
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
                spark.createDataFrame([], shape).write.parquet(f"{self.folder}/{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SHAPES[name]).parquet(f"{self.folder}/{name}")

    def _append(self, df: DataFrame, name: str) -> None:
        df.select([s.split()[0] for s in SHAPES[name].split(", ")]).write.mode("append").parquet(f"{self.folder}/{name}")

    def _take(self, listed: DataFrame, cut: DataFrame, name: str | None, expect: str | None = None) -> tuple[str, DataFrame]:
        """Register the tree of files ``(path, at)`` and chunks; returns its root and the chunks the store lacks, one row a hash."""
        laid, refs = mf.tree_layout(listed.select(F.lit(1).alias("tree"), "at", "path"), cut.select("at", "ordinal", "file_offset", "length", "hash"), "tree", "at", "at")
        found = mf.content_ids(refs, "tree").select(hash_text("root")).first()
        root = found[0] if found else self.spark.range(1).select(hash_text(empty_root())).first()[0]
        if expect is not None and root != expect:
            raise ValueError(f"root {root} instead of {expect}")
        new = cut.dropDuplicates(["hash"]).join(self.table("chunks").select("hash"), "hash", "left_anti").join(self.table("places").select("hash"), "hash", "left_anti")
        if not self.table("manifests").where(F.col("root") == root).take(1):
            own = dense_index(laid, "tree", "at", "nr").withColumn("root", F.lit(root))
            self._append(own, "files")
            self._append(refs.withColumn("root", F.lit(root)), "refs")
            size, n_files, n_chunks = laid.agg(F.sum("size"), F.count("*"), F.sum("chunk_count")).first()
            self._append(self.spark.createDataFrame([(root, name, size or 0, n_files, n_chunks or 0)], SHAPES["manifests"]), "manifests")
        return root, new

    def pack_files(self, files: DataFrame, name: str | None = None, ordered: bool = False, expect: str | None = None) -> str:
        """Take in ``(path, data)`` as one tree, in bytewise order of paths (or of ``nr`` if ``ordered``); returns the root.

        Null data counts as empty. Unsafe paths, and a root other than ``expect``, raise before anything is written.
        """
        if bad := files.where(mf.unsafe_path("path")).select("path").take(1):
            raise ValueError(f"unsafe path: {bad[0][0]!r}")
        keyed = files if ordered else files.sort("path").withColumn("nr", F.monotonically_increasing_id())
        # written once: the numbers must not change between uses
        listed = materialize(keyed.select("path", F.col("nr").cast("bigint").alias("at"), F.coalesce("data", F.lit(b"")).alias("data")), "pack")
        cut = materialize(chunking.content_chunks(listed, "at", "data", *self.sizes), "cut")
        root, new = self._take(listed, cut, name, expect)
        piece = F.expr("substring(data, cast(file_offset + 1 as int), cast(length as int))")
        self._append(new.join(listed.select(F.col("at").alias("__at"), "data"), F.col("at") == F.col("__at")).select("hash", "length", piece.alias("bytes")), "chunks")
        return root

    def pack(self, folder: str, name: str | None = None, copy: bool = True) -> str:
        """Take in all files below a folder, of any size; without ``copy`` the chunks stay there and only their places are noted.

        Of a copied tree only the chunks that are new are read again, and checked while at it.
        """
        listing = list_files(self.spark, folder)
        if bad := listing.where(mf.unsafe_path("path")).select("path").take(1):
            raise ValueError(f"unsafe path: {bad[0][0]!r}")
        listed = materialize(listing.sort("path").withColumn("at", F.monotonically_increasing_id()), "pack")
        cut = materialize(stream_chunks(listed.repartition("at"), "at", "uri", *self.sizes), "cut")
        root, new = self._take(listed, cut, name)
        places = new.join(listed.select(F.col("at").alias("__at"), "uri"), F.col("at") == F.col("__at")).select("hash", "uri", F.col("file_offset").alias("offset"), "length")
        if not copy:
            self._append(places, "places")
            return root
        got = read_slices(places, "hash", "uri", "offset", "length")
        changed = F.when(F.col("error").isNotNull(), F.raise_error(F.lit("a file changed while it was taken in"))).otherwise(F.col("bytes"))
        self._append(got.select("hash", F.length("bytes").cast("bigint").alias("length"), changed.alias("bytes")), "chunks")
        return root

    def take_symbols(self, root: str, listing: DataFrame, symbols: DataFrame, name: str | None = None) -> str:
        """Take in content from erasure-coded ``symbols (size, esi, payload)``: decoded, split into the files ``(nr, path, size)``, accepted only if they give ``root``."""
        decoded = fec.decode_symbols(symbols.select(F.lit(root).alias("root"), "size", "esi", "payload"), "root").select(F.lit("t").alias("tree"), F.col("data").alias("stream"))
        cut = materialize(mf.split_stream(listing.select(F.lit("t").alias("tree"), "nr", "path", "size"), decoded, "tree", "nr"), "split")
        if bad := cut.where("error IS NOT NULL").select("error").take(1):
            raise ValueError(bad[0][0])
        return self.pack_files(cut.select("nr", "path", F.col("bytes").alias("data")), name, ordered=True, expect=root)

    def pack_bytes(self, data: bytes, name: str | None = None) -> str:
        """Take in one byte string, as a file called ``name`` or ``data``."""
        return self.pack_files(self.spark.createDataFrame([(name or "data", data)], "path string, data binary"), name)

    def info(self, root: str, shown: int = 20) -> dict:
        """Name, sizes, address and the first files of a tree, and whether its chunks fold to its root."""
        row = self.table("manifests").where(F.col("root") == root).first()
        if row is None:
            raise KeyError(root)
        refs = self.table("refs").where(F.col("root") == root)
        folded = mf.content_ids(refs.withColumnRenamed("root", "tree"), "tree").select(hash_text("root")).first()
        top = self.table("files").where((F.col("root") == root) & (F.col("nr") < shown)).orderBy("nr")
        whole = folded[0] if folded else self.spark.range(1).select(hash_text(empty_root())).first()[0]
        return row.asDict() | {"address": f"{mf.SCHEME}:{root}", "consistent": whole == root, "files": [(r["path"], r["size"]) for r in top.collect()], "more": max(0, row["n_files"] - shown)}

    def read(self, hashes: DataFrame) -> DataFrame:
        """``(hash, bytes, error)`` of each distinct asked hash: copied chunks first, then places; only bytes that hash to their name.

        ``Missing`` where there is nothing, ``Corrupt`` where copied bytes or a source file have changed.
        """
        asked = hashes.select("hash").distinct()
        own = self.table("chunks").dropDuplicates(["hash"]).join(asked, "hash", "left_semi")
        good = F.unhex(F.sha2("bytes", 256)) == F.col("hash")
        copied = own.select("hash", F.when(good, F.col("bytes")).alias("bytes"), F.when(good, None).otherwise("Corrupt").alias("error"))
        rest = asked.join(own.select("hash"), "hash", "left_anti")
        placed = self.table("places").dropDuplicates(["hash"]).join(rest, "hash", "left_semi")
        gone = rest.join(placed.select("hash"), "hash", "left_anti").select("hash", F.lit(None).cast("binary").alias("bytes"), F.lit("Missing").alias("error"))
        return copied.unionByName(read_slices(placed, "hash", "uri", "offset", "length")).unionByName(gone)

    def verify(self, root: str) -> DataFrame:
        """``(tree, n_chunks, n_bytes, first_bad, error)`` of rebuilding the tree: chunks must be there and hash to their name."""
        refs = self.table("refs").where(F.col("root") == root).select(F.col("root").alias("tree"), "ordinal", "length", "hash")
        good = self.read(refs).where("error IS NULL").select("hash")
        size = self.table("manifests").where(F.col("root") == root).select(F.col("root").alias("tree"), F.col("total_size").alias("size"))
        return mf.rebuild_status(refs, good, "tree", "hash", size)

    def parts(self, root: str) -> DataFrame:
        """``(nr, path, ordinal, data)``: the files of a tree in pieces, an empty file as one piece without bytes."""
        files = self.table("files").where(F.col("root") == root)
        refs = self.table("refs").where(F.col("root") == root).select("ordinal", "hash")
        # a file's chunk range against ordinals: an equi-join on every ordinal of the file
        own = files.where("chunk_count > 0").select("nr", "path", F.explode(F.expr("sequence(chunk_start, chunk_start + chunk_count - 1)")).alias("o"))
        met = own.join(refs, F.col("o") == F.col("ordinal")).join(self.read(refs), "hash").select("nr", "path", "ordinal", F.col("bytes").alias("data"))
        return met.unionByName(files.where("chunk_count = 0").select("nr", "path", F.lit(0).cast("bigint").alias("ordinal"), F.lit(b"").alias("data")))

    def files(self, root: str) -> DataFrame:
        """``(nr, path, data)`` of a tree, rebuilt from its chunks; a file is one row here, 2 GB at most (``export`` has no such limit)."""
        lists = self.parts(root).groupBy("nr", "path").agg(F.array_sort(F.collect_list(F.struct("ordinal", "data")))["data"].alias("p"))

        def join(batches):
            import pyarrow as pa

            for b in batches:
                data = [b"".join(p) for p in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary())], names=["nr", "path", "data"])

        return lists.mapInArrow(join, "nr bigint, path string, data binary")

    def export(self, root: str, folder: str) -> None:
        """Write a tree's files below ``folder``, piece by piece; raises if a chunk is missing or damaged."""
        told = self.verify(root).first()
        if told is not None and told["error"]:
            raise ValueError(f"{told['error']} at chunk {told['first_bad']}")
        write_files(self.parts(root), folder)

    def containers(self, roots: list[str] | None = None) -> DataFrame:
        """``(root, content)``: container bytes of the asked manifests, or of all. A manifest is one row."""
        served = self.table("manifests") if roots is None else self.table("manifests").where(F.col("root").isin(roots))
        files = self.table("files").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("nr", "path", "size", "chunk_start", "chunk_count"))).alias("fs"))
        refs = self.table("refs").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("ordinal", "hash", "offset", "length"))).alias("cs"))
        met = served.join(files, "root", "left").join(refs, "root", "left").select("root", "name", "total_size", "fs", "cs")

        def run(batches):
            import pyarrow as pa

            for b in batches:
                out = []
                for m in b.to_pylist():
                    out.append(mf.encode_manifest({
                        "root": bytes.fromhex(m["root"]), "total_size": m["total_size"], "name": m["name"],
                        "chunks": [(c["hash"], c["offset"], c["length"]) for c in m["cs"] or []], "files": [(f["path"], f["size"], f["chunk_start"], f["chunk_count"]) for f in m["fs"] or []],
                    }))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["root", "content"])

        return met.mapInArrow(run, "root string, content binary")

    def convert(self, meta: dict, files: DataFrame) -> str:
        """Take in the files ``(nr, path, data)`` of a torrent in its order, after all pieces have been verified; returns the root."""
        pieces = chunking.fixed_pieces(files.withColumn("tree", F.lit("t")), "tree", "nr", F.col("data"), meta["piece_length"])
        want = self.spark.createDataFrame([("t", i, h.hex()) for i, h in enumerate(meta["piece_hashes"])], "tree string, piece bigint, sha1 string")
        told = chunking.verify_pieces(pieces, want, "tree").first()
        if told is not None and not told["verified"]:
            raise ValueError(f"{told['n_bad']} bad pieces")
        return self.pack_files(files, meta["name"], ordered=True)

    def convert_torrent(self, raw: bytes, folder: str) -> str:
        """``convert`` the files of a torrent from a folder that holds them; a missing one raises."""
        meta = bridge.parse_metainfo(raw)
        listed = self.spark.createDataFrame([(i, p) for i, (p, _) in enumerate(meta["files"])], "nr bigint, path string")
        found = listed.join(scan_tree(self.spark, folder).select("path", "data"), "path")
        if found.count() != len(meta["files"]):
            raise FileNotFoundError("files of the torrent are missing")
        return self.convert(meta, found)


def serve_set(manifests: DataFrame, explicit: list[str], everything: bool) -> DataFrame:
    """The manifests to serve: the explicit roots, or all; exactly one of both must be asked for. Each root once."""
    if bool(explicit) == everything:
        raise ValueError("name manifests or ask for all, not both")
    chosen = manifests if everything else manifests.where(F.col("root").isin(explicit))
    return chosen.dropDuplicates(["root"])
