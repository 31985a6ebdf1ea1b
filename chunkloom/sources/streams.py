"""Files read and written piece by piece, of any size: listing, cutting, slices by place, chunks joined to files.

Tasks reach files through pyarrow's file systems (hdfs, s3, gs, file) or, for plain
paths, the file system that all executors share. A task holds a buffer, never a file.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from chunkloom.operators.chunking import AVG_SIZE, MAX_SIZE, MIN_SIZE, cut_stream
from chunkloom.operators.manifest import unsafe_path

#: Bytes read at once.
BUFFER = 8 << 20


def open_place(uri: str) -> tuple:
    """(file system, path) of a URI or a plain path."""
    from pyarrow import fs

    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), os.path.abspath(uri[5:] if uri.startswith("file:") else uri)


def listing(folder: str) -> list[tuple[str, str, int]]:
    """(path below the folder with ``/``, place for ``open_place``, size) of all files below a folder, by one recursive listing."""
    from pyarrow import fs

    system, base = open_place(folder)
    base = base.rstrip("/")
    found = [(i.path[len(base) + 1 :], i.path, i.size) for i in system.get_file_info(fs.FileSelector(base, recursive=True)) if i.type == fs.FileType.File]
    if isinstance(system, fs.LocalFileSystem):
        return found
    return [(path, f"{folder.rstrip('/')}/{quote(path)}", size) for path, _, size in found]


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, uri, size)`` of all files below a folder, empty ones too, from the listing alone."""
    return spark.createDataFrame(listing(folder), "path string, uri string, size bigint")


def _blocks(uri: str) -> Iterator[bytes]:
    system, path = open_place(uri)
    with system.open_input_stream(path) as source:
        while block := source.read(BUFFER):
            yield block


def stream_chunks(
    files: DataFrame, ident: str, uri: str, least: int = MIN_SIZE, average: int = AVG_SIZE, most: int = MAX_SIZE
) -> DataFrame:
    """Chunks ``(ident, ordinal, file_offset, length, hash)`` of files read from where they are, in order.

    The cuts are those of ``content_chunks``. A file is one task's sequential work in
    constant memory; a file that can't be opened makes the job fail. Null places give nothing.
    """
    fields = f"{ident} bigint, ordinal bigint, file_offset bigint, length bigint, hash binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.binary()]
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            cols = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in fields.split(", ")])

        for b in batches:
            for key, place in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k, (at, piece) in enumerate(cut_stream(_blocks(place), least, average, most)):
                    rows.append((key, k, at, len(piece), hashlib.sha256(piece).digest()))
                    if len(rows) >= 4096:
                        yield made()
            if rows:
                yield made()

    spread = files.where(F.col(uri).isNotNull()).select(F.col(ident).cast("bigint"), F.col(uri))
    return spread.mapInArrow(run, fields)


def read_slices(places: DataFrame, key: str, uri: str, offset: str, length: str) -> DataFrame:
    """``(key, bytes, error)`` of slices of files; the SHA-256 of a slice must be its key.

    ``error`` is ``Missing`` where the file is gone, ``Corrupt`` where it is too short or
    the bytes have changed, else null; only good slices have bytes. A null place is
    missing. Slices of a file are read in order; the file stays open meanwhile.
    """
    asked = places.select(F.col(uri).alias("uri"), F.col(offset).cast("bigint").alias("at"), F.col(length).cast("bigint").alias("n"), F.col(key).cast("binary").alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_uri, source = None, None
        for b in batches:
            made, held = [], 0
            for place, at, n, want in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if source is None or place != open_uri:
                    if source is not None:
                        source.close()
                    open_uri, source = place, None
                    if place is not None:
                        system, path = open_place(place)
                        try:
                            source = system.open_input_file(path)
                        except (FileNotFoundError, IsADirectoryError):
                            source = None
                if source is None or at is None or n is None:
                    made.append((want, None, "Missing"))
                    continue
                whole = 0 <= at and 0 <= n and at + n <= source.size()
                got = source.read_at(n, at) if whole else b""
                good = whole and hashlib.sha256(got).digest() == want
                made.append((want, got if good else None, None if good else "Corrupt"))
                held += n if good else 0
                if held >= BUFFER:
                    yield _slices(made)
                    made, held = [], 0
            if made:
                yield _slices(made)
        if source is not None:
            source.close()

    ordered = asked.repartition("uri", F.floor(F.col("at") / (32 * BUFFER))).sortWithinPartitions("uri", "at")
    return ordered.mapInArrow(run, "key binary, bytes binary, error string").withColumnRenamed("key", key)


def _slices(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "bytes", "error"])


def write_files(parts: DataFrame, folder: str, path: str = "path", order: str = "ordinal", data: str = "data") -> None:
    """Write files below ``folder`` from their pieces in order; unsafe paths make the job fail before any write.

    A task holds one piece. A file is written aside and moved, so a task that runs
    twice does no harm. A piece without bytes makes an empty file, if it's the only one.
    """
    if bad := parts.where(unsafe_path(path)).select(path).take(1):
        raise ValueError(f"unsafe path: {bad[0][0]!r}")

    def put(rows: Iterator) -> None:
        from pyspark import TaskContext

        system, base = open_place(folder)
        mark, now, out, made = f".tmp.{TaskContext.get().taskAttemptId()}", None, None, set()

        def done() -> None:
            if out is not None:
                out.close()
                system.move(now + mark, now)

        for row in rows:
            target = "/".join([base.rstrip("/"), *row[0].split("/")])
            if target != now:
                done()
                parent = target.rpartition("/")[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                now, out = target, system.open_output_stream(target + mark)
            out.write(bytes(row[1] or b""))
        done()

    slim = parts.select(F.col(path).alias("p"), F.col(order).alias("o"), F.col(data).cast("binary").alias("d"))
    slim.repartition("p").sortWithinPartitions("p", "o").select("p", "d").foreachPartition(put)
