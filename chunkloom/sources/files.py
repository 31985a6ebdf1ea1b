"""Reading and writing files of the store: trees, containers, torrents, index lines, request lines, reports."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chunkloom.operators.bridge import read_metainfo
from chunkloom.operators.manifest import decode_containers, unsafe_path
from chunkloom.operators.protocol import parse_requests
from chunkloom.operators.store import index_line, parse_index_lines, parse_reference_lines, reference_line
from chunkloom.sources.streams import listing


def scan_tree(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, size, data)`` of all files below a folder; paths are relative with ``/``; order by ``path`` as bytes.

    Sizes come from the listing; bytes are read only if asked for. A file is one row,
    so it may have 2 GB at most.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    relative = F.ltrim(F.substring(F.regexp_replace("path", "^file:/+", "file:/"), len(root) + 1, 2147483647), F.lit("/"))
    some = files.select(relative.alias("path"), F.col("length").alias("size"), F.col("content").alias("data"))
    # the binary source leaves files without bytes out
    empty = spark.createDataFrame([(p, 0, b"") for p, _, size in listing(folder) if size == 0], "path string, size bigint, data binary")
    return some.unionByName(empty)


def read_containers(spark: SparkSession, folder: str, pattern: str = "*.cklm") -> DataFrame:
    """Manifests of all container files, unreadable ones with ``error``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return decode_containers(files, "path", "content")


def read_torrents(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.torrent").option("recursiveFileLookup", "true").load(folder)
    return read_metainfo(files, "path", "content")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The pack index from its tab-separated lines; torn lines are skipped, the last line of a hash wins.

    Lines are ordered by the time their file was written, its name, and the place in the file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_modification_time").alias("m"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return parse_index_lines(lines.withColumn("at", F.struct("m", "f", "b", "i")), "value", "at")


def append_index(rows: DataFrame, path: str) -> None:
    """Append lines for ``(hash, pack_id, pack_offset, length)``; each job adds files of whole lines."""
    line = index_line(F.lower(F.hex("hash")), F.col("pack_id"), F.col("pack_offset"), F.col("length"))
    rows.select(line.alias("value")).write.mode("append").text(path)


def append_references(rows: DataFrame, path: str) -> None:
    """Append lines for ``(hash, uri, offset, length)``: chunks that stay in their source files."""
    line = reference_line(F.lower(F.hex("hash")), F.col("offset"), F.col("length"), F.col("uri"))
    rows.select(line.alias("value")).write.mode("append").text(path)


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """``(hash, offset, length, path)`` of the lines of referenced chunks, ordered as in ``read_index``."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_modification_time").alias("m"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return parse_reference_lines(lines.withColumn("at", F.struct("m", "f", "b", "i")), "value", "at")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Parsed request lines (see ``parse_requests``); empty lines are left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return parse_requests(lines.select("value"), "value")


def write_tree(files: DataFrame, folder: str, path: str = "path", data: str = "data") -> None:
    """Write each file below ``folder``; unsafe paths make the job fail before any write.

    ``folder`` is a URI of a file system that pyarrow knows (hdfs, s3, gs, file) or a
    plain path that all executors share. A file is written aside and moved, so a task
    that runs twice does no harm.
    """
    bad = files.where(unsafe_path(path)).select(path).take(1)
    if bad:
        raise ValueError(f"unsafe path: {bad[0][0]!r}")

    def put(rows: Iterator) -> None:
        from pyarrow import fs
        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))
        made = set()
        for row in rows:
            target = "/".join([base.rstrip("/"), *row[0].split("/")])
            parent = target.rpartition("/")[0]
            if parent not in made:
                system.create_dir(parent, recursive=True)
                made.add(parent)
            aside = f"{target}.tmp.{TaskContext.get().taskAttemptId()}"
            with system.open_output_stream(aside) as out:
                out.write(bytes(row[1] or b""))
            system.move(aside, target)

    files.select(F.col(path), F.col(data).cast("binary")).foreachPartition(put)


def write_report(report: DataFrame, folder: str) -> None:
    """Report rows as CSV with a header."""
    report.orderBy("experiment", "metric").coalesce(1).write.mode("overwrite").option("header", "true").csv(folder)


def manifest_listing(name: Column, total: Column, n_files: Column, n_chunks: Column, root: Column) -> Column:
    """The lines that describe a manifest."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit("-"))) for k, v in (("name", name), ("size", total), ("files", n_files), ("chunks", n_chunks), ("root", root))))
