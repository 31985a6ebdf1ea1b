"""Exactly one copy of messages that were delivered at least once.

A store keeps one winner per message in partitions (by day of receipt). A merge

1. finds, through an index from identifier hash to partition, the historical
   partitions that hold any incoming identifier,
2. combines only those with the incoming rows,
3. recomputes one winner per identifier, the row with the lowest order value,
4. writes the new partitions into a folder of this attempt's own name and commits
   them with one rename of a manifest that must not exist yet; untouched partitions
   keep their files.

A merge that dies before its commit leaves a folder that no manifest names; it hinders
nothing and ``sweep`` removes it, as it removes replaced partitions. Of two merges that
started from the same version the second to commit raises ``Conflict`` and changes
nothing. The rename without overwriting is atomic on HDFS and the like; an object
store needs a committer that refuses to overwrite.

The identifier index is a separate narrow data set of the same partitions.
Winners are found with a partially aggregated minimum, so a message that makes up
a third of the table is reduced before the shuffle. Index hash collisions can only
name a partition too many; winners compare a SHA-256 of the whole identifier.

Defined results: rows with a null in any identifier column can't be recognised and
are all kept; equal order values can't occur (the order column must be unique);
rows repeated under a new order value are surplus; an empty batch commits nothing.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from chunkloom.functions.keys import identity_digest

DIGEST, INDEX_HASH, PART = "digest", "ident64", "part"
#: Stored rows: the whole message is one struct, so its column names can't clash with these.
ORDER, ROW = "ord", "message"


class _Files:
    """The few file-system calls a commit needs, on whatever Hadoop file system the path names."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._jvm = spark, spark._jvm
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_once(self, path: str, text: str) -> None:
        """Write aside under a name of its own, then rename: readers see the whole file or none; a second writer fails."""
        aside = f"{path}.{uuid.uuid4().hex}.tmp"
        out = self._fs.create(self._path(aside), False)
        out.write(bytearray(text.encode()))
        out.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self._spark.sparkContext._gateway.new_array(options, 1)
        how[0] = options.NONE  # fails where the target exists
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(path).toUri(), self._spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._path(aside), self._path(path), how)
        except Py4JJavaError as e:
            self._fs.delete(self._path(aside), False)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                raise Conflict(f"{path}: another merge was committed meanwhile") from None
            raise

    def delete_older(self, path: str, before_ms: int) -> bool:
        """Delete a file or folder unless it was changed at or after ``before_ms``."""
        p = self._path(path)
        if not self._fs.exists(p) or self._fs.getFileStatus(p).getModificationTime() >= before_ms:
            return False
        return self._fs.delete(p, True)


class Conflict(RuntimeError):
    """Another merge was committed since this one read the store; nothing was changed, the batch can be merged again."""


class MessageStore:
    """A partitioned store of single winners, see the module's text."""

    def __init__(self, spark: SparkSession, root: str, order: str):
        self.spark, self.root, self.order, self._files = spark, root, order, _Files(spark, root)

    def snapshot(self) -> dict:
        """``{"version": n, "parts": {partition: [version folders]}, "schema": json}`` of the last commit."""
        names = [n for n in self._files.names(f"{self.root}/manifests") if n.endswith(".json")]
        if not names:
            return {"version": 0, "parts": {}, "schema": None}
        return json.loads(self._files.read(f"{self.root}/manifests/{names[-1]}"))

    def _read(self, kind: str, snap: dict, parts: list[str] | None = None) -> DataFrame | None:
        chosen = [
            f"{self.root}/{kind}/{v}/{PART}={p}" for p, vs in snap["parts"].items() if parts is None or p in parts for v in vs
        ]
        if not chosen:
            return None
        return self.spark.read.option("basePath", f"{self.root}/{kind}").schema(T.StructType.fromJson(snap[kind])).parquet(*chosen).drop("__v")

    def rows(self) -> DataFrame | None:
        """The current winners; None before the first commit of a row."""
        df = self._read("data", self.snapshot())
        return df if df is None else df.select(f"{ROW}.*")

    def affected(self, incoming: DataFrame, snap: dict | None = None) -> list[str]:
        """Partitions that hold an identifier of ``incoming``: one entry per partition at most."""
        index = self._read("index", snap or self.snapshot())
        if index is None:
            return []
        asked = incoming.select(INDEX_HASH).where(F.col(INDEX_HASH).isNotNull()).distinct()
        return sorted(str(r[0]) for r in index.join(asked, INDEX_HASH, "left_semi").select(PART).distinct().collect())

    def merge(self, batch: DataFrame, identifier: list[Column], partition: Column, keep: list[str] | None = None) -> list[str]:
        """Take in a batch; returns the historical partitions that were overwritten.

        ``partition`` must be an integer column without nulls. The columns ``keep``
        (default: all) of winners are stored.
        """
        snap = self.snapshot()
        payload = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.struct("*")
        incoming = batch.select(
            F.col(self.order).alias(ORDER), payload.alias(ROW), identity_digest(*identifier).alias(DIGEST), partition.cast("int").alias(PART)
        ).select("*", F.when(F.col(DIGEST).isNotNull(), F.xxhash64(DIGEST)).alias(INDEX_HASH))
        hit = self.affected(incoming, snap)
        known, unknown = incoming.where(F.col(DIGEST).isNotNull()), incoming.where(F.col(DIGEST).isNull())
        if (history := self._read("data", snap, hit)) is not None:
            known = known.unionByName(history.where(F.col(DIGEST).isNotNull()))
            unknown = unknown.unionByName(history.where(F.col(DIGEST).isNull()))
        kept = self._winners(known, slim=keep == [self.order]).unionByName(unknown)
        version = f"__v={snap['version'] + 1:08d}-{uuid.uuid4().hex}"
        # AQE splits a large partition and joins small ones: no task gets a whole hot day
        kept.hint("rebalance", PART).write.partitionBy(PART).parquet(f"{self.root}/data/{version}")
        new = [n.partition("=")[2] for n in self._files.names(f"{self.root}/data/{version}") if "=" in n]
        if not new and not hit:
            return []
        index = T.StructType([T.StructField(INDEX_HASH, T.LongType()), T.StructField(PART, T.IntegerType())])
        schema = {"data": kept.schema.jsonValue(), "index": index.jsonValue()}
        if new:
            written = self.spark.read.option("basePath", f"{self.root}/data/{version}").schema(kept.schema).parquet(f"{self.root}/data/{version}")
            written.where(F.col(INDEX_HASH).isNotNull()).select(INDEX_HASH, PART).write.partitionBy(PART).parquet(f"{self.root}/index/{version}")
        indexed = {n.partition("=")[2] for n in self._files.names(f"{self.root}/index/{version}")}
        for p in set(new) - indexed:  # a partition of unrecognisable rows only: an empty index folder
            self._files._fs.mkdirs(self._files._path(f"{self.root}/index/{version}/{PART}={p}"))
        parts = {p: vs for p, vs in snap["parts"].items() if p not in hit}
        for p in new:
            parts[p] = parts.get(p, []) + [version]
        text = json.dumps({"version": snap["version"] + 1, "parts": parts} | schema)
        self._files.write_once(self._manifest(snap["version"] + 1), text)
        return hit

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifests/{version:08d}.json"

    def sweep(self, keep: int = 2, grace_s: float = 86_400) -> list[str]:
        """Delete what the last ``keep`` versions don't name and nobody touched for ``grace_s`` seconds; returns the paths.

        The grace time spares merges under way and readers of older versions.
        """
        names = [n for n in self._files.names(f"{self.root}/manifests") if n.endswith(".json")]
        before = int((time.time() - grace_s) * 1000)
        used = {(v, p) for n in names[-keep:] for p, vs in json.loads(self._files.read(f"{self.root}/manifests/{n}"))["parts"].items() for v in vs}
        old = [f"{self.root}/manifests/{n}" for n in self._files.names(f"{self.root}/manifests") if n.endswith(".tmp") or n in names[:-keep]]
        for kind in ("data", "index"):
            for v in self._files.names(f"{self.root}/{kind}"):
                folder = f"{self.root}/{kind}/{v}"
                if not any(u[0] == v for u in used):
                    old.append(folder)
                    continue
                old += [f"{folder}/{n}" for n in self._files.names(folder) if "=" in n and (v, n.partition("=")[2]) not in used]
        return [p for p in old if self._files.delete_older(p, before)]

    def _winners(self, pool: DataFrame, slim: bool) -> DataFrame:
        if slim:  # nothing but fixed-width columns: one hash aggregate with map-side combine
            least = pool.groupBy(DIGEST).agg(F.min(ORDER).alias(ORDER), F.min_by(PART, ORDER).alias(PART), F.min(INDEX_HASH).alias(INDEX_HASH))
            return least.select(ORDER, F.struct(F.col(ORDER).alias(self.order)).alias(ROW), DIGEST, PART, INDEX_HASH)
        least = pool.groupBy(DIGEST).agg(F.min(ORDER).alias(ORDER)).select(ORDER)
        return pool.join(least, ORDER, "left_semi")


def merge_in_waves(store: MessageStore, rows: DataFrame, identifier: list[Column], partition: Column, waves: int, keep: list[str] | None = None) -> None:
    """Feed a whole table through ``merge`` in ``waves`` consecutive ranges of the order column."""
    low, high = rows.agg(F.min(store.order), F.max(store.order)).first()
    if low is None:
        return
    width = max(1, -(-(high - low + 1) // waves))
    for start in range(low, high + 1, width):
        store.merge(rows.where(F.col(store.order).between(start, min(start + width - 1, high))), identifier, partition, keep)


def surplus(rows: DataFrame, store: MessageStore, identifier: list[Column]) -> DataFrame:
    """Order values of recognisable rows that aren't winners in the store."""
    any_null = identifier[0].isNull()
    for c in identifier[1:]:
        any_null = any_null | c.isNull()
    known = rows.where(~any_null).select(store.order)
    kept = store.rows()
    return known if kept is None else known.join(kept.select(store.order), store.order, "left_anti")
