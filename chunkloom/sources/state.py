"""Small state tables (ledger, receipt bag, mappings) saved whole and read back; a save is seen whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, p: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(p)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, folder: str) -> list[str]:
    path, fs = _path(spark, folder)
    if not fs.exists(path):
        return []
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(path)) if n.startswith("v"))


def _commit(df: DataFrame, folder: str, part: str) -> list[str]:
    """Write aside under a name of its own, then rename to the next version; returns the versions before."""
    spark = df.sparkSession
    old = _versions(spark, folder)
    number = int(old[-1][1:10]) + 1 if old else 1
    aside = f"{folder}/_tmp-{uuid.uuid4().hex}"
    df.write.parquet(aside)
    source, fs = _path(spark, aside)
    if not fs.rename(source, _path(spark, f"{folder}/v{number:09d}{part}")[0]):
        raise RuntimeError(f"{folder}: saving failed")
    return old


def save_state(df: DataFrame, folder: str) -> None:
    """Save the whole table as the next version; the last whole one before and its parts are kept, older ones are deleted."""
    old = _commit(df, folder, "")
    wholes = [n for n in old if not n.endswith("p")]
    for name in old:
        if wholes and name < wholes[-1]:
            path, fs = _path(df.sparkSession, f"{folder}/{name}")
            fs.delete(path, True)


def save_part(df: DataFrame, folder: str) -> None:
    """Save rows that add to the last whole table and the parts since."""
    _commit(df, folder, "p")


def _current(spark: SparkSession, folder: str) -> list[str]:
    """The last whole version and the parts saved after it."""
    names = _versions(spark, folder)
    wholes = [i for i, n in enumerate(names) if not n.endswith("p")]
    return names[wholes[-1] if wholes else 0 :]


def parts_since_whole(spark: SparkSession, folder: str) -> int:
    return sum(n.endswith("p") for n in _current(spark, folder))


def load_state(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The last saved table with the parts saved since; an empty one before the first save."""
    names = _current(spark, folder)
    return spark.read.schema(schema).parquet(*(f"{folder}/{n}" for n in names)) if names else spark.createDataFrame([], schema)
