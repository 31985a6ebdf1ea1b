"""Session, table and scratch-space helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "chunkloom", master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE on)."""
    cores = "".join(c for c in master if c.isdigit()) or "8"
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@lru_cache
def _shipped(app: str) -> str:
    """A zip of this package's sources, made once per application."""
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="chunkloom-code-"), "chunkloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.relpath(full, os.path.dirname(package)))
    return path


def ship_code(spark: SparkSession) -> None:
    """Give the package to Python workers that couldn't import it otherwise, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        spark.sparkContext.addPyFile(_shipped(app))


_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table (a file or a folder of files) of a data set."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


@lru_cache
def _own_base(app: str) -> str:
    """One temporary folder per application, for tests."""
    return "file://" + tempfile.mkdtemp(prefix=f"chunkloom-{app}-")


def _setting(spark: SparkSession) -> str | None:
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Clusters name a folder there that all executors reach; where it is unset they get
    an error, not a folder of one machine. Only local sessions, as in tests, get a
    temporary folder of their own.
    """
    base = _setting(spark)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        base = _own_base(spark.sparkContext.applicationId)
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jvm_path)
    fs.deleteOnExit(jvm_path)  # results may still be read until the driver ends
    return path


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Cut the lineage: write ``df`` as parquet to the shared folder, read it back.

    The files outlive lost executors, unlike cached blocks.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
