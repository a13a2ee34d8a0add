"""Session helpers: a local session for tests and bench, and lineage cuts."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: str | int = "*", app: str = "evidentia", **conf: str) -> SparkSession:
    """A session for tests and bench runs. On a cluster, pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: the session's checkpoint folder.

    Only a session of one process that names none (tests) gets a temporary one, which goes when that process
    ends; on a cluster, local ones of several processes included, the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="evidentia-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place among the application's intermediate tables."""
    return os.path.join(shared_dir(spark), f"evidentia-{spark.sparkContext.applicationId}", f"{name}-{uuid.uuid4().hex}")


def release(spark: SparkSession) -> None:
    """Delete the application's intermediate tables. Frames and models that were made from them can't be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.dirname(scratch_path(spark, "")))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Keep ``df`` as a table in the shared folder and read it from there.

    Survives the loss of executors, is computed once (an eager ``checkpoint`` runs its last stage
    twice) and tells the optimizer the real size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go as soon as their query has ended, not when the driver next frees memory."""
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, before)


def kept_table(df: DataFrame) -> tuple[DataFrame, str]:
    """``cut_lineage`` for tables of as many rows as the data: packed closer, without the shuffle files it was made from, and with its path for ``discard``."""
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    with passing_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
