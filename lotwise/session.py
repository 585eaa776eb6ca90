"""Session helpers: a local session for tests and benches, and the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", name: str = "lotwise", memory: str = "8g") -> SparkSession:
    """A local session with AQE, UTC and few shuffle partitions."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, a local session makes a
    temporary folder once and sets it as the checkpoint folder; on a cluster that is an error, as every host would write
    to a folder of its own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lotwise-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder."""
    return f"{shared_dir(spark)}/lotwise-{name}-{uuid.uuid4().hex[:12]}"


#: Where written() put a table, and the paths of each open temporary() block, innermost last.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that written() makes within the block are deleted when it ends, but for those that outlive it. What is
    built on them must have been written by then."""
    own: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), own))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in own:
            remove_path(spark, path)


#: Bytes of Arrow data that Spark sends to a Python task at once while one of our tables is written.
BATCH_BYTES = 8 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Small Arrow batches for what runs within the block; the caller's setting is back behind it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def written(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut there, lost executors don't matter, and
    what reads it twice computes it once. It belongs to the innermost temporary() block or, if it ``outlives`` that, to
    the one around; without a block it stays."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    scopes = _SCOPES.get()[: -1 if outlives else None]
    if scopes:
        scopes[-1].append(path)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() made and that nothing will read again."""
    for table in tables:
        remove_path(table.sparkSession, _PATHS.pop(table))


def release_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps: Spark deletes them when the driver's garbage collector finds
    that nothing refers to them, which a driver with little to do may not run for half an hour."""
    gc.collect()
    spark._jvm.System.gc()


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a table of ours that nothing will read again."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


__all__ = ["discard", "fresh_path", "local_session", "release_shuffles", "remove_path", "shared_dir", "temporary", "written"]
