"""Derived tables that are replaced as a whole while others read them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.session import remove_path

CURRENT = "_current"


def replace(rows: DataFrame, path: str, keep: int = 2) -> None:
    """Put ``rows`` in the place of the table at ``path``. The new version is written beside the old ones; one small file
    that names it appears when it is whole, so that a reader sees either version, never parts of two, and a job that
    fails leaves the old one. The last ``keep`` versions stay for readers that have begun."""
    spark, name = rows.sparkSession, f"v{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{name}")
    known = _versions(spark, path)
    number = max(known, default=0) + 1
    # The mark's own folder is renamed into place by Spark's committer when its one file is complete.
    spark.createDataFrame([(number, name)], "number bigint, name string").coalesce(1).write.json(f"{path}/{CURRENT}/n={number}")
    for old in sorted(known)[: -keep or None] if len(known) >= keep else []:
        remove_path(spark, f"{path}/{known[old]}")
        remove_path(spark, f"{path}/{CURRENT}/n={old}")


def _versions(spark: SparkSession, path: str) -> dict[int, str]:
    """number -> folder of the versions that are complete; as few as replace() keeps."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/{CURRENT}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return {}
    marks = spark.read.schema("number bigint, name string").option("recursiveFileLookup", True).json(f"{path}/{CURRENT}")
    return {r["number"]: r["name"] for r in marks.filter("name is not null").collect()}


def read(spark: SparkSession, path: str) -> DataFrame:
    """The last complete version of the table at ``path``."""
    known = _versions(spark, path)
    if not known:
        raise ValueError(f"no table at {path}")
    return spark.read.parquet(f"{path}/{known[max(known)]}")


def without(table: DataFrame, gone: DataFrame, key: list[str], back: DataFrame | None = None) -> DataFrame:
    """``table`` without the keys of ``gone``; rows of ``back`` are put back where the key is free. Nulls in a key are
    values like any other."""
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in key]
    lost = gone.select(*(F.col(c).alias(c) for c in key)).distinct()
    kept = table.join(lost, same(table, lost), "left_anti")
    if back is None:
        return kept
    have = kept.select(*(F.col(c).alias(c) for c in key)).distinct()
    return kept.unionByName(back.join(have, same(back, have), "left_anti"))
