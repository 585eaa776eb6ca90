"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it has more than 1/HOT_SHARE of the rows, so there are fewer than HOT_SHARE hot keys: a
#: bound on what is broadcast that no data can break.
HOT_SHARE = 2000
SALTS = 64


def hot_keys(counts: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """The keys of ``counts`` (key columns and row count ``n``) with over 1/HOT_SHARE of ``total`` rows."""
    return counts.filter(F.col(n) > max(50, total // HOT_SHARE)).select(*on)


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """Equi-join of ``left``, where keys may be hot, with ``right``, which has few rows a key.

    Hot keys (fewer than HOT_SHARE, so they can be broadcast) are spread over SALTS partitions: their rows in
    ``left`` get a salt, their rows in ``right`` are repeated for every salt. All other keys join unsalted.
    ``how`` is ``inner`` or ``left``. ``hot`` may be given if the key counts are known; otherwise ``left`` is
    counted, and should be cheap to read twice. Null keys match nothing, as in SQL.
    """
    if hot is None:
        counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
        hot = hot_keys(counts, on, "__n", left.count())
    hot = F.broadcast(hot.select(*on).withColumn("__hot", F.lit(True)))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    salted = left.join(hot, on, "left").withColumn("__salt", F.when(F.col("__hot"), salt).otherwise(F.lit(0))).drop("__hot")
    every = F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    spread = right.join(hot, on, "left").withColumn("__salt", every).drop("__hot")
    return salted.join(spread, [*on, "__salt"], how).drop("__salt")


def apart(key: Column, *columns: str) -> Column:
    """The text ``key`` of a left join's left side, or where it is null one that no row has on the other side, by the
    row's ``columns``: rows without a key find nothing, and would otherwise meet in one task."""
    return F.coalesce(key, F.concat(F.lit("\u0000"), F.xxhash64(*columns)))
