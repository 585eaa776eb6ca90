"""Set operations and merges of tables: bag difference, slices, upserts with precedence."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.values import statement_class


def bag_difference(incoming: DataFrame, existing: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of ``incoming`` without their n first for each key that ``existing`` has n times. Nulls in a key are values
    like any other."""
    have = existing.groupBy(*(F.col(c).alias(f"__{c}") for c in key)).agg(F.count(F.lit(1)).alias("__have"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    same = functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key))
    rows = incoming.withColumn("__nth", nth).join(have, same, "left").filter(F.col("__nth") > F.coalesce("__have", F.lit(0)))
    return rows.select(*incoming.columns)


def union_by_signature(held: DataFrame, incoming: DataFrame, sign: list[str]) -> DataFrame:
    """(sign, is_new, skipped): every signature once, whatever side has it and how often; is_new where ``held`` lacks it,
    skipped the rows of ``incoming`` that add nothing, so that uploading a report again adds no row. Nulls in a signature
    are values like any other; nothing but counts of a signature is gathered."""
    rows = held.select(*sign, F.lit(0).alias("__in")).unionByName(incoming.select(*sign, F.lit(1).alias("__in")))
    out = rows.groupBy(*sign).agg(F.min("__in").alias("__first"), F.sum("__in").alias("__n"))
    is_new = F.col("__first") == 1
    return out.select(*sign, is_new.alias("is_new"), (F.col("__n") - is_new.cast("bigint")).alias("skipped"))


def statement_key(kind: Column, qty: Column, price: Column) -> list[Column]:
    """What tells statement rows of a day apart: class, quantity to six places, price to four."""
    return [statement_class(kind).alias("class"), F.floor(qty * 1e6 + 0.5).alias("qty6"), F.floor(price * 1e4 + 0.5).alias("price4")]


def replace_slice(existing: DataFrame, incoming: DataFrame, day: str) -> DataFrame:
    """``incoming`` replaces all rows between its first and last day; with no rows it replaces nothing."""
    ends = incoming.agg(F.min(day).alias("__a"), F.max(day).alias("__b"))  # one row
    kept = existing.join(F.broadcast(ends), F.col(day).between(F.col("__a"), F.col("__b")), "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def upsert_prices(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, price, price_date, previous_price): the later price wins; on a new day the old one becomes the
    previous."""
    o = old.select(*key, F.col("price").alias("op"), F.col("price_date").alias("od"), F.col("previous_price").alias("pp"))
    n = new.select(*key, F.col("price").alias("np"), F.col("price_date").alias("nd"))
    take = F.col("np").isNotNull() & (F.col("od").isNull() | (F.col("nd") >= F.col("od")))
    prev = F.when(take & (F.col("nd") > F.col("od")), F.col("op")).otherwise(F.col("pp"))
    return o.join(n, key, "full").select(*key, F.when(take, F.col("np")).otherwise(F.col("op")).alias("price"), F.when(take, F.col("nd")).otherwise(F.col("od")).alias("price_date"), prev.alias("previous_price"))


def merge_history(old: DataFrame, new: DataFrame, key: list[str], mode: str = "fill") -> DataFrame:
    """(key, close): ``fill`` keeps what is there, ``overwrite`` prefers the new close."""
    o, n = old.select(*key, F.col("close").alias("oc")), new.select(*key, F.col("close").alias("nc"))
    pick = F.coalesce("oc", "nc") if mode == "fill" else F.coalesce("nc", "oc")
    return o.join(n, key, "full").select(*key, pick.alias("close"))


def unmatched_within(left: DataFrame, right: DataFrame, by: list[str], day: str, other: str, days: int = 21) -> DataFrame:
    """Rows of ``left`` for which ``right`` has no row of the key within ``days`` of their day. Days are put in
    buckets of ``days``, so that a key's rows meet in three buckets instead of all at once."""
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / days)
    r = right.select(*by, F.col(other).alias("__o"), F.explode(F.sequence(bucket(other) - 1, bucket(other) + 1)).alias("__k"))
    l_ = left.withColumn("__k", bucket(F.col(day)))
    on = [l_[c] == r[c] for c in by] + [l_["__k"] == r["__k"], F.abs(F.datediff(l_[day], r["__o"])) <= days]
    return l_.join(r, on, "left_anti").drop("__k")
