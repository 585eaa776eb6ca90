"""Positions of a day before the opening: a replay of statements, and the cost that the opening's lots were reconciled to."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.values import half_up

#: Statement classes that move a position.
MOVES = ("BUY", "SELL", "BONUS", "SPLIT", "RIGHT")
#: How far a replayed basis may be from the reconciled one and still be the same.
NEAR = 0.02


def adopted(replayed: DataFrame, opening: DataFrame, statement: DataFrame, by: list[str], day: datetime.date) -> DataFrame:
    """(by, qty, avg_cost, invested, how) of the positions ``replayed`` (by, qty, avg_cost) up to ``day``, with the cost of
    ``opening`` (by, acquired, qty, cost_per_share), the lots that were left at a later date and agree with the broker.

    A key that nothing moved since ``day`` (no row of ``statement`` (by, at, kind) behind it, no lot acquired later) is
    ``settled``: quantity and cost are the opening's. A key that moved keeps its replayed quantity; what was invested is the
    opening's if the two agree within NEAR (``near``), as splits change shares but not what they cost, else the replay's
    (``replayed``). Lots without cost count, a key without lots does not. Keys without a position are left out."""
    lots = opening.groupBy(*by).agg(F.sum(F.col("qty") * F.col("cost_per_share")).alias("__invested"), F.sum("qty").alias("__qty"), F.bool_or(F.col("acquired") > F.lit(day)).alias("__later"))
    moved = statement.filter((F.col("at") > F.lit(day)) & F.col("kind").isin(*MOVES)).select(*by).distinct().withColumn("__moved", F.lit(True))
    rows = replayed.filter("qty > 1e-9").join(lots, by, "left").join(moved, by, "left")
    known = F.coalesce(F.col("__qty") > 0, F.lit(False))
    settled = known & F.col("__moved").isNull() & ~F.coalesce("__later", F.lit(False))
    near = known & (F.abs(F.col("qty") * F.col("avg_cost") - F.col("__invested")) <= F.col("__invested") * NEAR)
    how = F.when(settled, "settled").when(near, "near").otherwise("replayed")
    qty = F.when(settled, F.col("__qty")).otherwise(F.col("qty"))
    invested = F.when(how == "replayed", F.col("qty") * F.col("avg_cost")).otherwise(F.col("__invested"))
    return rows.select(*by, qty.alias("qty"), half_up(invested / qty, 4).alias("avg_cost"), half_up(invested).alias("invested"), how.alias("how"))
