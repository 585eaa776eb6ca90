"""Which price, industry or exception belongs to a holding, and how a report says where its prices come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.values import norm_name
from lotwise.operators import prices
from lotwise.operators.skew import apart


def last_of(rows: DataFrame, key: Column, value: str, order: str) -> DataFrame:
    """(slot, value): the last value of each key that is there."""
    return rows.withColumn("slot", key).filter("slot is not null and slot <> ''").groupBy("slot").agg(F.max_by(value, order).alias("value"))


def owns_name(slots: DataFrame | None, rows: DataFrame) -> DataFrame:
    """``rows`` (k, name, ...) with ``norm`` and whether that name is no other entry's; without ``slots``, rows have
    (norm, owner) as identity.resolve() gives them."""
    out = rows if slots is None else rows.withColumn("norm", norm_name(F.col("name"))).join(slots.select("norm", F.col("k").alias("owner")), "norm", "left")
    return out.withColumn("own", F.col("owner").isNull() | F.col("k").isNull() | (F.col("owner") == F.col("k"))).drop("owner")


def by_identity(holdings: DataFrame, facts: DataFrame, slots: DataFrame | None, value: str, order: str) -> DataFrame:
    """``holdings`` (k, isin, name, ...) with ``found``, the value that ``facts`` (k, isin, name, value, order) has for
    the entry, else for the ISIN, else for the name, where neither side uses a name that is another entry's. Without
    ``slots`` both have (norm, owner) instead."""
    f = owns_name(slots, facts)
    h = owns_name(slots, holdings)
    columns = h.columns
    for i, (theirs, ours) in enumerate(((F.col("k").cast("string"), F.col("k").cast("string")), (F.upper("isin"), F.upper("isin")), (F.when(F.col("own"), F.col("norm")), F.when(F.col("own"), F.col("norm"))))):
        h = h.withColumn("slot", apart(ours, *columns)).join(last_of(f, theirs, value, order).withColumnRenamed("value", f"__{i}"), "slot", "left").drop("slot")
    return h.withColumn("found", F.coalesce("__0", "__1", "__2")).drop("__0", "__1", "__2", "norm", "own")


def priced(holdings: DataFrame, prices: DataFrame, slots: DataFrame | None) -> DataFrame:
    """``holdings`` (k, isin, name, asset_class, valuation, last_trade) with ``price``: a quote above zero by identity;
    for securities of a class that is not listed, else their valuation, else what they last traded at."""
    out = by_identity(holdings, prices.filter("price > 0"), slots, "price", "row")
    fair = F.when(F.col("asset_class").isNotNull(), F.coalesce(F.when(F.col("valuation") > 0, F.col("valuation")), F.when(F.col("last_trade") > 0, F.col("last_trade"))))
    return out.withColumn("price", F.coalesce("found", fair)).drop("found")


def flagged(holdings: DataFrame, flags: DataFrame, slots: DataFrame | None) -> DataFrame:
    """``holdings`` with ``flagged``: whether any identity of theirs (ISIN, own name, entry) carries a flag."""
    f = owns_name(slots, flags)
    every = [F.concat(F.lit("isin:"), F.upper("isin")), F.when(F.col("own"), F.concat(F.lit("name:"), "norm")), F.concat(F.lit("key:"), F.col("k").cast("string"))]
    marks = f.select(F.explode(F.array(*every)).alias("mark")).filter("mark is not null").distinct()
    h = owns_name(slots, holdings).withColumn("marks", F.array_compact(F.array(*every)))
    hit = h.select(F.col("id"), F.explode("marks").alias("mark")).join(marks, "mark", "left_semi").select("id").distinct().withColumn("flagged", F.lit(True))
    return holdings.join(hit, "id", "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))


def session_prices(asks: DataFrame, grid: DataFrame, most: int = 7) -> DataFrame:
    """``asks`` (key, day, ...) with (session, price, carried, miss) from closes (key, session, close): the last close at
    most ``most`` sessions of the whole grid before the last session up to the day. miss: ``no-column`` for a key the
    grid does not have, ``before-history`` for a day before its first session, else ``no-close``."""
    days = grid.select("session").distinct()
    line = Window.orderBy("session")  # one row for each session of the grid
    idx = days.withColumn("idx", F.row_number().over(line))
    one = F.lit(0).alias("one")
    # The last session up to each distinct day, by one sort of days and sessions.
    reached = prices.as_of(asks.select("day", one).distinct(), idx.select(one, F.col("session").alias("__from"), F.col("idx").alias("at")), ["one"], "day", "__from", "at").select("day", "at")
    at = asks.join(reached, "day", "left")
    closes = grid.filter("close is not null").join(idx, "session")
    reach = closes.select("key", "session", "close", "idx", F.explode(F.sequence(F.col("idx"), F.col("idx") + most)).alias("at"))
    best = reach.groupBy("key", "at").agg(F.max(F.struct("idx", "session", "close")).alias("c"))
    keys = grid.select("key").distinct().withColumn("known", F.lit(True))
    out = at.join(best, ["key", "at"], "left").join(keys, "key", "left")
    miss = F.when(F.col("known").isNull(), "no-column").when(F.col("at").isNull(), "before-history").when(F.col("c").isNull(), "no-close").otherwise("")
    ok = miss == ""
    return out.select(*asks.columns, F.when(ok, F.col("c.session")).alias("session"), F.when(ok, F.col("c.close")).alias("price"), F.when(ok, F.col("c.idx") < F.col("at")).otherwise(False).alias("carried"), miss.alias("miss"))


def modal_date(priced_rows: DataFrame, by: list[str], session: str = "session") -> DataFrame:
    """(by, pricing_date): the session that most rows are priced at, the later of equals."""
    n = priced_rows.filter(F.col(session).isNotNull()).groupBy(*by, session).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*by).agg(F.max(F.struct("n", session)).alias("m")).select(*by, F.col(f"m.{session}").alias("pricing_date"))
