"""Value of portfolios over time, and what is sold, carried over and left at the ends of fiscal years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.values import fiscal_year, half_up
from lotwise.operators import lots, prices


def calendar(grid: DataFrame) -> DataFrame:
    """(session, idx): the sessions of a grid of closes; one row each."""
    return grid.select("session").distinct().withColumn("idx", F.row_number().over(Window.orderBy("session")))


def sessions_of(days: DataFrame, sessions: DataFrame) -> DataFrame:
    """(trade_date, session, idx): the first session on or after each day; days behind the last session have none. As
    many rows as there are days."""
    one = F.lit(0).alias("one")
    out = prices.as_of(days.select("trade_date", one), sessions.select(one, "session", "idx"), ["one"], "trade_date", "session", "idx", forward=True)
    return out.filter("session is not null").select("trade_date", "session", "idx")


def filled_grid(grid: DataFrame, keys: DataFrame, sessions: DataFrame, boundaries: DataFrame, most: int = 7) -> DataFrame:
    """(key, session, idx, price): closes carried over at most ``most`` sessions, never across a key's boundary (key,
    session: the first session that the old closes do not reach)."""
    cells = keys.join(F.broadcast(sessions.agg(F.collect_list(F.struct("idx", "session")).alias("s"))), F.lit(True)).select("key", F.explode("s").alias("s")).select("key", "s.session", "s.idx")
    cut = boundaries.select("key", "session").distinct().withColumn("cut", F.lit(True))
    g = cells.join(grid, ["key", "session"], "left").join(cut, ["key", "session"], "left").withColumn("cut", F.coalesce("cut", F.lit(False)))
    return prices.bounded_fill(g, ["key"], boundary="cut", most=most).select("key", "session", "idx", F.col("filled").alias("price"))


def timeline(ledger: DataFrame, grid: DataFrame, start: str, boundaries: DataFrame) -> DataFrame:
    """(portfolio, session, nav, cost, flow, coverage, discrepancy) at every session from ``start``: positions by
    average cost, a null portfolio for all together.

    nav: priced positions above zero; discrepancy: what is owed at the price; coverage: how much of the cost is priced,
    1 without any; flow: cash in less cash out by trades since the session before, full amounts, from ``start`` only."""
    by = ["portfolio", "key"]
    sessions = calendar(grid)
    first = F.lit(start).cast("date")
    states = lots.average_cost(ledger, by, ["trade_date", "seq"], each=True)
    # The first session that includes a day's trades, and the position after the last trade that it includes.
    reach = sessions_of(ledger.select("trade_date").distinct(), sessions)  # a row a day: Spark broadcasts it by its size
    at = states.join(reach, "trade_date").groupBy(*by, "idx").agg(F.max_by(F.struct("qty", "cost"), F.struct("trade_date", "seq")).alias("p")).select(*by, "idx", "p.*")
    span = at.withColumn("until", F.coalesce(F.lead("idx").over(Window.partitionBy(*by).orderBy("idx")), F.lit(sessions.count() + 1)))
    held = span.withColumn("idx", F.explode(F.sequence(F.col("idx"), F.col("until") - 1))).filter(F.abs("qty") > 1e-9)
    px = filled_grid(grid, ledger.select("key").distinct(), sessions, boundaries)
    p = held.join(px.select("key", "idx", "price"), ["key", "idx"])
    up, cost = F.greatest("cost", F.lit(0.0)), F.col("price").isNotNull()
    worth = p.groupBy("portfolio", "idx").agg(F.sum(F.when(F.col("qty") > 0, F.col("qty") * F.col("price"))).alias("nav"), F.sum(up).alias("cost"), F.sum(F.when(cost, up)).alias("priced"), F.sum(F.when(F.col("qty") < 0, -F.col("qty") * F.col("price"))).alias("discrepancy"))
    signed = F.when(F.col("side") == "BUY", 1).otherwise(-1) * F.col("qty") * F.col("price")
    flow = ledger.select("portfolio", "trade_date", signed.alias("cash")).join(reach.filter(F.col("session") >= first), "trade_date").groupBy("portfolio", "idx").agg(F.sum("cash").alias("flow"))
    every = ledger.select("portfolio").distinct().join(F.broadcast(sessions.filter(F.col("session") >= first)), F.lit(True))  # portfolios by sessions: the result's rows
    full = every.join(worth, ["portfolio", "idx"], "left").join(flow, ["portfolio", "idx"], "left").fillna(0.0, ["nav", "cost", "priced", "discrepancy", "flow"])
    sums = full.groupBy("session").agg(*(F.sum(c).alias(c) for c in ("nav", "cost", "priced", "discrepancy", "flow"))).withColumn("portfolio", F.lit(None).cast(full.schema["portfolio"].dataType))
    both = full.select("portfolio", "session", "nav", "cost", "priced", "discrepancy", "flow").unionByName(sums)
    return both.select("portfolio", "session", *(half_up(F.col(c)).alias(c) for c in ("nav", "cost", "flow", "discrepancy")), F.round(F.when(F.col("cost") > 0, F.least(F.lit(1.0), F.col("priced") / F.col("cost"))).otherwise(1.0), 6).alias("coverage"))


def lots_at_year_ends(ledger: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by, fy, day, qty, cost): the lots that are left at the end of every fiscal year in which a key traded, those of
    a day together; shares and their purchase amount."""
    seg = lots.segments(ledger, by, order, "drop", keep=("trade_date", "price")).filter("lot is not null")
    years = ledger.groupBy(*by).agg(F.array_distinct(F.collect_set(fiscal_year(F.col("trade_date")))).alias("years"))  # a handful of years
    rows = seg.join(years, by).withColumn("fy", F.explode("years"))
    live = (fiscal_year(F.col("lot.trade_date")) <= F.col("fy")) & (F.col("sale").isNull() | (fiscal_year(F.col("sale.trade_date")) > F.col("fy")))
    left = rows.filter(live).groupBy(*by, "fy", F.col("lot.trade_date").alias("day"), F.col("lot.price").alias("price")).agg(F.sum("qty").alias("qty"))
    return left.groupBy(*by, "fy", "day").agg(F.sum("qty").alias("qty"), half_up(F.sum(half_up(F.col("qty") * F.col("price")))).alias("cost"))


def uncovered_sales(ledger: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by, sale_date, qty, sale_amount): what was sold without a lot to take it from, which the register files as
    short term without profit."""
    keyed = ledger.withColumn("__id", F.struct(*order))
    matched = lots.segments(keyed, by, order, "drop", keep=("trade_date", "price", "__id")).filter("lot is not null and sale is not null").groupBy(*by, F.col("sale.__id").alias("__id")).agg(F.sum("qty").alias("matched"))
    sales = keyed.filter("side = 'SELL'").join(matched, [*by, "__id"], "left").withColumn("left", F.col("qty") - F.coalesce("matched", F.lit(0)))
    return sales.filter("left > 0").groupBy(*by, F.col("trade_date").alias("sale_date")).agg(F.sum("left").alias("qty"), half_up(F.sum(F.col("left") * F.col("price"))).alias("sale_amount"))
