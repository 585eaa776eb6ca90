"""Price and series operators: as-of look-ups, bounded fill, indices, drawdown, risk, money-weighted return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, session: str, value: str, forward: bool = False) -> DataFrame:
    """``left`` with the session and value of the last row of ``right`` at or before ``at`` (the first at or after,
    if ``forward``): one union and one window instead of a range join."""
    order = F.col("__at") if not forward else F.col("__at").desc()
    l_ = left.select(F.struct(*left.columns).alias("__l"), *by, F.col(at).alias("__at"), F.lit(None).cast(right.schema[session].dataType).alias("__s"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(1).alias("__o"))
    r_ = right.filter(F.col(value).isNotNull()).select(F.lit(None).cast(l_.schema["__l"].dataType).alias("__l"), *by, F.col(session).alias("__at"), F.col(session).alias("__s"), F.col(value).alias("__v"), F.lit(0).alias("__o"))
    w = Window.partitionBy(*by).orderBy(order, "__o").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("__s").isNotNull(), F.struct("__s", "__v")), ignorenulls=True).over(w)
    return l_.unionByName(r_).withColumn("__f", found).filter("__o = 1").select("__l.*", F.col("__f.__s").alias(session), F.col("__f.__v").alias(value))


def bounded_fill(grid: DataFrame, by: list[str], idx: str = "idx", value: str = "close", boundary: str | None = None, most: int = 7) -> DataFrame:
    """``filled``: the last value at most ``most`` sessions back, never across a boundary row."""
    w = Window.partitionBy(*by).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    part = F.sum(F.col(boundary).cast("int")).over(w) if boundary else F.lit(0)
    rows = grid.withColumn("__part", part)
    v = Window.partitionBy(*by, "__part").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(value).isNotNull(), F.struct(F.col(idx).alias("i"), F.col(value).alias("v"))), ignorenulls=True).over(v)
    return rows.withColumn("__last", last).withColumn("filled", F.when(F.col(idx) - F.col("__last.i") <= most, F.col("__last.v"))).drop("__part", "__last")


def unadjusted(bars: DataFrame, splits: DataFrame, by: list[str]) -> DataFrame:
    """Closes times the product of the factors of all later splits: union and a running product from the end."""
    b = bars.select(*by, "session", "close", F.lit(None).cast("double").alias("__f"))
    s = splits.select(*by, "session", F.lit(None).cast("double").alias("close"), F.col("factor").cast("double").alias("__f"))
    w = Window.partitionBy(*by).orderBy(F.desc("session")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # a split of the same session is not later: its factor is taken out again
    same = F.product(F.coalesce("__f", F.lit(1.0))).over(Window.partitionBy(*by, "session"))
    all_ = b.unionByName(s).withColumn("__p", F.product(F.coalesce("__f", F.lit(1.0))).over(w) / same)
    return all_.filter("close is not null").select(*by, "session", "close", (F.col("close") * F.col("__p")).alias("raw_close"))


def twr(nav: DataFrame, by: list[str], session: str = "session", base: float = 1000.0) -> DataFrame:
    """``index``: the product of (nav - flow) / last positive nav, from ``base`` at the first positive nav; factors
    that are not above zero are passed over, and nothing is shown before the first holding."""
    w = Window.partitionBy(*by).orderBy(session)
    before = F.last(F.when(F.col("nav") > 0, F.col("nav")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = (F.col("nav") - F.col("flow")) / before
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = nav.withColumn("__r", F.when(r > 0, r).otherwise(1.0))
    return rows.withColumn("index", F.when(F.max("nav").over(so_far) > 0, base * F.product(F.coalesce("__r", F.lit(1.0))).over(so_far))).drop("__r")


def drawdown(series: DataFrame, by: list[str], session: str, value: str) -> DataFrame:
    """(by, max_drawdown, trough, peak): the deepest fall below the highest value so far."""
    w = Window.partitionBy(*by).orderBy(session).rowsBetween(Window.unboundedPreceding, 0)
    # the first session that reaches the top is the peak
    top = F.max(F.struct(F.col(value).alias("v"), (-F.datediff(session, F.lit("1970-01-01"))).alias("d"))).over(w)
    rows = series.withColumn("__t", top).withColumn("__dd", F.col(value) / F.col("__t.v") - 1)
    worst = F.min(F.struct("__dd", F.col(session).alias("s"), F.col("__t.d").alias("d")))
    return rows.groupBy(*by).agg(worst.alias("w")).select(*by, F.col("w.__dd").alias("max_drawdown"), F.col("w.s").alias("trough"), F.date_add(F.lit("1970-01-01").cast("date"), -F.col("w.d")).alias("peak"))


def npv(flows: Column, rate: Column) -> Column:
    """Of an array of (years, amount)."""
    return F.aggregate(flows, F.lit(0.0), lambda s, f: s + f["amount"] / F.pow(1 + rate, f["years"]))


def xirr(flows: DataFrame, by: list[str], day: str = "ts", amount: str = "amount") -> DataFrame:
    """(by, rate, ambiguous): money-weighted return by bisection in built-in expressions. Null without two dates and
    both signs, or without a root below 1000; ambiguous when the running balance changes its sign more than once."""
    rows = flows.filter(F.col(amount).isNotNull() & (F.col(amount) != 0)).groupBy(*by, day).agg(F.sum(amount).alias("amount"))
    first = Window.partitionBy(*by)
    rows = rows.withColumn("years", F.datediff(day, F.min(day).over(first)) / 365.0)
    run = F.sum("amount").over(Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("sign", F.nullif(F.signum(run), F.lit(0.0)))
    before = F.last("sign", ignorenulls=True).over(Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("turn", F.coalesce((F.col("sign") != before).cast("int"), F.lit(0)))
    g = rows.groupBy(*by).agg(F.collect_list(F.struct("years", "amount")).alias("f"), F.sum("turn").alias("turns"), F.min("amount").alias("lo"), F.max("amount").alias("hi"), F.count(F.lit(1)).alias("n"))
    tops = F.transform(F.sequence(F.lit(0), F.lit(13)), lambda i: F.lit(0.2) * F.pow(F.lit(2.0), i.cast("double")) - 0.1)
    g = g.withColumn("__sl", F.signum(npv(F.col("f"), F.lit(-0.9999999))))
    g = g.withColumn("__top", F.get(F.filter(tops, lambda t: F.signum(npv(F.col("f"), t)) != F.col("__sl")), F.lit(0)))
    start = F.struct(F.lit(-0.9999999).alias("lo"), F.col("__top").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        low = F.signum(npv(F.col("f"), mid)) == F.col("__sl")
        return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, halve)
    ok = (F.col("n") >= 2) & (F.col("lo") < 0) & (F.col("hi") > 0) & F.col("__top").isNotNull()
    return g.withColumn("__e", end).select(*by, F.when(ok, (F.col("__e.lo") + F.col("__e.hi")) / 2).alias("rate"), (F.col("turns") > 1).alias("ambiguous"))
