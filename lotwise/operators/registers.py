"""The sales register: every sale by term with the lots that paid for it, across splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.values import half_up
from lotwise.operators import lots


def restated(ledger: DataFrame, splits: DataFrame, by: list[str]) -> DataFrame:
    """``ledger`` (by, trade_date, ord, ...) with ``later``: what one of a row's shares has become by now, the product
    of the factors of all ``splits`` (by, trade_date, factor) behind it. A split is behind its day's purchases (ord 0)
    and before its sales. One union and one running product from the end; null factors are none."""
    columns = ledger.columns
    rows = ledger.withColumn("__factor", F.lit(None).cast("double"))
    marks = splits.select(*by, "trade_date", F.lit(1).alias("ord"), F.col("factor").cast("double").alias("__factor"))
    after = Window.partitionBy(*by).orderBy(F.desc("trade_date"), F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("__row", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    out = out.withColumn("later", F.coalesce(F.product(F.coalesce("__factor", F.lit(1.0))).over(after), F.lit(1.0)))
    return out.filter("__row").select(*columns, "later")


def sale_rows(ledger: DataFrame, by: list[str], order: list[str], splits: DataFrame, charges: list[str]) -> DataFrame:
    """One row for each sale and term: (by, sale, trade_date, term, qty, price, turnover, charges..., pnl, covered,
    matched) of a ledger (by, order, trade_date, ord, side, qty, price, lt_days, charges...).

    Lots and sales are matched first in, first out in shares of now, on one line of running quantities; quantities and
    rates are given in shares of the sale's day, so that a split changes neither turnover nor cost. term: ``LT`` from
    lt_days of the sale on, else ``ST``; a sale without lt_days takes its lots but has one row ``NONE`` without profit.
    What no lot covers is a row ``ST`` of its own without profit, not ``covered``. matched: structs (lot, bought, qty, rate),
    oldest first. ``sale`` and ``lot`` number a key's rows in order. Money is rounded for each lot, rates are not. Rows
    without a key are none.

    The ledger is dealt out once, by key: a sale's own row and the segments that it takes meet in one aggregate."""
    held = restated(ledger.na.drop(subset=by), splits, by)
    held = held.withColumns({f"__o{i}": F.col(c) for i, c in enumerate(order)})  # quantities are restated, the order is not
    line = [f"__o{i}" for i in range(len(order))]
    now = held.withColumns({"__no": F.row_number().over(Window.partitionBy(*by).orderBy(*line)), "__whole": F.col("qty"), "__price": F.col("price"), "qty": F.col("qty") * F.col("later"), "price": F.col("price") / F.col("later")})
    cut = lots.cuts(now, by, line, "drop", keep=("trade_date", "price", "later", F.col("__no").alias("no"), "lt_days"))
    own, hit = F.col("side") == "SELL", (F.col("__d") > 0) & F.col("lot").isNotNull() & F.col("sale").isNotNull()
    part = F.col("__d") / F.col("sale.later")
    rate = F.col("lot.price") * F.col("sale.later")
    price = F.col("sale.price") * F.col("sale.later")
    gain = F.when(F.col("sale.lt_days").isNotNull(), half_up(part * price) - half_up(part * rate)).otherwise(0.0)
    long = F.coalesce(F.datediff("sale.trade_date", "lot.trade_date") >= F.col("sale.lt_days"), F.lit(False))
    taken = F.struct(F.col("lot.no").alias("lot"), F.col("lot.trade_date").alias("bought"), part.alias("qty"), rate.alias("rate"))
    parts = cut.filter(own | hit).select(*by, F.when(hit, F.col("sale.no")).otherwise(F.col("__no")).alias("sale"), *(F.when(own, F.col(c)).alias(c) for c in ("trade_date", "lt_days", "__whole", "__price", *charges)), F.when(hit, part).alias("part"), F.when(hit, gain).alias("gain"), F.when(hit, taken).alias("taken"), F.when(hit, long).alias("long"))
    once = [F.max(c).alias(c) for c in ("trade_date", "lt_days", "__whole", "__price", *charges)]
    terms = ((F.col("long"), "lt"), (~F.col("long"), "st"))
    sums = [f for is_, t in terms for f in (F.sum(F.when(is_, F.col("part"))).alias(f"{t}_n"), F.sum(F.when(is_, F.col("gain"))).alias(f"{t}_gain"), F.collect_list(F.when(is_, F.col("taken"))).alias(f"{t}_matched"))]
    sales = parts.groupBy(*by, "sale").agg(*once, *sums).filter("__whole is not null")
    short = F.when(F.col("lt_days").isNull(), "NONE").otherwise("ST")
    left = F.col("__whole") - (F.coalesce("lt_n", F.lit(0.0)) + F.coalesce("st_n", F.lit(0.0)))
    filed = lambda term, n, gain, matched, covered: F.struct(term.alias("term"), n.alias("n"), gain.alias("pnl"), matched.alias("matched"), F.lit(covered).alias("covered"))
    rows = [F.when(F.col(f"{t}_n").isNotNull(), filed(term, F.col(f"{t}_n"), half_up(F.col(f"{t}_gain")), F.array_sort(f"{t}_matched"), True)) for t, term in (("lt", F.lit("LT")), ("st", short))]
    bare = F.when(left > 1e-9, filed(short, left, F.lit(0.0), F.slice("st_matched", 1, 0), False))
    out = sales.select(*by, "sale", "trade_date", "__whole", "__price", *charges, F.explode(F.array_compact(F.array(*rows, bare))).alias("f"))
    scaled = [half_up(F.col(c) * F.col("f.n") / F.col("__whole")).alias(c) for c in charges]
    return out.select(*by, "sale", "trade_date", "f.term", F.col("f.n").alias("qty"), F.col("__price").alias("price"), half_up(F.col("__price") * F.col("f.n")).alias("turnover"), *scaled, "f.pnl", "f.covered", "f.matched")
