"""Lot engines without a loop: FIFO matching as one sweep over cumulative quantities.

Buys and sales of a key cut one line of shares at their running totals. Between two neighbouring cuts lies a segment of
shares that belongs to exactly one lot (the next buy's) and one sale (the next sale's). Two sorts in one partitioning
replace the pairwise join of lots and sales, so work grows with n log n for a key whatever its share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.values import half_up
from lotwise.operators import scans
from lotwise.operators.folds import fold
from lotwise.session import written


def square_off(ledger: DataFrame, by: list[str], day: str = "trade_date") -> DataFrame:
    """Same-day net of (by, day): a day's only row stays as it is; otherwise the net as a buy at the day's average
    buy price, or a sale at price zero; nothing where it nets to zero. seq is the least of the day."""
    buy = lambda x: F.sum(F.when(F.col("side") == "BUY", x).otherwise(0))
    g = ledger.groupBy(*by, day).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"), buy(F.col("qty")).alias("b"), F.sum(F.when(F.col("side") != "BUY", F.col("qty")).otherwise(0)).alias("s"), buy(F.col("qty") * F.col("price")).alias("v"), F.max("price").alias("only"))
    net = F.col("b") - F.col("s")
    price = F.when(F.col("n") == 1, F.col("only")).when(net > 0, F.col("v") / F.col("b")).otherwise(0.0)
    return g.filter(net != 0).select(*by, day, "seq", F.when(net > 0, "BUY").otherwise("SELL").alias("side"), F.abs(net).alias("qty"), price.alias("price"))


def round_trips(ledger: DataFrame, by: list[str], day: str = "trade_date") -> DataFrame:
    """(by, day, buys, sells, matched, intraday_gain, residual_side, residual_qty, residual_price): a day's matched
    quantity at average prices, and what is left for delivery."""
    of = lambda side, x: F.sum(F.when(F.col("side") == side, x).otherwise(0))
    g = ledger.groupBy(*by, day).agg(of("BUY", F.col("qty")).alias("buys"), of("SELL", F.col("qty")).alias("sells"), of("BUY", F.col("qty") * F.col("price")).alias("bv"), of("SELL", F.col("qty") * F.col("price")).alias("sv"))
    g = g.withColumns({"matched": F.least("buys", "sells"), "pb": F.col("bv") / F.nullif("buys", F.lit(0)), "ps": F.col("sv") / F.nullif("sells", F.lit(0)), "left": F.col("buys") - F.col("sells")})
    gain = F.when(F.col("matched") > 0, half_up(half_up(F.col("matched") * F.col("ps")) - half_up(F.col("matched") * F.col("pb")))).otherwise(0.0)
    side = F.when(F.col("left") > 0, "BUY").when(F.col("left") < 0, "SELL")
    return g.select(*by, day, "buys", "sells", "matched", gain.alias("intraday_gain"), side.alias("residual_side"), F.abs("left").alias("residual_qty"), half_up(F.when(F.col("left") > 0, F.col("pb")).when(F.col("left") < 0, F.col("ps")), 6).alias("residual_price"))


def cuts(ledger: DataFrame, by: list[str], order: list[str | Column], oversold: str = "carry", keep: tuple[str, ...] = ("trade_date", "price")) -> DataFrame:
    """``ledger`` with ``__n``, a row's number in its key, and the segment that ends at its cut: ``lot`` and ``sale``,
    the structs of fields ``keep`` that it belongs to, and ``__d``, its length (zero where cuts fall together)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    buy = F.col("side") == "BUY"
    rows = ledger.withColumns({"__b": F.sum(F.when(buy, F.col("qty")).otherwise(0)).over(w), "__s": F.sum(F.when(buy, 0).otherwise(F.col("qty"))).over(w), "__n": F.row_number().over(Window.partitionBy(*by).orderBy(*order))})
    short = F.greatest(F.lit(0), F.max(F.col("__s") - F.col("__b")).over(w)) if oversold == "drop" else F.lit(0)
    rows = rows.withColumn("__at", F.when(buy, F.col("__b")).otherwise(F.col("__s") - short))
    line = Window.partitionBy(*by).orderBy(F.desc("__at"), F.desc("__n"))  # backwards, so that what lies ahead is a growing frame
    ahead = line.rowsBetween(Window.unboundedPreceding, 0)
    item = F.struct(*keep)
    return rows.withColumns({"lot": F.last(F.when(buy, item), ignorenulls=True).over(ahead), "sale": F.last(F.when(~buy, item), ignorenulls=True).over(ahead), "__d": F.col("__at") - F.coalesce(F.lead("__at").over(line), F.lit(0))})


def segments(ledger: DataFrame, by: list[str], order: list[str | Column], oversold: str = "carry", keep: tuple[str, ...] = ("trade_date", "price")) -> DataFrame:
    """(by, lot, sale, qty): every segment of shares with the struct of its lot or its sale (null where it has none;
    fields ``keep``).

    ``oversold``: ``carry`` lets later buys cover a deficit (positions), ``drop`` forgets it (gains).
    """
    return cuts(ledger, by, order, oversold, keep).filter("__d > 0").select(*by, "lot", "sale", F.col("__d").alias("qty"))


def holdings(ledger: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """(by, net_qty, invested, n_lots) of keys with a position; a negative one has invested nothing."""
    seg = segments(ledger, by, order, "carry")
    left = F.col("sale").isNull()
    net = F.sum(F.when(F.col("lot").isNotNull() & left, F.col("qty")).when(F.col("lot").isNull(), -F.col("qty")).otherwise(0))
    worth = F.sum(F.when(F.col("lot").isNotNull() & left, F.col("qty") * F.col("lot.price")).otherwise(0.0))
    out = seg.groupBy(*by).agg(net.alias("net_qty"), half_up(worth).alias("invested"), F.count_if(F.col("lot").isNotNull() & left).alias("n_lots"))
    return out.filter("net_qty <> 0")


def realised(ledger: DataFrame, by: list[str], order: list[str | Column], lt_days: Column | int = 365, keep: tuple[str, ...] = ("trade_date", "price", "seq")) -> DataFrame:
    """(by, buy_date, sale_date, qty, sale_amount, acq_cost, gain, days, term): one row for each matched lot and
    sale; an oversold remainder is dropped. A null threshold leaves the term null; the lot is consumed all the same."""
    seg = segments(ledger, by, order, "drop", keep).filter("lot is not null and sale is not null")
    sale, cost = half_up(F.col("qty") * F.col("sale.price")), half_up(F.col("qty") * F.col("lot.price"))
    days = F.datediff("sale.trade_date", "lot.trade_date")
    limit = F.lit(lt_days) if isinstance(lt_days, int) else lt_days
    return seg.select(*by, F.col("lot.trade_date").alias("buy_date"), F.col("sale.trade_date").alias("sale_date"), "qty", sale.alias("sale_amount"), cost.alias("acq_cost"), half_up(sale - cost).alias("gain"), days.alias("days"), F.when(days >= limit, "LT").when(days < limit, "ST").alias("term"))


def transfer_plan(lots: DataFrame, wanted: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Lots taken oldest first for a wanted quantity: (lots..., take, shortfall)."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.coalesce(F.sum("qty").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    take = F.greatest(F.lit(0), F.least(F.col("qty"), F.col("wanted") - before))
    out = lots.join(wanted, by).withColumn("take", take)
    return out.withColumn("shortfall", F.col("wanted") - F.sum("take").over(Window.partitionBy(*by))).filter("take > 0")


#: Rows of a key from which on its average cost is followed by ranges.
HOT_ROWS = 20_000_000


def _released(state: tuple, side: str, qty: float, cash: float) -> tuple:
    """Quantity and cost after a purchase, or a sale that releases cost at the average: one beyond the position is cut
    off, one without a position makes it negative."""
    held, cost = state
    if side == "BUY":
        return held + qty, cost + cash
    if held <= 0:
        return held - qty, cost
    sold = min(held, qty)
    left = held - sold
    return (left, cost - cost * sold / held) if left > 1e-9 else (0.0, 0.0)


def average_cost(ledger: DataFrame, by: list[str], order: list[str], each: bool = False) -> DataFrame:
    """(by, qty, cost) by weighted-average release, as in the NAV engine; (by, order, qty, cost) after every row if
    ``each``. Keys of over HOT_ROWS rows are cut into ranges that are followed in parallel (scans.average_cost), others
    take one task each."""
    counts = written(ledger.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > HOT_ROWS).select(*by), "hot")
    rows = ledger.withColumn("__cash", F.col("qty") * F.col("price"))
    if counts.isEmpty():
        return _followed(rows, by, order, each)
    same = lambda frame: [frame[c].eqNullSafe(counts[c]) for c in by]
    hot = scans.average_cost(ledger.join(counts, same(ledger), "left_semi"), by, order, each)
    return _followed(rows.join(counts, same(rows), "left_anti"), by, order, each).unionByName(hot)


def _followed(rows: DataFrame, by: list[str], order: list[str], each: bool) -> DataFrame:
    return fold(rows, by, order, ["side", "qty", "__cash"], (0.0, 0.0), _released, ["held", "cost"], each).withColumnRenamed("held", "qty")


def statement_average(events: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by, qty, avg_cost) of statement rows (kind, qty, price, num, den) by weighted averages: a purchase that meets a
    deficit sets the average to its price, ratios spread the cost over more shares, rights add theirs at their price.
    A row without a ratio that needs one changes nothing."""

    def step(state: tuple, kind: str, qty: float, price: float, num: float | None, den: float | None) -> tuple:
        q, avg = state
        ratio = num / den if num and den else 0.0
        if kind == "SELL":
            left = q - qty
            return left, avg if left > 1e-9 else 0.0
        if kind == "BUY":
            total, worth = q + qty, (q + qty) * price if q < 0 else q * avg + qty * price
        elif kind == "SPLIT" and q * ratio > 0 and q > 1e-9:
            total, worth = q * ratio, q * avg
        elif kind in ("BONUS", "RIGHT") and q * ratio > 1e-9:
            total, worth = q + q * ratio, q * avg + (q * ratio * price if kind == "RIGHT" else 0.0)
        else:
            return state
        return total, worth / total if total > 0 else 0.0

    return fold(events, by, order, ["kind", "qty", "price", "num", "den"], (0.0, 0.0), step, ["qty", "avg_cost"])


def settled_quantity(replayed: Column, balance: Column, rights: Column) -> Column:
    """The broker's balance, unless nothing but a wrong entry explains it: without rights, off by a factor over three
    or held where the replay has none. A null balance (never printed) leaves the replay."""
    wild = F.when(replayed > 1e-9, (balance > replayed * 3) | (balance < replayed / 3)).otherwise(F.abs(balance) > 1)
    return F.when(balance.isNotNull() & (rights | ~wild), balance).otherwise(replayed)
