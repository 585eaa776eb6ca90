"""Filters and projections of reports and of what is typed in by hand."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.values import half_up, is_free_share, ledger_side, norm_name
from lotwise.operators import prices


def within(rows: DataFrame, day: str, first: str, last: str, undated: bool) -> DataFrame:
    """Rows of a range of days; those without a day stay if ``undated``."""
    inside = F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return rows.filter(inside | F.col(day).isNull() if undated else inside)


def has_terms(query: str, columns: list[str]) -> Column:
    """Whether every term of a query stands in the columns, read as one text; a query without terms fits all."""
    text = F.lower(F.concat_ws(" ", *columns))
    return functools.reduce(operator.and_, (F.contains(text, F.lit(t)) for t in query.lower().split()), F.lit(True))


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    """(value), sorted: what a column holds, blanks left out."""
    return rows.select(F.col(column).alias("value")).filter(F.trim("value") != "").distinct().orderBy("value")


def of_scrip(rows: DataFrame, entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (key) of the securities that share a name with one of ``wanted`` (entries and wanted: key, name)."""
    keys = entries.join(wanted.select("name").distinct(), "name", "left_semi").select("key").union(wanted.select("key")).distinct()
    return rows.join(keys, "key", "left_semi")


def classed(rows: DataFrame, classes: DataFrame, day: str) -> DataFrame:
    """``rows`` with ``class_then``: the class of their key (key, class, listed_from) on their day: none from the day
    of listing on. Rows of keys that have no entry are left out."""
    c = classes.select("key", "class", "listed_from")
    then = F.when(F.col("listed_from").isNull() | (F.col(day) < F.col("listed_from")), F.col("class"))
    return rows.join(c, "key").withColumn("class_then", then).drop("class", "listed_from")


def manual_record(rows: DataFrame) -> DataFrame:
    """``rows`` (tx_type, qty, price, charges, stt) with turnover and totals with and without tax. Free shares cost
    nothing and bear nothing; charges add to what a purchase costs and take from what a sale brings."""
    free, sell = is_free_share(F.col("tx_type")), ledger_side(F.col("tx_type")) == "SELL"
    turnover = half_up(F.col("qty") * F.col("price"))
    total = lambda extra: F.when(free, 0.0).when(sell, half_up(turnover - extra)).otherwise(half_up(turnover + extra))
    made = {"total_incl_stt": total(F.col("charges") + F.col("stt")), "total_excl_stt": total(F.col("charges")), "turnover": F.when(free, 0.0).otherwise(turnover), "price": F.when(free, 0.0).otherwise(F.col("price"))}
    return rows.withColumns(made)


def held_asof(rows: DataFrame, by: list[str], day: str) -> DataFrame:
    """(by, held, deferred) on a day: shares by rows in force, and how many rows are traded but not yet in force, as
    their transfer is later."""
    at = F.lit(day).cast("date")
    from_ = F.greatest("trade_date", F.coalesce("transfer_date", "trade_date"))
    signed = F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))
    return rows.groupBy(*by).agg(F.sum(F.when(from_ <= at, signed).otherwise(0)).alias("held"), F.count_if((F.col("trade_date") <= at) & (from_ > at)).alias("deferred"))


def annual(rows: DataFrame, start: str, end: str, years: str) -> DataFrame:
    """``rows`` with ``cumulative`` and ``cagr`` in percent between two levels above zero; nothing is made annual that
    is shorter than a year."""
    ok = (F.col(start) > 0) & (F.col(end) > 0)
    grown = F.col(end) / F.col(start)
    return rows.withColumns({"cumulative": F.when(F.col(start) > 0, (grown - 1) * 100), "cagr": F.when(ok & (F.col(years) >= 1), (F.pow(grown, 1 / F.col(years)) - 1) * 100)})


def returns(points: DataFrame, flows: DataFrame, benchmark: DataFrame, stretch: float = 1.0) -> DataFrame:
    """A row for each portfolio of ``points`` (portfolio, session, nav, index) and one, of a null portfolio, for all
    together: (portfolio, first, last, years, cumulative, cagr, xirr, n_flows, ambiguous, terminal, benchmark, excess, note).

    All together are worth what portfolios are, and their index compounds the change of that net of flows. cagr is
    between the first and the last session with an index and a value, not annual below a year (years times ``stretch``).
    xirr is that of the ``flows`` (portfolio, ts, amount; negative: invested) up to the last session, closed by the value
    there; flows of all portfolios are on one line for the total. The total is held against the benchmark (session,
    index) at the last sessions up to its own first and last. Percents; null where something is lacking, and ``note`` says
    what."""
    live = points.filter("index is not null and index > 0 and nav > 0")
    ends = live.groupBy("portfolio").agg(F.min("session").alias("first"), F.max("session").alias("last"), F.min_by("index", "session").alias("__x"), F.max_by("index", "session").alias("__y"), F.max_by("nav", "session").alias("terminal"))
    rows = annual(ends.withColumn("years", F.datediff("last", "first") * stretch / 365.0), "__x", "__y", "years")
    who = ends.select("portfolio", "last", "terminal")
    none = F.lit(None).cast(points.schema["portfolio"].dataType)
    all_flows = flows.select("portfolio", "ts", "amount").unionByName(flows.select(none.alias("portfolio"), "ts", "amount")).filter("amount <> 0")
    dated = all_flows.join(who.withColumnRenamed("portfolio", "__p"), F.col("portfolio").eqNullSafe(F.col("__p"))).filter(F.col("ts") <= F.col("last")).select("portfolio", "ts", "amount")
    counts = dated.groupBy("portfolio").agg(F.count(F.lit(1)).alias("n_flows"))
    rates = prices.xirr(dated.unionByName(who.select("portfolio", F.col("last").alias("ts"), F.col("terminal").alias("amount"))), ["portfolio"])
    same = lambda frame, name: F.col("portfolio").eqNullSafe(frame[name])
    c, r = counts.withColumnRenamed("portfolio", "__c"), rates.withColumnsRenamed({"portfolio": "__r", "rate": "__rate"})
    out = rows.join(c, same(c, "__c"), "left").join(r, same(r, "__r"), "left")
    total = ends.filter("portfolio is null").select("first", "last")
    level = lambda c: F.max_by(F.when(F.col("session") <= F.col(c), F.col("index")), F.when(F.col("session") <= F.col(c), F.col("session")))
    bench = benchmark.join(total, F.col("session") <= F.col("last")).agg(level("first").alias("__b0"), level("last").alias("__b1"))  # one row
    out = out.join(F.broadcast(bench), F.col("portfolio").isNull(), "left")
    annualised = F.when((F.col("__b0") > 0) & (F.col("__b1") > 0) & F.col("cagr").isNotNull(), (F.pow(F.col("__b1") / F.col("__b0"), 1 / F.col("years")) - 1) * 100)
    out = out.withColumns({"benchmark": annualised, "n_flows": F.coalesce("n_flows", F.lit(0)), "ambiguous": F.coalesce("ambiguous", F.lit(False)), "xirr": F.col("__rate") * 100})
    notes = F.array_join(F.array_compact(F.array(F.when(F.col("cagr").isNull(), "cumulative, not annualised"), F.when(F.col("n_flows") == 0, "no cash-flow history for XIRR").when(F.col("xirr").isNull(), "XIRR: unsolvable"), F.when(F.col("ambiguous"), "capital left and re-entered"))), "; ")
    return out.select("portfolio", "first", "last", "years", "cumulative", "cagr", "xirr", "n_flows", "ambiguous", "terminal", "benchmark", (F.col("cagr") - F.col("benchmark")).alias("excess"), notes.alias("note"))


def derived(rows: DataFrame) -> DataFrame:
    """``rows`` (qty, rate, cost) with ``outcome``: ``derived`` where the cost is quantity times rate to the last unit,
    ``near`` within one, ``off`` beyond, ``no-rate`` without a rate."""
    gap = F.abs(half_up(F.col("qty") * F.col("rate")) - F.col("cost"))
    return rows.withColumn("outcome", F.when(F.col("rate").isNull(), "no-rate").when(gap <= 0.01, "derived").when(gap <= 1.0, "near").otherwise("off"))


def out_of_order(rows: DataFrame, by: list[str], batch: str) -> DataFrame:
    """(by, batch, out_of_order) for batches of rows (side, day): a batch that sells, and buys on a day before the
    newest purchase of the batches before it."""
    buy = F.when(F.col("side") == "BUY", F.col("day"))
    m = rows.groupBy(*by, batch).agg(F.bool_or(F.col("side") == "SELL").alias("sells"), F.min(buy).alias("oldest"), F.max(buy).alias("newest"))
    seed = F.max("newest").over(Window.partitionBy(*by).orderBy(batch).rowsBetween(Window.unboundedPreceding, -1))
    return m.withColumn("seed", seed).withColumn("out_of_order", F.coalesce(F.col("sells") & (F.col("oldest") < F.col("seed")), F.lit(False)))


def cross_checked(rows: DataFrame, summary: DataFrame, by: list[str], most: float = 0.05) -> DataFrame:
    """``rows`` (by, grid) with what the summary (by, printed) says: ``no-summary``, ``differs`` or ``ok``."""
    out = rows.join(summary, by, "left")
    status = F.when(F.col("printed").isNull(), "no-summary").when((F.col("printed") > 0) & (F.abs(F.col("grid") - F.col("printed")) > most), "differs").otherwise("ok")
    return out.withColumn("outcome", status)


def cash_flows(statements: DataFrame, lots: DataFrame, later: DataFrame, slack: int = 7) -> DataFrame:
    """(portfolio, trade_date, amount, partial): money back less money out, by day. Before the cut-off a portfolio's
    statements count if they begin at most ``slack`` days after its oldest lot, else its lots, and its flows are partial."""
    first = lambda df, name: df.groupBy("portfolio").agg(F.min("trade_date").alias(name))
    every = statements.select("portfolio").union(lots.select("portfolio")).union(later.select("portfolio")).distinct()
    known = every.join(first(statements, "t0"), "portfolio", "left").join(first(lots, "l0"), "portfolio", "left")
    whole = F.col("t0").isNotNull() & (F.col("l0").isNull() | (F.col("t0") <= F.date_add("l0", slack)))
    known = known.select("portfolio", whole.alias("whole"))
    cash = F.col("qty") * F.col("price") * F.when(F.col("side") == "SELL", 1).otherwise(-1)
    flow = lambda df: df.select("portfolio", "trade_date", cash.alias("amount"))
    old = flow(statements).join(known.filter("whole"), "portfolio", "left_semi").union(flow(lots).join(known.filter("not whole"), "portfolio", "left_semi"))
    return old.union(flow(later)).join(known, "portfolio").groupBy("portfolio", "trade_date").agg(half_up(F.sum("amount")).alias("amount"), (~F.bool_and("whole")).alias("partial"))


def guarded(slices: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, order, outcome, through) of slices (first, last, resolved): the last day that is processed after each, null
    once a slice has something unresolved."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = slices.withColumns({"done": F.coalesce(F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit("1900-01-01").cast("date")), "clear": F.bool_and("resolved").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    status = F.when(~F.col("clear"), "blocked").when(F.col("first") < F.col("done"), "behind").otherwise("ok")
    return rows.select(*by, order, status.alias("outcome"), F.when(F.col("clear"), F.greatest("last", "done")).alias("through"))


def matched_targets(said: DataFrame, held: DataFrame) -> DataFrame:
    """``said`` (id, code, name) with the key of the holding (key, code, symbol, name) that it means: by code, else by
    symbol, else by normalised name; null if none."""
    slot = lambda c, name: held.select(c.alias("__c"), F.col("key").alias(name)).filter("__c <> ''").groupBy("__c").agg(F.min(name).alias(name))
    out = said
    for ours, theirs, name in ((F.col("code"), F.col("code"), "__k"), (F.upper(F.trim("name")), F.upper("symbol"), "__s"), (norm_name(F.col("name")), norm_name(F.col("name")), "__n")):
        out = out.withColumn("__c", ours).join(slot(theirs, name), "__c", "left").drop("__c")
    return out.withColumn("key", F.coalesce("__k", "__s", "__n")).drop("__k", "__s", "__n")
