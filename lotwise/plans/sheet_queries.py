"""Fact sheets, formats and totals with their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.functions import formats
from lotwise.functions.values import half_up
from lotwise.operators import lots, prices
from lotwise.plans import price_queries
from lotwise.plans.ledger_queries import CROSS, _positions
from lotwise.plans.price_queries import INDEX, _returns
from lotwise.plans.register import LE, LI, LINE_ORDER, Register, r2, r6
from lotwise.sources import ledger

REGISTER = Register()
_SQL = price_queries.REGISTER.sql


@REGISTER(f"""WITH {INDEX}, d AS (SELECT *, idx / lag(idx) OVER (PARTITION BY portfolio ORDER BY session) - 1 AS r FROM ix), b AS (SELECT session, avg(r) AS m FROM d WHERE r IS NOT NULL GROUP BY session), j AS (SELECT portfolio, r, m FROM d JOIN b USING (session) WHERE r IS NOT NULL)
SELECT portfolio, round(covar_samp(r, m), 10) AS covariance, round(corr(r, m), 8) AS correlation, round(covar_samp(r, m) / var_samp(m), 8) AS beta, round(stddev_samp(r - m) * sqrt(252), 8) AS tracking_error FROM j GROUP BY portfolio""")
def benchmark_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a benchmark, here the mean return of all portfolios."""
    d = _returns(spark, sf_dir).select("portfolio", "session", "r")
    j = d.join(d.groupBy("session").agg(F.avg("r").alias("m")), "session")
    cov = F.covar_samp("r", "m")
    return j.groupBy("portfolio").agg(F.round(cov, 10).alias("covariance"), F.round(F.corr("r", "m"), 8).alias("correlation"), F.round(cov / F.var_samp("m"), 8).alias("beta"), F.round(F.stddev_samp(F.col("r") - F.col("m")) * F.sqrt(F.lit(252.0)), 8).alias("tracking_error"))


@REGISTER(f"SELECT portfolio, mean, annual_vol, best, worst, median, max_drawdown, trough, peak, ret AS fortnight FROM ({_SQL['risk_stats']}) a JOIN ({_SQL['max_drawdown']}) b USING (portfolio) LEFT JOIN ({_SQL['period_return']}) c USING (portfolio)")
def factsheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q7: a portfolio's risk, drawdown and last fortnight on one line."""
    own = price_queries.risk_stats(spark, sf_dir).join(price_queries.max_drawdown(spark, sf_dir), "portfolio")
    return own.join(price_queries.period_return(spark, sf_dir).withColumnRenamed("ret", "fortnight"), "portfolio", "left")


@REGISTER(f"""WITH {INDEX}, e AS (SELECT portfolio, max(session) AS last, arg_max(idx, session) AS now FROM ix GROUP BY portfolio), p(days) AS (VALUES (3), (7), (14), (21), (60)),
o AS (SELECT e.portfolio, days, now, arg_max(idx, session) AS was FROM e CROSS JOIN p JOIN ix ON ix.portfolio = e.portfolio AND ix.session <= e.last - CAST(days AS INTEGER) GROUP BY ALL) SELECT portfolio, CAST(days AS INTEGER) AS days, round(now / was - 1, 8) AS ret FROM o""")
def period_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several look-backs, each as of the session then; those before the first session are left out."""
    s = prices.twr(price_queries._nav(spark, sf_dir), ["portfolio"])
    w = Window.partitionBy("portfolio")
    rows = s.withColumns({"last": F.max("session").over(w), "now": F.max_by("index", "session").over(w)}).withColumn("days", F.explode(F.array(*map(F.lit, (3, 7, 14, 21, 60)))))
    then = rows.filter(F.col("session") <= F.date_sub("last", F.col("days"))).groupBy("portfolio", "days").agg(F.first("now").alias("now"), F.max_by("index", "session").alias("was"))
    return then.select("portfolio", "days", F.round(F.col("now") / F.col("was") - 1, 8).alias("ret"))


@REGISTER(f"""WITH {LE}, m AS (SELECT user_id AS key, CAST(ts AS DATE) AS day, event_id AS seq FROM events WHERE event_type = 'error' AND value > 30), a AS (SELECT key, trade_date AS day, CASE side WHEN 'BUY' THEN 0 ELSE 2 END AS ord, seq, CASE side WHEN 'BUY' THEN qty ELSE -qty END AS n, 0 AS reset FROM le UNION ALL SELECT key, day, 1, seq, 0, 1 FROM m),
g AS (SELECT *, sum(reset) OVER (PARTITION BY key ORDER BY day, ord, seq ROWS UNBOUNDED PRECEDING) AS part FROM a) SELECT key, seq, CAST(sum(n) OVER (PARTITION BY key, part ORDER BY day, ord, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM g""")
def balance_with_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases, then actions, then sales of a day; a merger away sets the balance to zero."""
    buy = F.col("side") == "BUY"
    le = ledger.ledger_events(spark, sf_dir).select("key", F.col("trade_date").alias("day"), F.when(buy, 0).otherwise(2).alias("ord"), "seq", F.when(buy, F.col("qty")).otherwise(-F.col("qty")).alias("n"), F.lit(0).alias("reset"))
    m = ledger.table(spark, sf_dir, "events").filter("event_type = 'error' and value > 30").select(F.col("user_id").alias("key"), F.col("ts").cast("date").alias("day"), F.lit(1).alias("ord"), F.col("event_id").alias("seq"), F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("reset"))
    w = Window.partitionBy("key").orderBy("day", "ord", "seq").rowsBetween(Window.unboundedPreceding, 0)
    v = Window.partitionBy("key", "part").orderBy("day", "ord", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return le.unionByName(m).withColumn("part", F.sum("reset").over(w)).select("key", "seq", F.sum("n").over(v).alias("balance"))


PRICED = f"""{CROSS}, v AS (SELECT portfolio, net, bought, CASE WHEN p_size % 7 > 0 OR portfolio = 3 THEN p_retailprice END AS price, p_size % 11 = 0 AS excepted FROM p JOIN part ON key = p_partkey WHERE net > 0)"""


@REGISTER(f"""WITH {PRICED} SELECT portfolio, {r2("sum(CASE WHEN price IS NOT NULL THEN net * price ELSE bought END)")} AS aum, count(*) AS positions, count(price) AS priced, count(CASE WHEN price IS NULL AND excepted THEN 1 END) AS excepted, bool_and(price IS NOT NULL OR excepted) AS fully_priced, count(price) = 0 AS feed_failed FROM v GROUP BY ROLLUP (portfolio)""")
def aum_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: positions without a quote count at cost; whether all have one or are excepted."""
    size = F.col("p_size")
    part = ledger.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_retailprice", "p_size")
    v = _positions(spark, sf_dir).filter("net > 0").join(part, "key").withColumns({"price": F.when((size % 7 > 0) | (F.col("portfolio") == 3), F.col("p_retailprice")), "ex": size % 11 == 0})
    has = F.col("price").isNotNull()
    return v.rollup("portfolio").agg(half_up(F.sum(F.when(has, F.col("net") * F.col("price")).otherwise(F.col("bought")))).alias("aum"), F.count(F.lit(1)).alias("positions"), F.count("price").alias("priced"), F.count_if(~has & F.col("ex")).alias("excepted"), F.bool_and(has | F.col("ex")).alias("fully_priced"), (F.count("price") == 0).alias("feed_failed"))


@REGISTER(f"""WITH {CROSS}, l AS (SELECT key, max(trade_date) AS last_day, arg_max(side || ' ' || portfolio, row(trade_date, l_orderkey, l_linenumber, portfolio, side)) AS last_trade FROM li GROUP BY key)
SELECT p.key, string_agg(portfolio || ':' || CAST(net AS BIGINT), ',' ORDER BY net DESC, portfolio) AS holders, l.last_day, l.last_trade FROM p JOIN l USING (key) WHERE net <> 0 GROUP BY p.key, l.last_day, l.last_trade""")
def cross_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who holds a security, the largest first, and its last trade in any portfolio."""
    last = ledger.ledger_lines(spark, sf_dir).groupBy("key").agg(F.max("trade_date").alias("last_day"), F.max_by(F.concat("side", F.lit(" "), "portfolio"), F.struct("trade_date", "l_orderkey", "l_linenumber", "portfolio", "side")).alias("last_trade"))
    own = F.array_sort(F.collect_list(F.struct((-F.col("net")).alias("less"), "portfolio")))
    said = F.array_join(F.transform(own, lambda x: F.concat(x["portfolio"], F.lit(":"), -x["less"])), ",")
    return _positions(spark, sf_dir).filter("net <> 0").groupBy("key").agg(said.alias("holders")).join(last, "key").select("key", "holders", "last_day", "last_trade")


@REGISTER(f"""WITH {LI}, t AS (SELECT *, sum(CASE WHEN side='BUY' THEN qty ELSE 0 END) OVER (PARTITION BY portfolio, key ORDER BY {LINE_ORDER} ROWS UNBOUNDED PRECEDING) AS cb, sum(CASE WHEN side='SELL' THEN qty ELSE 0 END) OVER (PARTITION BY portfolio, key) AS ts FROM li),
l AS (SELECT portfolio, key, trade_date, least(qty, cb - ts) AS q, {r2("least(qty, cb - ts) * price")} AS a FROM t WHERE side='BUY' AND cb > ts)
SELECT portfolio, key, trade_date, CAST(sum(q) AS BIGINT) AS qty, {r2("sum(a)")} AS amount, {r6(r2("sum(a)") + " / sum(q)")} AS rate FROM l GROUP BY GROUPING SETS ((portfolio, key, trade_date), (portfolio, key))""")
def lots_with_subtotals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: lots of a day together with their rate, and each security's subtotal."""
    seg = lots.segments(ledger.ledger_lines(spark, sf_dir), ["portfolio", "key"], ledger.LINE_ORDER).filter("lot is not null and sale is null")
    l_ = seg.select("portfolio", "key", F.col("lot.trade_date").alias("trade_date"), "qty", half_up(F.col("qty") * F.col("lot.price")).alias("a"))
    sums = l_.groupingSets([["portfolio", "key", "trade_date"], ["portfolio", "key"]], "portfolio", "key", "trade_date").agg(F.sum("qty").alias("qty"), F.sum("a").alias("a"))
    return sums.select("portfolio", "key", "trade_date", "qty", half_up(F.col("a")).alias("amount"), half_up(half_up(F.col("a")) / F.col("qty"), 6).alias("rate"))


_WHOLE = "CAST(floor(c / 100) AS BIGINT)"
_GROUPED = f"""CASE WHEN {_WHOLE} >= 10000000 THEN ({_WHOLE} // 10000000) || ',' || lpad(CAST({_WHOLE} // 100000 % 100 AS VARCHAR), 2, '0') || ',' || lpad(CAST({_WHOLE} // 1000 % 100 AS VARCHAR), 2, '0') || ',' || lpad(CAST({_WHOLE} % 1000 AS VARCHAR), 3, '0')
  WHEN {_WHOLE} >= 100000 THEN ({_WHOLE} // 100000) || ',' || lpad(CAST({_WHOLE} // 1000 % 100 AS VARCHAR), 2, '0') || ',' || lpad(CAST({_WHOLE} % 1000 AS VARCHAR), 3, '0') WHEN {_WHOLE} >= 1000 THEN ({_WHOLE} // 1000) || ',' || lpad(CAST({_WHOLE} % 1000 AS VARCHAR), 3, '0') ELSE CAST({_WHOLE} AS VARCHAR) END"""


@REGISTER(f"""WITH x AS (SELECT o_orderkey AS key, (CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 90 WHEN o_orderkey % 3 = 1 THEN -o_totalprice / 300 ELSE o_totalprice / 3000 END) AS v, CAST(o_orderdate AS DATE) AS d FROM orders), y AS (SELECT *, floor(abs(v) * 100 + 0.5) AS c FROM x)
SELECT key, CASE WHEN v < 0 THEN '(' || {_GROUPED} || '.' || lpad(CAST(CAST(c AS BIGINT) % 100 AS VARCHAR), 2, '0') || ')' ELSE {_GROUPED} || '.' || lpad(CAST(CAST(c AS BIGINT) % 100 AS VARCHAR), 2, '0') END AS money, strftime(d, '%d-%b-%Y') AS day, 's' || lpad(CAST(key AS VARCHAR), 20, '0') || 'x' AS sort_key FROM y""")
def formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats: grouped money, dates with the month's name, keys that sort numbers by value."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    v = F.when(k % 3 == 0, p * 90).when(k % 3 == 1, -p / 300).otherwise(p / 3000)
    o = ledger.table(spark, sf_dir, "orders")
    return o.select(k.alias("key"), formats.money(v).alias("money"), formats.day(F.date_format("o_orderdate", "d/M/yyyy")).alias("day"), formats.natural_key(F.concat(F.lit("S0"), k, F.lit("X"))).alias("sort_key"))
