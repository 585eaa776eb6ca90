"""Positions, gains and reports from ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.functions.values import fiscal_year, half_up
from lotwise.operators import checks, lots
from lotwise.plans.register import LE, LI, LINE_ORDER, SQUARED, Register, r2, r6
from lotwise.sources import ledger

REGISTER = Register()


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ledger_events(spark, sf_dir)


@REGISTER(f"WITH {LE} SELECT portfolio, key, seq, trade_date, side, CAST(qty AS BIGINT) AS qty, price FROM le")
def ledger_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed trades of positive quantity and price."""
    return _events(spark, sf_dir).select("portfolio", "key", "seq", "trade_date", "side", "qty", "price")


@REGISTER(f"WITH {LE}, {SQUARED} SELECT key, trade_date, seq, side, CAST(qty AS BIGINT) AS qty, {r6('price')} AS price FROM net")
def squareoff_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1."""
    out = lots.square_off(_events(spark, sf_dir), ["key"])
    return out.select("key", "trade_date", "seq", "side", "qty", half_up(F.col("price"), 6).alias("price"))


@REGISTER(f"""WITH {LE}, g AS (SELECT key, trade_date, sum(CASE WHEN side='BUY' THEN qty ELSE 0 END) AS buys, sum(CASE WHEN side='SELL' THEN qty ELSE 0 END) AS sells,
  sum(CASE WHEN side='BUY' THEN qty*price ELSE 0 END) AS bv, sum(CASE WHEN side='SELL' THEN qty*price ELSE 0 END) AS sv FROM le GROUP BY ALL)
SELECT key, trade_date, CAST(buys AS BIGINT) AS buys, CAST(sells AS BIGINT) AS sells, CAST(least(buys, sells) AS BIGINT) AS matched,
  CASE WHEN least(buys, sells) > 0 THEN {r2(r2("least(buys,sells)*(sv/sells)") + " - " + r2("least(buys,sells)*(bv/buys)"))} ELSE 0.0 END AS intraday_gain,
  CASE WHEN buys > sells THEN 'BUY' WHEN buys < sells THEN 'SELL' END AS residual_side, CAST(abs(buys - sells) AS BIGINT) AS residual_qty,
  {r6("CASE WHEN buys > sells THEN bv/buys WHEN buys < sells THEN sv/sells END")} AS residual_price FROM g""")
def roundtrip_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2."""
    return lots.round_trips(_events(spark, sf_dir), ["key"])


@REGISTER(f"""WITH {LE}, {SQUARED}, t AS (SELECT *, sum(CASE WHEN side='BUY' THEN qty ELSE 0 END) OVER (PARTITION BY key ORDER BY trade_date, seq) AS cb,
  sum(CASE WHEN side='SELL' THEN qty ELSE 0 END) OVER (PARTITION BY key) AS ts FROM net),
o AS (SELECT key, sum(CASE WHEN side='BUY' THEN qty ELSE -qty END) AS net_qty,
  sum(CASE WHEN side='BUY' THEN least(qty, greatest(0, cb - ts)) * price ELSE 0 END) AS invested,
  count(CASE WHEN side='BUY' AND cb > ts THEN 1 END) AS n_lots FROM t GROUP BY key)
SELECT key, CAST(net_qty AS BIGINT) AS net_qty, {r2("CAST(invested AS DOUBLE)")} AS invested, n_lots FROM o WHERE net_qty <> 0""")
def fifo_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net square-off, then FIFO positions."""
    return lots.holdings(lots.square_off(_events(spark, sf_dir), ["key"]), ["key"], ["trade_date", "seq"])


@REGISTER(f"""WITH {LI}, t AS (SELECT *, sum(CASE WHEN side='BUY' THEN qty ELSE 0 END) OVER (PARTITION BY portfolio, key ORDER BY {LINE_ORDER} ROWS UNBOUNDED PRECEDING) AS cb,
  sum(CASE WHEN side='SELL' THEN qty ELSE 0 END) OVER (PARTITION BY portfolio, key) AS ts FROM li)
SELECT portfolio, key, trade_date, CAST(sum(least(qty, cb - ts)) AS BIGINT) AS qty, {r2("sum(least(qty, cb - ts) * price)")} AS invested FROM t
WHERE side='BUY' AND cb > ts GROUP BY portfolio, key, trade_date""")
def lot_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surviving lots, those of a day together."""
    seg = lots.segments(ledger.ledger_lines(spark, sf_dir), ["portfolio", "key"], ledger.LINE_ORDER).filter("lot is not null and sale is null")
    return seg.groupBy("portfolio", "key", F.col("lot.trade_date").alias("trade_date")).agg(F.sum("qty").alias("qty"), half_up(F.sum(F.col("qty") * F.col("lot.price"))).alias("invested"))


GAINS = f"""{LI}, t AS (SELECT *, row_number() OVER w AS rn, sum(CASE WHEN side='BUY' THEN qty ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS cb,
  sum(CASE WHEN side='SELL' THEN qty ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS cs FROM li WINDOW w AS (PARTITION BY portfolio, key ORDER BY {LINE_ORDER})),
u AS (SELECT *, greatest(0, max(cs - cb) OVER (PARTITION BY portfolio, key ORDER BY rn)) AS d FROM t),
s AS (SELECT *, cs - d AS hi, coalesce(lag(cs - d) OVER (PARTITION BY portfolio, key ORDER BY rn), 0) AS lo FROM u WHERE side='SELL'),
m AS (SELECT b.portfolio, b.key, b.trade_date AS buy_date, s.trade_date AS sale_date, least(b.cb, s.hi) - greatest(b.cb - b.qty, s.lo) AS qty, b.price AS bp, s.price AS sp
  FROM u b JOIN s ON b.portfolio = s.portfolio AND b.key = s.key AND b.side = 'BUY' AND least(b.cb, s.hi) > greatest(b.cb - b.qty, s.lo)),
gains AS (SELECT portfolio, key, buy_date, sale_date, CAST(qty AS BIGINT) AS qty, {r2("qty*sp")} AS sale_amount, {r2("qty*bp")} AS acq_cost,
  {r2(r2("qty*sp") + " - " + r2("qty*bp"))} AS gain, CAST(date_diff('day', buy_date, sale_date) AS INTEGER) AS days,
  CASE WHEN date_diff('day', buy_date, sale_date) >= 365 THEN 'LT' ELSE 'ST' END AS term FROM m)"""


def _gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lots.realised(ledger.ledger_lines(spark, sf_dir), ["portfolio", "key"], ledger.LINE_ORDER, keep=("trade_date", "price"))


@REGISTER(f"WITH {GAINS} SELECT * FROM gains")
def fifo_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2."""
    return _gains(spark, sf_dir)


@REGISTER(f"""WITH {GAINS} SELECT year(sale_date) AS y, month(sale_date) AS m, {r2("sum(gain)")} AS gain, count(*) AS n FROM gains GROUP BY ROLLUP (year(sale_date), month(sale_date))""")
def realised_by_month_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months, years and the total."""
    g = _gains(spark, sf_dir).select(F.year("sale_date").alias("y"), F.month("sale_date").alias("m"), "gain")
    return g.rollup("y", "m").agg(half_up(F.sum("gain")).alias("gain"), F.count(F.lit(1)).alias("n"))


@REGISTER(f"""WITH {GAINS} SELECT portfolio, key, year(sale_date) - CASE WHEN month(sale_date) < 4 THEN 1 ELSE 0 END AS fy, term, CAST(sum(qty) AS BIGINT) AS qty,
  {r2("sum(sale_amount)")} AS sale_amount, {r2("sum(acq_cost)")} AS acq_cost, {r2("sum(gain)")} AS gain FROM gains GROUP BY ALL""")
def register_by_fy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each key, fiscal year and term."""
    sums = [half_up(F.sum(c)).alias(c) for c in ("sale_amount", "acq_cost", "gain")]
    return _gains(spark, sf_dir).groupBy("portfolio", "key", fiscal_year(F.col("sale_date")).alias("fy"), "term").agg(F.sum("qty").alias("qty"), *sums)


@REGISTER(f"""WITH {LI} SELECT portfolio, trade_date, {r2("sum(brokerage)")} AS brokerage, {r2("sum(stt)")} AS stt, {r2("sum(brokerage + stt)")} AS total
FROM li GROUP BY GROUPING SETS ((portfolio, trade_date), (portfolio), ())""")
def expense_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charges by date with totals of portfolios and of all."""
    li = ledger.ledger_lines(spark, sf_dir)
    return li.rollup("portfolio", "trade_date").agg(*(half_up(F.sum(c)).alias(c) for c in ("brokerage", "stt")), half_up(F.sum(F.col("brokerage") + F.col("stt"))).alias("total"))


@REGISTER(f"""WITH {LE} SELECT key, seq, CAST(sum(CASE WHEN side='BUY' THEN qty ELSE -qty END) OVER (PARTITION BY key ORDER BY trade_date, CASE WHEN side='BUY' THEN 0 ELSE 2 END, seq) AS BIGINT) AS balance FROM le""")
def running_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1."""
    ord_ = F.when(F.col("side") == "BUY", 0).otherwise(2)
    w = Window.partitionBy("key").orderBy("trade_date", ord_, "seq").rowsBetween(Window.unboundedPreceding, 0)
    return _events(spark, sf_dir).select("key", "seq", F.sum(F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))).over(w).alias("balance"))


@REGISTER(f"WITH {LE} SELECT key, arg_max(price, seq) AS last_price, max(seq) AS last_seq FROM le GROUP BY key")
def last_trade_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seq follows time here."""
    return _events(spark, sf_dir).groupBy("key").agg(F.max_by("price", "seq").alias("last_price"), F.max("seq").alias("last_seq"))


CROSS = f"""{LI}, p AS (SELECT portfolio, key, sum(CASE WHEN side='BUY' THEN qty ELSE -qty END) AS net, sum(CASE WHEN side='BUY' THEN turnover ELSE 0 END) AS bought FROM li GROUP BY ALL)"""


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = ledger.ledger_lines(spark, sf_dir)
    buy = F.col("side") == "BUY"
    return li.groupBy("portfolio", "key").agg(F.sum(F.when(buy, F.col("qty")).otherwise(-F.col("qty"))).alias("net"), F.sum(F.when(buy, F.col("turnover")).otherwise(0.0)).alias("bought"))


@REGISTER(f"""WITH {CROSS} SELECT key, CAST(sum(net) AS BIGINT) AS qty, {r2("sum(CASE WHEN net > 0 THEN bought ELSE 0 END)")} AS cost, count(*) AS accounts, arg_max(portfolio, net * 100 + portfolio) AS largest FROM p GROUP BY key""")
def cross_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of all portfolios together; negative ones count with cost zero."""
    worth = F.sum(F.when(F.col("net") > 0, F.col("bought")).otherwise(0.0))
    return _positions(spark, sf_dir).groupBy("key").agg(F.sum("net").alias("qty"), half_up(worth).alias("cost"), F.count(F.lit(1)).alias("accounts"), F.max_by("portfolio", F.col("net") * 100 + F.col("portfolio")).alias("largest"))


@REGISTER(f"""WITH {CROSS} SELECT portfolio, count(*) AS positions, {r2("sum(net * p_retailprice)")} AS value FROM p JOIN part ON key = p_partkey WHERE net > 0 GROUP BY ROLLUP (portfolio)""")
def aum_by_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: value of positions by portfolio and in all."""
    part = ledger.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_retailprice")
    rows = _positions(spark, sf_dir).filter("net > 0").join(part, "key")
    return rows.rollup("portfolio").agg(F.count(F.lit(1)).alias("positions"), half_up(F.sum(F.col("net") * F.col("p_retailprice"))).alias("value"))


@REGISTER(f"""WITH {CROSS} SELECT p_type AS industry, count(DISTINCT key) AS companies, {r2("sum(net * p_retailprice)")} AS value FROM p JOIN part ON key = p_partkey WHERE net > 0 GROUP BY p_type""")
def industry_alloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies first, then industries, so that no distinct count is needed."""
    part = ledger.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_type", "p_retailprice")
    one = _positions(spark, sf_dir).filter("net > 0").groupBy("key").agg(F.sum("net").alias("net")).join(part, "key")
    return one.groupBy(F.col("p_type").alias("industry")).agg(F.count(F.lit(1)).alias("companies"), half_up(F.sum(F.col("net") * F.col("p_retailprice"))).alias("value"))


WEIGHTS = f"""{CROSS}, v AS (SELECT portfolio, key, net * p_retailprice AS value FROM p JOIN part ON key = p_partkey WHERE net > 0),
w AS (SELECT *, value / sum(value) OVER (PARTITION BY portfolio) AS weight, row_number() OVER (PARTITION BY portfolio ORDER BY value DESC, key) AS rank FROM v)"""


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = ledger.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_retailprice")
    v = _positions(spark, sf_dir).filter("net > 0").join(part, "key").withColumn("value", F.col("net") * F.col("p_retailprice"))
    g = Window.partitionBy("portfolio")
    return v.select("portfolio", "key", "value", (F.col("value") / F.sum("value").over(g)).alias("weight"), F.row_number().over(g.orderBy(F.desc("value"), "key")).alias("rank"))


@REGISTER(f"WITH {WEIGHTS} SELECT portfolio, round(sum(weight * weight), 8) AS hhi, round(1 / sum(weight * weight), 4) AS effective_n FROM w GROUP BY portfolio")
def concentration_hhi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    s = F.sum(F.col("weight") * F.col("weight"))
    return _weights(spark, sf_dir).groupBy("portfolio").agg(F.round(s, 8).alias("hhi"), F.round(1 / s, 4).alias("effective_n"))


@REGISTER(f"WITH {WEIGHTS} SELECT portfolio, key, CAST(rank AS INTEGER) AS rank, round(sum(weight) OVER (PARTITION BY portfolio ORDER BY rank), 8) AS cumulative FROM w QUALIFY rank <= 10")
def top_n_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest positions and their cumulative share."""
    w = Window.partitionBy("portfolio").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return _weights(spark, sf_dir).filter("rank <= 10").select("portfolio", "key", "rank", F.round(F.sum("weight").over(w), 8).alias("cumulative"))


@REGISTER(f"""WITH {CROSS} SELECT portfolio, key FROM p WHERE bought > 0 AND net <= 0""")
def sold_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bought once, not held."""
    return _positions(spark, sf_dir).filter("bought > 0 and net <= 0").select("portfolio", "key")


@REGISTER(f"""WITH {LE}, w AS (SELECT key, CAST(sum(qty) // 3 AS BIGINT) AS wanted FROM le WHERE side='BUY' GROUP BY key),
b AS (SELECT le.key, seq, qty, wanted, coalesce(sum(qty) OVER (PARTITION BY le.key ORDER BY trade_date, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM le JOIN w ON le.key = w.key WHERE side='BUY')
SELECT key, seq, CAST(least(qty, wanted - before) AS BIGINT) AS take, CAST(0 AS BIGINT) AS shortfall FROM b WHERE wanted > before""")
def transfer_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of what was ever bought, oldest lots first."""
    buys = _events(spark, sf_dir).filter("side = 'BUY'")
    wanted = buys.groupBy("key").agg(F.floor(F.sum("qty") / 3).alias("wanted"))
    return lots.transfer_plan(buys, wanted, ["key"], ["trade_date", "seq"]).select("key", "seq", F.col("take").cast("bigint").alias("take"), F.col("shortfall").cast("bigint").alias("shortfall"))


@REGISTER(f"""WITH {LE}, d AS (SELECT DISTINCT trade_date FROM le), f AS (SELECT key, trade_date, sum(CASE WHEN side='BUY' THEN qty*price ELSE 0 END) AS spent FROM le GROUP BY ALL)
SELECT trade_date, {r2("sum(spent)")} AS flow, {r2("sum(sum(spent)) OVER (ORDER BY trade_date)")} AS invested FROM f GROUP BY trade_date""")
def invested_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money in by session and in all. One row a session reaches the single-partition window."""
    day = _events(spark, sf_dir).filter("side = 'BUY'").groupBy("trade_date").agg(F.sum(F.col("qty") * F.col("price")).alias("spent"))
    all_ = _events(spark, sf_dir).select("trade_date").distinct().join(day, "trade_date", "left").withColumn("spent", F.coalesce("spent", F.lit(0.0)))
    w = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    return all_.select("trade_date", half_up(F.col("spent")).alias("flow"), half_up(F.sum("spent").over(w)).alias("invested"))


@REGISTER(f"""WITH {GAINS}, c AS (SELECT portfolio, key, sum(qty) AS matched, sum(CASE WHEN term IN ('ST', 'LT') THEN qty ELSE 0 END) AS split, sum(CASE WHEN term IN ('ST', 'LT') THEN sale_amount ELSE 0 END) AS sold_for FROM gains GROUP BY ALL),
k AS (SELECT portfolio, key, max(cb) AS bought, max(cs) - max(d) AS due FROM u GROUP BY ALL), v AS (SELECT portfolio, key, sum((hi - lo) * price) AS due_for, count(*) AS n FROM s GROUP BY ALL)
SELECT count(*) AS keys, count(CASE WHEN coalesce(matched, 0) <= bought THEN 1 END) AS conserved, count(CASE WHEN coalesce(split, 0) = due THEN 1 END) AS partitioned, count(CASE WHEN abs(coalesce(sold_for, 0) - coalesce(due_for, 0)) <= 0.01 * (1 + coalesce(n, 0)) * 20 THEN 1 END) AS amounts FROM k LEFT JOIN c USING (portfolio, key) LEFT JOIN v USING (portfolio, key)""")
def partition_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q14: gains by term against the register that they come from, which is worked out from running sums of the ledger
    and not from lots: short and long term take up all of every sale that purchases cover, in shares and in money
    (paise are rounded for each lot), and no more is matched than was bought."""
    return checks.partitioned(ledger.ledger_lines(spark, sf_dir), _gains(spark, sf_dir), ["portfolio", "key"], ledger.LINE_ORDER)
