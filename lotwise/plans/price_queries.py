"""As-of prices, filled series, indices, risk and returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.functions.values import half_up
from lotwise.operators import prices, pricing
from lotwise.plans.register import CLOSES, LE, Register, r2
from lotwise.sources import ledger

REGISTER = Register()
ASK = "ask AS (SELECT user_id AS key, event_id AS seq, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'error')"


def _asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").cast("date").alias("day"))


@REGISTER(f"WITH {CLOSES}, {ASK} SELECT a.key, a.seq, c.session, c.close FROM ask a ASOF LEFT JOIN closes c ON a.key = c.key AND a.day >= c.session")
def asof_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15, J19."""
    return prices.as_of(_asks(spark, sf_dir), ledger.closes(spark, sf_dir), ["key"], "day", "session", "close").select("key", "seq", "session", "close")


@REGISTER(f"WITH {CLOSES}, {ASK} SELECT a.key, a.seq, c.session, c.close FROM ask a ASOF LEFT JOIN closes c ON a.key = c.key AND a.day <= c.session")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J16."""
    return prices.as_of(_asks(spark, sf_dir), ledger.closes(spark, sf_dir), ["key"], "day", "session", "close", forward=True).select("key", "seq", "session", "close")


#: Every second event asks; closes stand at every third session only, so that looking back crosses gaps.
THIN = f"""{CLOSES}, c3 AS (SELECT * FROM closes WHERE (key + day(session)) % 9 = 0 AND key % 5 > 0), days AS (SELECT session, row_number() OVER (ORDER BY session) AS idx FROM (SELECT DISTINCT session FROM c3)),
c4 AS (SELECT c3.*, idx FROM c3 JOIN days USING (session)),
asks AS (SELECT user_id AS key, event_id AS seq, CAST(ts AS DATE) - CAST(event_id % 3 AS INTEGER) AS day FROM events WHERE event_type = 'error'),
placed AS (SELECT a.*, (SELECT max(idx) FROM days WHERE session <= a.day) AS here FROM asks a),
found AS (SELECT t.key, t.seq, max(c.idx) AS idx FROM placed t JOIN c4 c ON c.key = t.key AND c.idx BETWEEN t.here - 7 AND t.here GROUP BY t.key, t.seq),
look AS (SELECT t.key, t.seq, t.day, c.session, c.close AS price, coalesce(f.idx < t.here, false) AS carried,
  CASE WHEN t.key NOT IN (SELECT key FROM c4) THEN 'no-column' WHEN t.here IS NULL THEN 'before-history' WHEN f.idx IS NULL THEN 'no-close' ELSE '' END AS miss
  FROM placed t LEFT JOIN found f USING (key, seq) LEFT JOIN c4 c ON c.key = t.key AND c.idx = f.idx)"""


def _looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = ledger.closes(spark, sf_dir).filter("(key + day(session)) % 9 = 0 and key % 5 > 0")
    ev = ledger.table(spark, sf_dir, "events").filter("event_type = 'error'")
    asks = ev.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.date_sub(F.col("ts").cast("date"), (F.col("event_id") % 3).cast("int")).alias("day"))
    return pricing.session_prices(asks, grid)


@REGISTER(f"WITH {THIN} SELECT key, seq, session, price, carried, miss FROM look")
def price_lookback7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the grid are counted, not days."""
    return _looked_up(spark, sf_dir).select("key", "seq", "session", "price", "carried", "miss")


@REGISTER(f"""WITH {THIN}, m AS (SELECT key % 10 AS report, session, count(*) AS n FROM look WHERE session IS NOT NULL GROUP BY ALL), d AS (SELECT report, session AS pricing_date FROM m QUALIFY row_number() OVER (PARTITION BY report ORDER BY n DESC, session DESC) = 1)
SELECT key % 10 AS report, seq, price, miss, pricing_date, coalesce(session < pricing_date, false) AS stale FROM look LEFT JOIN d ON report = key % 10""")
def report_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date that most rows of a report are priced at, and which rows are older."""
    rows = _looked_up(spark, sf_dir).withColumn("report", F.col("key") % 10)
    out = rows.join(pricing.modal_date(rows, ["report"]), "report", "left")
    return out.select("report", "seq", "price", "miss", "pricing_date", F.coalesce(F.col("session") < F.col("pricing_date"), F.lit(False)).alias("stale"))


GRID = f"""{CLOSES}, s AS (SELECT session, row_number() OVER (ORDER BY session) AS idx FROM (SELECT DISTINCT session FROM closes)),
grid AS (SELECT k.key, s.session, s.idx, c.close FROM (SELECT DISTINCT key FROM closes) k CROSS JOIN s LEFT JOIN closes c ON c.key = k.key AND c.session = s.session)"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key at every session: each key's row is exploded over the calendar, which is one short array."""
    c = ledger.closes(spark, sf_dir)
    calendar = c.agg(F.array_sort(F.collect_set("session")).alias("days")).withColumn("one", F.lit(1))
    cells = c.select("key").distinct().withColumn("one", F.lit(1)).join(F.broadcast(calendar), "one").select("key", F.posexplode("days").alias("i", "session"))
    return cells.select("key", "session", (F.col("i") + 1).alias("idx")).join(c, ["key", "session"], "left")


@REGISTER(f"""WITH {GRID}, p AS (SELECT *, sum(CASE WHEN idx % 11 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY idx) AS part FROM grid),
l AS (SELECT *, max(CASE WHEN close IS NOT NULL THEN idx END) OVER (PARTITION BY key, part ORDER BY idx) AS at FROM p)
SELECT l.key, l.session, CASE WHEN l.idx - l.at <= 3 THEN g.close END AS filled FROM l LEFT JOIN grid g ON g.key = l.key AND g.idx = l.at""")
def ffill_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three sessions, and not across every eleventh, which stands for a corporate action."""
    g = _grid(spark, sf_dir).withColumn("cut", F.col("idx") % 11 == 0)
    return prices.bounded_fill(g, ["key"], boundary="cut", most=3).select("key", "session", "filled")


SPLITS = "splits AS (SELECT user_id AS key, CAST(ts AS DATE) AS session, 2.0 AS factor FROM events WHERE event_type = 'signup' AND event_id % 40 = 0 GROUP BY ALL)"


@REGISTER(f"WITH {CLOSES}, {SPLITS} SELECT c.key, c.session, round(c.close * power(2, count(s.key)), 6) AS raw_close FROM closes c LEFT JOIN splits s ON s.key = c.key AND s.session > c.session GROUP BY c.key, c.session, c.close")
def unadjust_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes times all later split factors."""
    splits = ledger.table(spark, sf_dir, "events").filter("event_type = 'signup' and event_id % 40 = 0").select(F.col("user_id").alias("key"), F.col("ts").cast("date").alias("session"), F.lit(2.0).alias("factor")).distinct()
    out = prices.unadjusted(ledger.closes(spark, sf_dir), splits, ["key"])
    return out.select("key", "session", F.round("raw_close", 6).alias("raw_close"))


NAV = f"""{LE}, nav AS (SELECT portfolio, trade_date AS session, sum(qty * price) AS nav, sum(CASE WHEN side='SELL' THEN qty * price ELSE 0 END) / 10 AS flow FROM le GROUP BY ALL)"""


def _nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    cash = F.col("qty") * F.col("price")
    return ledger.ledger_events(spark, sf_dir).groupBy("portfolio", F.col("trade_date").alias("session")).agg(F.sum(cash).alias("nav"), (F.sum(F.when(F.col("side") == "SELL", cash).otherwise(0.0)) / 10).alias("flow"))


INDEX = f"""{NAV}, f AS (SELECT *, (nav - flow) / lag(nav) OVER (PARTITION BY portfolio ORDER BY session) AS r FROM nav),
ix AS (SELECT portfolio, session, nav, 1000 * exp(sum(CASE WHEN r > 0 THEN ln(r) ELSE 0 END) OVER (PARTITION BY portfolio ORDER BY session)) AS idx FROM f)"""


@REGISTER(f"WITH {INDEX} SELECT portfolio, session, round(idx, 4) AS twr_index FROM ix")
def twr_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3."""
    return prices.twr(_nav(spark, sf_dir), ["portfolio"]).select("portfolio", "session", F.round("index", 4).alias("twr_index"))


@REGISTER(f"WITH {INDEX} SELECT portfolio, session, round(1000 * idx / first_value(idx) OVER (PARTITION BY portfolio ORDER BY session), 4) AS rebased FROM ix WHERE session >= DATE '2024-01-10'")
def rebase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series from 10 January, 1000 at its first session."""
    s = prices.twr(_nav(spark, sf_dir), ["portfolio"]).filter("session >= date'2024-01-10'")
    w = Window.partitionBy("portfolio").orderBy("session")
    return s.select("portfolio", "session", F.round(1000 * F.col("index") / F.first("index").over(w), 4).alias("rebased"))


@REGISTER(f"WITH {INDEX}, d AS (SELECT *, idx / lag(idx) OVER (PARTITION BY portfolio ORDER BY session) - 1 AS r FROM ix) SELECT portfolio, session, round(r, 8) AS r FROM d WHERE r IS NOT NULL")
def daily_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5."""
    return _returns(spark, sf_dir).select("portfolio", "session", F.round("r", 8).alias("r"))


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = prices.twr(_nav(spark, sf_dir), ["portfolio"])
    r = F.col("index") / F.lag("index").over(Window.partitionBy("portfolio").orderBy("session")) - 1
    return s.withColumn("r", r).filter("r is not null")


@REGISTER(f"""WITH {INDEX}, t AS (SELECT *, max(idx) OVER (PARTITION BY portfolio ORDER BY session) AS top FROM ix), d AS (SELECT *, idx / top - 1 AS dd FROM t),
w AS (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY dd, session) AS k FROM d)
SELECT w.portfolio, round(w.dd, 8) AS max_drawdown, w.session AS trough, min(ix.session) AS peak FROM w JOIN ix ON ix.portfolio = w.portfolio AND ix.idx = w.top AND k = 1 GROUP BY ALL""")
def max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6."""
    return prices.drawdown(prices.twr(_nav(spark, sf_dir), ["portfolio"]), ["portfolio"], "session", "index").withColumn("max_drawdown", F.round("max_drawdown", 8))


@REGISTER(f"""WITH {INDEX}, d AS (SELECT *, idx / lag(idx) OVER (PARTITION BY portfolio ORDER BY session) - 1 AS r FROM ix)
SELECT portfolio, round(avg(r), 8) AS mean, round(stddev_samp(r) * sqrt(252), 8) AS annual_vol, arg_max(session, r) AS best, arg_min(session, r) AS worst, round(quantile_cont(r, 0.5), 8) AS median FROM d WHERE r IS NOT NULL GROUP BY portfolio""")
def risk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6, A14, A15, W7."""
    g = _returns(spark, sf_dir).groupBy("portfolio")
    return g.agg(F.round(F.avg("r"), 8).alias("mean"), F.round(F.stddev_samp("r") * F.sqrt(F.lit(252.0)), 8).alias("annual_vol"), F.max_by("session", "r").alias("best"), F.min_by("session", "r").alias("worst"), F.round(F.median("r"), 8).alias("median"))


@REGISTER(f"""WITH {INDEX}, e AS (SELECT portfolio, max(session) AS last FROM ix GROUP BY portfolio), n AS (SELECT ix.portfolio, arg_max(idx, session) AS v, max(session) AS s FROM ix GROUP BY portfolio),
o AS (SELECT e.portfolio, arg_max(idx, session) AS v FROM e JOIN ix ON ix.portfolio = e.portfolio AND ix.session <= e.last - 14 GROUP BY e.portfolio)
SELECT n.portfolio, round(n.v / o.v - 1, 8) AS ret FROM n JOIN o USING (portfolio)""")
def period_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The return over the last fourteen days, as of the session then."""
    s = prices.twr(_nav(spark, sf_dir), ["portfolio"])
    last = F.max("session").over(Window.partitionBy("portfolio"))
    then = F.max_by("index", F.when(F.col("session") <= F.date_sub("last", 14), F.col("session")))
    return s.withColumn("last", last).groupBy("portfolio").agg(F.max_by("index", "session").alias("now"), then.alias("then")).select("portfolio", F.round(F.col("now") / F.col("then") - 1, 8).alias("ret"))


@REGISTER(f"""WITH {NAV}, c AS (SELECT portfolio, session, nav, 1 - flow / nav AS coverage FROM nav), m AS (SELECT portfolio, quantile_cont(coverage, 0.5) AS med FROM c GROUP BY portfolio)
SELECT c.portfolio, min(session) AS first, max(session) AS last FROM c JOIN m USING (portfolio) WHERE med >= 0.8 AND coverage >= greatest(0.8, least(0.98, med - 0.01)) GROUP BY c.portfolio""")
def endpoint_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last session whose coverage is near the median."""
    c = _nav(spark, sf_dir).withColumn("coverage", 1 - F.col("flow") / F.col("nav"))
    m = c.groupBy("portfolio").agg(F.median("coverage").alias("med"))
    ok = (F.col("med") >= 0.8) & (F.col("coverage") >= F.greatest(F.lit(0.8), F.least(F.lit(0.98), F.col("med") - 0.01)))
    return c.join(m, "portfolio").filter(ok).groupBy("portfolio").agg(F.min("session").alias("first"), F.max("session").alias("last"))


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ledger.table(spark, sf_dir, "orders")
    sign = F.when(F.col("o_orderkey") % 3 == 0, 1.0).otherwise(-1.0)
    return o.select(F.col("o_custkey").alias("key"), F.col("o_orderdate").cast("date").alias("ts"), (sign * F.col("o_totalprice")).alias("amount"))


@REGISTER("""WITH RECURSIVE f AS (SELECT o_custkey AS key, CAST(o_orderdate AS DATE) AS ts, sum(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE -o_totalprice END) AS amount FROM orders WHERE o_totalprice <> 0 GROUP BY ALL),
y AS (SELECT *, date_diff('day', min(ts) OVER (PARTITION BY key), ts) / 365.0 AS years, sum(amount) OVER (PARTITION BY key ORDER BY ts) AS run FROM f), z AS (SELECT key, ts, sign(run) AS sg, lag(sign(run)) OVER (PARTITION BY key ORDER BY ts) AS was FROM y WHERE run <> 0),
g AS (SELECT key, list({'y': CAST(years AS DOUBLE), 'a': amount} ORDER BY ts) AS fl, count(*) AS n, min(amount) AS lo_, max(amount) AS hi_ FROM y GROUP BY key),
s AS (SELECT g.*, sign(list_sum([x.a / power(1 - 0.9999999, x.y) FOR x IN fl])) AS sl FROM g), c AS (SELECT key, min(i) AS i FROM s, range(0, 14) AS r(i) WHERE sign(list_sum([x.a / power(1 + (0.2 * power(2.0, i) - 0.1), x.y) FOR x IN fl])) <> sl GROUP BY key),
b AS (SELECT s.key, 0 AS step, CAST(-0.9999999 AS DOUBLE) AS lo, CAST(0.2 * power(2.0, c.i) - 0.1 AS DOUBLE) AS hi FROM s JOIN c USING (key) UNION ALL
  SELECT b.key, step + 1, CASE WHEN sign(list_sum([x.a / power(1 + (lo + hi) / 2, x.y) FOR x IN fl])) = sl THEN (lo + hi) / 2 ELSE lo END, CASE WHEN sign(list_sum([x.a / power(1 + (lo + hi) / 2, x.y) FOR x IN fl])) = sl THEN hi ELSE (lo + hi) / 2 END FROM b JOIN s USING (key) WHERE step < 60),
t AS (SELECT key, count(CASE WHEN sg <> was THEN 1 END) > 1 AS ambiguous FROM z GROUP BY key)
SELECT g.key, CASE WHEN n >= 2 AND lo_ < 0 AND hi_ > 0 THEN round((lo + hi) / 2, 6) END AS rate, coalesce(ambiguous, false) AS ambiguous FROM g LEFT JOIN (SELECT * FROM b WHERE step = 60) e USING (key) LEFT JOIN t USING (key)""")
def xirr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: bisection within built-in expressions."""
    return prices.xirr(_flows(spark, sf_dir), ["key"]).select("key", F.round("rate", 6).alias("rate"), "ambiguous")


@REGISTER(f"""WITH f AS (SELECT o_custkey AS key, CAST(o_orderdate AS DATE) AS ts, sum(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE -o_totalprice END) AS amount FROM orders GROUP BY ALL),
a AS (SELECT *, date_diff('day', min(ts) OVER (PARTITION BY key), ts) / 365.0 AS years FROM f)
SELECT key, {r2("sum(amount / power(1.1, years))")} AS npv FROM a GROUP BY key""")
def npv_at_ten_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1."""
    f = _flows(spark, sf_dir).groupBy("key", "ts").agg(F.sum("amount").alias("amount"))
    years = F.datediff("ts", F.min("ts").over(Window.partitionBy("key"))) / 365.0
    return f.withColumn("years", years).groupBy("key").agg(half_up(F.sum(F.col("amount") / F.pow(F.lit(1.1), F.col("years")))).alias("npv"))


@REGISTER("""WITH s AS (SELECT o_custkey AS key, o_orderkey, sum(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE -1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS run, o_orderdate FROM orders),
z AS (SELECT key, sign(run) AS sg, lag(sign(run)) OVER (PARTITION BY key ORDER BY o_orderdate, o_orderkey) AS was FROM s WHERE run <> 0)
SELECT key, count(CASE WHEN sg <> was THEN 1 END) AS turns FROM z GROUP BY key""")
def cashflow_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the running balance changes its sign."""
    o = ledger.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderdate", "o_orderkey")
    w = Window.partitionBy("key").orderBy("o_orderdate", "o_orderkey")
    run = F.sum(F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(-1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    z = o.withColumn("sg", F.signum(run)).filter("sg <> 0").withColumn("was", F.lag("sg").over(w))
    return z.groupBy("key").agg(F.count_if(F.col("sg") != F.col("was")).alias("turns"))
