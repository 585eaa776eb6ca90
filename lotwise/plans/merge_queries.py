"""Idempotent imports and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators import merges
from lotwise.plans.register import CLOSES, LE, LI, Register
from lotwise.sources import ledger

REGISTER = Register()


@REGISTER(f"""WITH {LI}, a AS (SELECT trade_date, side, qty, turnover FROM li), b AS (SELECT trade_date, side, qty, turnover FROM li WHERE l_linenumber <= 2) SELECT * FROM a EXCEPT ALL SELECT * FROM b""")
def bag_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an import adds to a ledger that has some of its rows."""
    li = ledger.ledger_lines(spark, sf_dir)
    key = ["trade_date", "side", "qty", "turnover"]
    return merges.bag_difference(li.select(*key), li.filter("l_linenumber <= 2").select(*key), key, key)


@REGISTER(f"""WITH {LE}, n AS (SELECT * FROM le WHERE portfolio = 0 AND trade_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'), e AS (SELECT min(trade_date) AS a, max(trade_date) AS b FROM n)
SELECT portfolio, key, seq, trade_date FROM n UNION ALL SELECT portfolio, key, seq, trade_date FROM le, e WHERE trade_date < a OR trade_date > b""")
def slice_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K10."""
    le = ledger.ledger_events(spark, sf_dir).select("portfolio", "key", "seq", "trade_date")
    return merges.replace_slice(le, le.filter("portfolio = 0 and trade_date between date'2024-01-05' and date'2024-01-12'"), "trade_date")


DAYS = "o AS (SELECT key, max(session) AS od, arg_max(close, session) AS op FROM closes WHERE session < DATE '2024-01-15' GROUP BY key), n AS (SELECT key, max(session) AS nd, arg_max(close, session) AS np FROM closes WHERE session BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' GROUP BY key)"


@REGISTER(f"""WITH {CLOSES}, {DAYS} SELECT coalesce(o.key, n.key) AS key, CASE WHEN np IS NOT NULL AND (od IS NULL OR nd >= od) THEN np ELSE op END AS price,
  CASE WHEN np IS NOT NULL AND (od IS NULL OR nd >= od) THEN nd ELSE od END AS price_date, CASE WHEN np IS NOT NULL AND nd > od THEN op END AS previous_price FROM o FULL JOIN n ON o.key = n.key""")
def price_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4."""
    c = ledger.closes(spark, sf_dir)
    latest = lambda x: x.groupBy("key").agg(F.max_by("close", "session").alias("price"), F.max("session").alias("price_date"))
    old = latest(c.filter("session < date'2024-01-15'")).withColumn("previous_price", F.lit(None).cast("double"))
    return merges.upsert_prices(old, latest(c.filter("session between date'2024-01-10' and date'2024-01-20'")), ["key"])


@REGISTER(f"""WITH {CLOSES}, o AS (SELECT * FROM closes WHERE key % 3 <> 0), n AS (SELECT key, session, close + 1 AS close FROM closes WHERE session >= DATE '2024-01-15')
SELECT key, session, coalesce(o.close, n.close) AS close FROM o FULL JOIN n USING (key, session)""")
def fill_only_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6, K23."""
    c = ledger.closes(spark, sf_dir)
    new = c.filter("session >= date'2024-01-15'").withColumn("close", F.col("close") + 1)
    return merges.merge_history(c.filter("key % 3 <> 0"), new, ["key", "session"])


@REGISTER(f"""WITH {LE}, a AS (SELECT key, seq, trade_date FROM le WHERE side='SELL'), x AS (SELECT user_id AS key, CAST(ts AS DATE) AS ex FROM events WHERE event_type='error' AND event_id % 20 = 0)
SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.key = a.key AND abs(date_diff('day', x.ex, a.trade_date)) <= 5)""")
def interval_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales without an action of their key within five days."""
    sales = ledger.ledger_events(spark, sf_dir).filter("side = 'SELL'").select("key", "seq", "trade_date")
    acts = ledger.table(spark, sf_dir, "events").filter("event_type = 'error' and event_id % 20 = 0").select(F.col("user_id").alias("key"), F.col("ts").cast("date").alias("ex"))
    return merges.unmatched_within(sales, acts, ["key"], "trade_date", "ex", 5)


@REGISTER(f"""WITH {LE}, r AS (SELECT key, CAST(sum(qty) AS BIGINT) AS report FROM le WHERE side='BUY' AND seq % 50 <> 0 GROUP BY key), t AS (SELECT key, CAST(sum(qty) AS BIGINT) AS txn FROM le WHERE side='BUY' AND key % 10 <> 3 GROUP BY key)
SELECT key, report, txn, CASE WHEN txn IS NULL THEN 'missing-txns' WHEN report IS NULL THEN 'missing-report' WHEN abs(report - txn) <= 0.001 THEN 'ok' ELSE 'mismatch' END AS status FROM r FULL JOIN t USING (key)""")
def opening_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q12."""
    buys = ledger.ledger_events(spark, sf_dir).filter("side = 'BUY'")
    r = buys.filter("seq % 50 <> 0").groupBy("key").agg(F.sum("qty").alias("report"))
    t = buys.filter("key % 10 <> 3").groupBy("key").agg(F.sum("qty").alias("txn"))
    status = F.when(F.col("txn").isNull(), "missing-txns").when(F.col("report").isNull(), "missing-report").when(F.abs(F.col("report") - F.col("txn")) <= 0.001, "ok").otherwise("mismatch")
    return r.join(t, "key", "full").select("key", "report", "txn", status.alias("status"))
