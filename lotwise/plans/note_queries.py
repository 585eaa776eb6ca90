"""Allocation, reconciliation and charge checks of contract notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.functions.values import half_up
from lotwise.operators import allocate, checks
from lotwise.plans.register import LI, Register, r2
from lotwise.sources import ledger

REGISTER = Register()
#: An order stands for a note, its lines for the note's trades; lines are numbered, as some repeat.
NOTE = f"""{LI}, note AS (SELECT l_orderkey AS note, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, key, portfolio, trade_date, ord, qty, turnover, brokerage, stt) AS pos, key, side, qty, turnover, brokerage, stt,
  {r2("sum(brokerage) OVER (PARTITION BY l_orderkey) * 0.18")} AS gst FROM li)"""


def note_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Window.partitionBy("l_orderkey")
    order = ["l_linenumber", "key", "portfolio", "trade_date", "ord", "qty", "turnover", "brokerage", "stt"]
    li = ledger.ledger_lines(spark, sf_dir)
    return li.select(F.col("l_orderkey").alias("note"), F.row_number().over(g.orderBy(*order)).alias("pos"), "key", "side", "qty", "turnover", "brokerage", "stt", half_up(F.sum("brokerage").over(g) * 0.18).alias("gst"))


@REGISTER(f"""WITH {NOTE}, a AS (SELECT *, CASE WHEN brokerage > 0 THEN {r2("gst * brokerage / sum(brokerage) OVER (PARTITION BY note)")} ELSE 0 END AS raw, max(CASE WHEN brokerage > 0 THEN pos END) OVER (PARTITION BY note) AS lastpos, max(pos) OVER (PARTITION BY note) AS maxpos FROM note)
SELECT note, CAST(pos AS INTEGER) AS pos, {r2("raw + CASE WHEN pos = coalesce(lastpos, maxpos) THEN gst - sum(raw) OVER (PARTITION BY note) ELSE 0 END")} AS share FROM a""")
def alloc_prorata_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GST over the lines by brokerage, the rest on the last line that has any."""
    return allocate.pro_rata(note_lines(spark, sf_dir), ["note"], "brokerage", "gst", ["pos"]).select("note", "pos", "share")


@REGISTER(f"""WITH {NOTE}, a AS (SELECT *, {r2("gst * turnover / sum(turnover) OVER (PARTITION BY note)")} AS raw FROM note), b AS (SELECT *, row_number() OVER (PARTITION BY note ORDER BY raw DESC, pos) AS k FROM a)
SELECT note, CAST(pos AS INTEGER) AS pos, {r2("raw + CASE WHEN k = 1 THEN gst - sum(raw) OVER (PARTITION BY note) ELSE 0 END")} AS share FROM b""")
def alloc_tieout_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By turnover, the drift on the largest line."""
    return allocate.pro_rata(note_lines(spark, sf_dir), ["note"], "turnover", "gst", ["pos"], "largest").select("note", "pos", "share")


@REGISTER(f"""WITH {NOTE}, a AS (SELECT *, 100.0 * qty / sum(qty) OVER (PARTITION BY note) AS e FROM note), b AS (SELECT *, floor(e + 1e-9) AS f FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY note ORDER BY round(e - f, 9) DESC, pos) AS k, 100 - sum(f) OVER (PARTITION BY note) AS l FROM b)
SELECT note, CAST(pos AS INTEGER) AS pos, CAST(f + CASE WHEN k <= l THEN 1 ELSE 0 END AS BIGINT) AS share FROM c""")
def alloc_largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hundred shares over the lines by quantity."""
    rows = note_lines(spark, sf_dir).withColumn("units", F.lit(100.0))
    return allocate.largest_remainder(rows, ["note"], "qty", "units", ["pos"]).select("note", "pos", "share")




@REGISTER(f"""WITH {NOTE}, t AS (SELECT note, key, sum(CASE WHEN side='BUY' THEN qty ELSE 0 END) AS b, sum(CASE WHEN side='SELL' THEN qty ELSE 0 END) AS s, sum(CASE WHEN side='BUY' THEN turnover ELSE 0 END) AS bt, sum(CASE WHEN side='SELL' THEN turnover ELSE 0 END) AS st FROM note GROUP BY ALL)
SELECT note, key, {r2("0.001 * (CASE WHEN b > 0 THEN bt * (b - least(b, s)) / b ELSE 0 END + CASE WHEN s > 0 THEN st * (s - least(b, s)) / s ELSE 0 END)")} AS delivery, {r2("0.00025 * CASE WHEN s > 0 THEN st * least(b, s) / s ELSE 0 END")} AS intraday FROM t""")
def stt_statutory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8 without a printed total: a tenth of a percent of delivery turnover, a fortieth of matched sales."""
    of = lambda side, c: F.sum(F.when(F.col("side") == side, F.col(c)).otherwise(0))
    t = note_lines(spark, sf_dir).groupBy("note", "key").agg(of("BUY", "qty").alias("b"), of("SELL", "qty").alias("s"), of("BUY", "turnover").alias("bt"), of("SELL", "turnover").alias("st"))
    m = F.least("b", "s")
    part = lambda n, v, q: F.when(F.col(n) > 0, F.col(v) * q / F.col(n)).otherwise(0.0)
    return t.select("note", "key", half_up(0.001 * (part("b", "bt", F.col("b") - m) + part("s", "st", F.col("s") - m))).alias("delivery"), half_up(0.00025 * part("s", "st", m)).alias("intraday"))


@REGISTER(f"""WITH {NOTE}, t AS (SELECT note, side, qty + CASE WHEN note % 50 = 7 AND pos = 1 THEN 0.5 ELSE 0 END AS qty, turnover, stt, brokerage FROM note),
n AS (SELECT note, sum(CASE WHEN side='BUY' THEN turnover ELSE 0 END) AS buys, sum(CASE WHEN side='SELL' THEN turnover ELSE 0 END) AS sells, sum(stt) AS row_stt, sum(brokerage) AS brokerage, bool_or(abs(qty - round(qty)) > 0.000001) AS fractional FROM t GROUP BY note),
s AS (SELECT n.*, row_stt + CASE WHEN note % 5 = 1 THEN 0.2 ELSE 0.05 END - CASE WHEN note % 7 = 3 THEN row_stt ELSE 0 END AS stt, CASE note % 4 WHEN 0 THEN sells - buys WHEN 1 THEN abs(sells - buys) + brokerage * 0.9 WHEN 2 THEN 0 ELSE o_totalprice END AS obligation FROM n JOIN orders ON o_orderkey = note),
f AS (SELECT *, {r2("brokerage + stt")} AS charges FROM s),
x AS (SELECT *, abs(obligation) > 0.005 AND abs(abs(sells - buys) - abs(obligation)) > charges + 1 AS om, stt < 10 AND buys + sells > 100000 AS ss, abs(row_stt - stt) > 0.10 AS sm FROM f)
SELECT note, {r2("buys")} AS buys, {r2("sells")} AS sells, {r2("charges")} AS charges, fractional, om AS obligation_mismatch, ss AS suspicious_stt, sm AS stt_mismatch,
  CASE WHEN fractional THEN 'Fractional quantity' WHEN om THEN 'Obligation mismatch' WHEN ss THEN 'Suspicious STT' WHEN sm THEN 'Parser uncertain' ELSE 'PASSED' END AS status FROM x""")
def note_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that print what their rows give, or more tax, or hardly any, or another obligation, or half a
    share."""
    t = note_lines(spark, sf_dir).withColumn("qty", F.col("qty") + F.when((F.col("note") % 50 == 7) & (F.col("pos") == 1), 0.5).otherwise(0.0))
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("turnover")).otherwise(0.0))
    n = t.groupBy("note").agg(side("BUY").alias("b"), side("SELL").alias("s"), F.sum("stt").alias("x"), F.sum("brokerage").alias("brokerage"))
    n = n.join(ledger.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("note"), "o_totalprice"), "note")
    stt = F.col("x") + F.when(F.col("note") % 5 == 1, 0.2).otherwise(0.05) - F.when(F.col("note") % 7 == 3, F.col("x")).otherwise(0.0)
    net, kind = F.col("s") - F.col("b"), F.col("note") % 4
    printed = F.when(kind == 0, net).when(kind == 1, F.abs(net) + F.col("brokerage") * 0.9).when(kind == 2, 0.0).otherwise(F.col("o_totalprice"))
    summary = n.select("note", half_up(F.col("brokerage") + stt).alias("charges"), stt.alias("stt"), printed.alias("obligation"))
    return checks.reconciled(t, summary)


@REGISTER(f"""WITH {NOTE}, r(ord, rate) AS (VALUES (1, 0.01), (2, 0.02), (3, 0.03), (4, 0.04), (5, 0.05), (6, 0.06)),
h AS (SELECT note, pos, min(ord) AS hit FROM note JOIN r ON abs(stt - {r2("turnover * rate")}) < 0.006 GROUP BY ALL)
SELECT coalesce(h.hit, CASE WHEN stt = 0 THEN 0 ELSE -1 END) AS rate_id, count(*) AS n FROM note LEFT JOIN h USING (note, pos) GROUP BY 1""")
def charge_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the candidate rates a charge was computed at, the first that fits."""
    rates = (0.01, 0.02, 0.03, 0.04, 0.05, 0.06)  # the candidate table is part of the query
    fits = [F.when(F.abs(F.col("stt") - half_up(F.col("turnover") * r)) < 0.006, i + 1) for i, r in enumerate(rates)]
    hit = F.coalesce(*fits, F.when(F.col("stt") == 0, 0).otherwise(-1))
    return note_lines(spark, sf_dir).groupBy(hit.alias("rate_id")).agg(F.count(F.lit(1)).alias("n"))


@REGISTER(f"""WITH {NOTE}, a AS (SELECT *, CASE WHEN brokerage > 0 THEN {r2("gst * brokerage / sum(brokerage) OVER (PARTITION BY note)")} ELSE 0 END AS raw, max(CASE WHEN brokerage > 0 THEN pos END) OVER (PARTITION BY note) AS lastpos, max(pos) OVER (PARTITION BY note) AS maxpos FROM note),
b AS (SELECT note, gst, {r2("raw + CASE WHEN pos = coalesce(lastpos, maxpos) THEN gst - sum(raw) OVER (PARTITION BY note) ELSE 0 END")} AS share FROM a), n AS (SELECT note, abs(sum(share) - max(gst)) < 0.005 AS ok FROM b GROUP BY note)
SELECT count(*) AS notes, count(CASE WHEN ok THEN 1 END) AS conserved FROM n""")
def charge_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q13: allocated shares add up to the charge in every note."""
    rows = allocate.pro_rata(note_lines(spark, sf_dir), ["note"], "brokerage", "gst", ["pos"])
    g = rows.groupBy("note").agg(F.sum("share").alias("s"), F.max("gst").alias("t"))
    return g.agg(F.count(F.lit(1)).alias("notes"), F.count_if(F.abs(F.col("s") - F.col("t")) < 0.005).alias("conserved"))


@REGISTER(f"WITH {NOTE} SELECT note, key, side, CAST(sum(qty) AS BIGINT) AS qty, {r2('sum(turnover)')} AS turnover, {r2('sum(turnover) / sum(qty)')} AS price FROM note GROUP BY note, key, side")
def fill_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: fills of one name and side together at the weighted price."""
    g = note_lines(spark, sf_dir).groupBy("note", "key", "side").agg(F.sum("qty").alias("qty"), F.sum("turnover").alias("t"))
    return g.select("note", "key", "side", "qty", half_up(F.col("t")).alias("turnover"), half_up(F.col("t") / F.col("qty")).alias("price"))
