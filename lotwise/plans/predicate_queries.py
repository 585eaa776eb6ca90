"""Projections, filters and small rules of the ledger, each over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.functions import values
from lotwise.functions.values import half_up
from lotwise.operators import checks, reports
from lotwise.plans.note_queries import NOTE, note_lines
from lotwise.plans.register import LE, LI, Register, r2, r6
from lotwise.sources import ledger

REGISTER = Register()


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ledger_lines(spark, sf_dir)


#: Lines of which some lack a turnover or a total.
GAPPY = f"""{LI}, g AS (SELECT l_orderkey, l_linenumber, key, qty, price, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE turnover END AS turnover,
  CASE WHEN l_orderkey % 4 = 0 THEN {r2("turnover + brokerage + stt")} WHEN l_orderkey % 4 = 1 THEN 0 END AS total FROM li)"""


@REGISTER(f"""WITH {GAPPY} SELECT l_orderkey, l_linenumber, key, {r6("CASE WHEN total > 0 THEN total / qty WHEN turnover > 0 THEN turnover / qty ELSE price END")} AS buy_price, {r6("CASE WHEN turnover > 0 THEN turnover / qty ELSE price END")} AS gain_price FROM g""")
def price_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6, P7."""
    k = F.col("l_orderkey")
    total = F.when(k % 4 == 0, half_up(F.col("turnover") + F.col("brokerage") + F.col("stt"))).when(k % 4 == 1, 0.0)
    g = _lines(spark, sf_dir).withColumn("total", total).withColumn("turnover", F.when(k % 3 != 0, F.col("turnover")))
    return g.select("l_orderkey", "l_linenumber", "key", half_up(values.buy_price(F.col("total"), F.col("turnover"), F.col("price"), F.col("qty")), 6).alias("buy_price"), half_up(values.gain_price(F.col("turnover"), F.col("price"), F.col("qty")), 6).alias("gain_price"))


DATED = """d AS (SELECT event_id AS seq, user_id AS key, CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS day, value FROM events)"""


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = ledger.table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), F.when(F.col("event_id") % 13 != 0, F.col("ts").cast("date")).alias("day"), "value")


@REGISTER(f"""WITH {DATED} SELECT 'kept' AS undated, count(*) AS n, {r2("sum(value)")} AS value FROM d WHERE day IS NULL OR day BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'
UNION ALL SELECT 'dropped', count(*), {r2("sum(value)")} FROM d WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'""")
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports keep undated rows, expenses drop them."""
    d = _dated(spark, sf_dir)
    out = [reports.within(d, "day", "2024-01-05", "2024-01-12", undated).agg(F.count(F.lit(1)).alias("n"), half_up(F.sum("value")).alias("value")).select(F.lit(name).alias("undated"), "n", "value") for name, undated in (("kept", True), ("dropped", False))]
    return out[0].unionAll(out[1])


@REGISTER("""SELECT doc_id, source, lang FROM documents WHERE contains(lower(text || ' ' || source || ' ' || lang), 'src1') AND contains(lower(text || ' ' || source || ' ' || lang), 'the')""")
def term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: all terms, each in any of the columns."""
    docs = ledger.table(spark, sf_dir, "documents")
    return docs.filter(reports.has_terms("  SRC1 the", ["text", "source", "lang"])).select("doc_id", "source", "lang")


@REGISTER("SELECT DISTINCT o_orderpriority AS value FROM orders WHERE trim(o_orderpriority) <> ''")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11."""
    return reports.distinct_values(ledger.table(spark, sf_dir, "orders"), "o_orderpriority")


@REGISTER(f"""WITH {LI}, p AS (SELECT key, sum(CASE WHEN side='BUY' THEN qty ELSE -qty END) AS net, count(DISTINCT portfolio) AS accounts FROM li GROUP BY key)
SELECT p.key, CAST(net AS BIGINT) AS net, p_name AS name, CASE WHEN p_size % 5 = 0 THEN 'PE' WHEN p_size % 5 = 1 THEN 'AIF' ELSE 'listed' END AS segment FROM p JOIN part ON p.key = p_partkey WHERE contains(p_name, 'ring') AND p_size % 5 IN (0, 1) AND net <> 0""")
def holdings_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings of two segments whose name holds a term."""
    part = ledger.table(spark, sf_dir, "part")
    segment = F.when(F.col("p_size") % 5 == 0, "PE").when(F.col("p_size") % 5 == 1, "AIF").otherwise("listed")
    signed = F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))
    few = part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), segment.alias("segment")).filter(reports.has_terms("Ring", ["name"]) & F.col("segment").isin("PE", "AIF"))
    return _lines(spark, sf_dir).groupBy("key").agg(F.sum(signed).alias("net")).filter("net <> 0").join(few, "key").select("key", "net", "name", "segment")


@REGISTER(f"""WITH {LI}, s AS (SELECT p_partkey AS key FROM part WHERE p_name = (SELECT p_name FROM part WHERE p_partkey = 7)) SELECT portfolio, key, trade_date, side, CAST(qty AS BIGINT) AS qty FROM li WHERE key IN (SELECT key FROM s)""")
def scrip_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one security, by any key that shares its name."""
    part = ledger.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    return reports.of_scrip(_lines(spark, sf_dir), part, part.filter("key = 7")).select("portfolio", "key", "trade_date", "side", "qty")


CLASSED = "cl AS (SELECT p_partkey AS key, CASE p_size % 5 WHEN 0 THEN 'PE' WHEN 1 THEN 'AIF' WHEN 2 THEN 'MF' END AS class, DATE '1996-01-01' + CAST(p_size * 30 AS INTEGER) AS listed_from FROM part)"


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    kind = F.when(size % 5 == 0, "PE").when(size % 5 == 1, "AIF").when(size % 5 == 2, "MF")
    return ledger.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), kind.alias("class"), F.date_add(F.lit("1996-01-01").cast("date"), size * 30).alias("listed_from"))


@REGISTER(f"""WITH {LI}, {CLASSED} SELECT coalesce(CASE WHEN trade_date < listed_from THEN class END, 'listed') AS class, side, count(*) AS n, CAST(sum(qty) AS BIGINT) AS qty FROM li JOIN cl USING (key) GROUP BY ALL""")
def class_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the class that their security had on their day."""
    rows = reports.classed(_lines(spark, sf_dir), _classes(spark, sf_dir), "trade_date")
    return rows.groupBy(F.coalesce("class_then", F.lit("listed")).alias("class"), "side").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"))


@REGISTER(f"""WITH {NOTE}, r AS (SELECT note, pos, CASE WHEN note % 6 = 0 THEN ' nse ' WHEN note % 6 = 1 THEN '' ELSE 'S' || key END AS name, CASE WHEN note % 10 = 2 THEN 10000000 WHEN note % 10 = 3 THEN 0 ELSE qty END AS qty, CASE WHEN note % 14 = 4 THEN NULL ELSE turnover / qty END AS price FROM note)
SELECT note, CAST(pos AS INTEGER) AS pos FROM r WHERE trim(name) NOT IN ('', 'nse') AND qty > 0 AND qty < 10000000 AND price > 0""")
def note_row_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P16."""
    n = F.col("note")
    name = F.when(n % 6 == 0, " nse ").when(n % 6 == 1, "").otherwise(F.concat(F.lit("S"), "key"))
    qty = F.when(n % 10 == 2, 10_000_000).when(n % 10 == 3, 0).otherwise(F.col("qty"))
    rows = note_lines(spark, sf_dir).withColumn("price", F.when(n % 14 != 4, F.col("turnover") / F.col("qty")))
    return rows.filter(checks.valid_row(name, qty, F.col("price"))).select("note", "pos")


@REGISTER("""SELECT o_orderkey AS import_id, CAST(o_orderdate AS DATE) AS day, CASE o_orderstatus WHEN 'F' THEN 'Imported' WHEN 'O' THEN 'Reversed' ELSE 'Failed' END AS status, o_orderstatus = 'F' AND o_orderkey % 5 > 0 AS can_rewind,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INTEGER) AS place FROM orders""")
def import_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's log, newest first, with what can be rewound: imports that stand and have an id."""
    o = ledger.table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "Imported").when(F.col("o_orderstatus") == "O", "Reversed").otherwise("Failed")
    log = o.select(F.col("o_orderkey").alias("row"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey")).alias("id"), "o_custkey", "o_orderdate", status.alias("status"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("row")))
    return log.select(F.col("row").alias("import_id"), F.col("o_orderdate").cast("date").alias("day"), "status", ((F.col("status") == "Imported") & F.col("id").isNotNull()).alias("can_rewind"), place.alias("place"))


@REGISTER(f"""WITH {LI}, m AS (SELECT l_orderkey, l_linenumber, CASE l_orderkey % 5 WHEN 0 THEN 'Bonus' WHEN 1 THEN 'Split' WHEN 2 THEN 'Sell' WHEN 3 THEN 'Transfer Out' ELSE 'Buy' END AS tx_type, qty, price, brokerage, stt FROM li),
t AS (SELECT *, tx_type IN ('Bonus', 'Split') AS free, tx_type IN ('Sell', 'Transfer Out') AS sell FROM m)
SELECT l_orderkey, l_linenumber, tx_type, CASE WHEN free THEN 0 ELSE price END AS price, CASE WHEN free THEN 0 ELSE {r2("qty * price")} END AS turnover,
  CASE WHEN free THEN 0 WHEN sell THEN {r2(r2("qty * price") + " - (brokerage + stt)")} ELSE {r2(r2("qty * price") + " + (brokerage + stt)")} END AS total_incl_stt,
  CASE WHEN free THEN 0 WHEN sell THEN {r2(r2("qty * price") + " - brokerage")} ELSE {r2(r2("qty * price") + " + brokerage")} END AS total_excl_stt FROM t""")
def manual_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is filed for a trade typed in by hand: free shares cost nothing, charges add to a purchase and
    take from a sale."""
    kind = F.get(F.array(*map(F.lit, ("Bonus", "Split", "Sell", "Transfer Out", "Buy"))), (F.col("l_orderkey") % 5).cast("int"))
    rows = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", kind.alias("tx_type"), "qty", "price", F.col("brokerage").alias("charges"), "stt")
    return reports.manual_record(rows).select("l_orderkey", "l_linenumber", "tx_type", "price", "turnover", "total_incl_stt", "total_excl_stt")


@REGISTER(f"""WITH {LI}, m AS (SELECT l_orderkey, l_linenumber, l_orderkey % 3 AS e, CASE WHEN l_orderkey % 7 = 1 THEN 0 ELSE CAST(qty AS DOUBLE) END AS q, CASE WHEN l_orderkey % 7 = 2 THEN 0 ELSE {r2("price")} END AS p, CASE WHEN l_orderkey % 7 = 3 THEN 0 ELSE turnover + 1 END AS a FROM li)
SELECT l_orderkey, l_linenumber, CASE WHEN e = 1 AND p > 0 AND q <= 0 AND a > 0 THEN {r6("a / p")} WHEN e = 2 AND a > 0 AND q <= 0 AND p > 0 THEN {r6("a / p")} ELSE q END AS qty,
  CASE WHEN e = 0 AND q > 0 AND p <= 0 AND a > 0 THEN {r6("a / q")} WHEN e = 2 AND a > 0 AND q > 0 THEN {r6("a / q")} ELSE p END AS price,
  CASE WHEN e = 0 AND q > 0 AND p > 0 THEN {r2("q * p")} WHEN e = 1 AND p > 0 AND q > 0 THEN {r2("q * p")} ELSE a END AS amount FROM m""")
def solve_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20: any two of quantity, price and amount give the third."""
    k = F.col("l_orderkey")
    rows = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.when(k % 7 == 1, 0.0).otherwise(F.col("qty").cast("double")).alias("q"), F.when(k % 7 == 2, 0.0).otherwise(half_up(F.col("price"))).alias("p"), F.when(k % 7 == 3, 0.0).otherwise(F.col("turnover") + 1).alias("a"))
    ways = [values.solved(e, F.col("q"), F.col("p"), F.col("a")) for e in ("qty", "price", "amount")]
    return rows.select("l_orderkey", "l_linenumber", *(F.coalesce(*(F.when(k % 3 == i, w[c]) for i, w in enumerate(ways))).alias(c) for c in ("qty", "price", "amount")))


@REGISTER(f"""WITH {NOTE}, t AS (SELECT *, CASE WHEN note % 5 = 0 THEN 'INTRADAY ' WHEN note % 5 = 1 THEN 'Delivery' END AS said, sum(CASE WHEN side='BUY' THEN qty ELSE 0 END) OVER (PARTITION BY note, key % 3) AS b, sum(CASE WHEN side='SELL' THEN qty ELSE 0 END) OVER (PARTITION BY note, key % 3) AS s FROM note)
SELECT note, CAST(pos AS INTEGER) AS pos, CASE WHEN note % 5 = 0 THEN 'Intraday' WHEN note % 5 = 1 THEN 'Delivery' WHEN b > 0 AND b = s THEN 'Intraday' ELSE 'Delivery' END AS by_equal, CASE WHEN note % 5 = 0 THEN 'Intraday' WHEN note % 5 = 1 THEN 'Delivery' WHEN b > 0 AND s > 0 THEN 'Intraday' ELSE 'Delivery' END AS by_both FROM t""")
def trade_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10: words first, then quantities, by either sender's rule."""
    w = Window.partitionBy("note", F.col("key") % 3)
    of = lambda side: F.sum(F.when(F.col("side") == side, F.col("qty")).otherwise(0)).over(w)
    rows = note_lines(spark, sf_dir).withColumns({"b": of("BUY"), "s": of("SELL"), "said": F.when(F.col("note") % 5 == 0, "INTRADAY ").when(F.col("note") % 5 == 1, "Delivery")})
    return rows.select("note", "pos", *(checks.trade_class(F.col("said"), F.col("b"), F.col("s"), e).alias(n) for n, e in (("by_equal", True), ("by_both", False))))


@REGISTER("""WITH r(i, text, num, den) AS (VALUES (0, '1:2', 1.0, 2.0), (1, ' 3 / 4 ', 3.0, 4.0), (2, '2.5-1', 2.5, 1.0), (3, '0:5', NULL, NULL), (4, '5', NULL, NULL), (5, '', NULL, NULL), (6, NULL, NULL, NULL), (7, '10:1', 10.0, 1.0)),
e AS (SELECT event_id AS seq, event_id % 8 AS i, CASE WHEN event_id % 3 = 0 THEN 'Split' ELSE 'Bonus' END AS kind, value - 5 AS held FROM events)
SELECT seq, CAST(num AS DOUBLE) AS num, CAST(den AS DOUBLE) AS den, CASE WHEN num IS NULL THEN 0 WHEN held <= 0.000000001 THEN 0 ELSE greatest(0, floor(held * (num / den - CASE WHEN kind = 'Split' THEN 1 ELSE 0 END) * 1000000 + 0.5) / 1000000) END AS added FROM e JOIN r USING (i)""")
def ratio_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios as written, and what they add to a holding."""
    said = F.get(F.array(*map(F.lit, ("1:2", " 3 / 4 ", "2.5-1", "0:5", "5", "", None, "10:1"))), (F.col("event_id") % 8).cast("int"))
    kind = F.when(F.col("event_id") % 3 == 0, "Split").otherwise("Bonus")
    rows = ledger.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), values.parse_ratio(said).alias("ratio"), kind.alias("kind"), (F.col("value") - 5).alias("held"))
    added = F.when(F.col("ratio").isNull(), 0.0).otherwise(values.free_shares(F.col("kind"), F.col("ratio"), F.col("held")))
    return rows.select("seq", F.col("ratio.num").alias("num"), F.col("ratio.den").alias("den"), half_up(added, 6).alias("added"))


@REGISTER(f"""WITH {LE}, x AS (SELECT key, trade_date AS effective0, CASE WHEN seq % 9 = 0 THEN trade_date + 6 WHEN seq % 9 = 1 THEN trade_date - 3 END AS transfer_date, trade_date, side, qty FROM le),
e AS (SELECT key, side, qty, trade_date, greatest(trade_date, coalesce(transfer_date, trade_date)) AS effective FROM x)
SELECT key, CAST(sum(CASE WHEN effective <= DATE '2024-01-15' THEN CASE WHEN side='BUY' THEN qty ELSE -qty END ELSE 0 END) AS BIGINT) AS held, count(CASE WHEN trade_date <= DATE '2024-01-15' AND effective > DATE '2024-01-15' THEN 1 END) AS deferred FROM e GROUP BY key""")
def effective_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row counts from its trade or its transfer date, whichever is later; what is traded but not yet
    transferred is listed as deferred."""
    d = F.col("trade_date")
    moved = F.when(F.col("seq") % 9 == 0, F.date_add(d, 6)).when(F.col("seq") % 9 == 1, F.date_sub(d, 3))
    return reports.held_asof(ledger.ledger_events(spark, sf_dir).withColumn("transfer_date", moved), ["key"], "2024-01-15")
