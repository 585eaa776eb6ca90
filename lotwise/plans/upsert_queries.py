"""Sinks of the ledger as queries: the table that each merge leaves behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.functions.values import half_up
from lotwise.operators import identity, pricing, skew, upserts
from lotwise.plans.identity_queries import MASTER, RESOLVED, asked_names, master_entries, sql_norm
from lotwise.plans.register import CLOSES, LE, Register, r2
from lotwise.session import written
from lotwise.sources import ledger

REGISTER = Register()
DAY = "CAST(ts AS DATE)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.table(spark, sf_dir, "events")


@REGISTER(f"""WITH {LE} SELECT key, seq, qty, CAST(NULL AS VARCHAR) AS ratio, CAST(NULL AS VARCHAR) AS notes FROM le WHERE side = 'BUY' UNION ALL SELECT key, seq, NULL, '1:' || portfolio, 'n' || seq FROM le WHERE side = 'SELL'""")
def append_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, K3: records with columns of their own below a table that lacks them."""
    le = ledger.ledger_events(spark, sf_dir)
    target = le.filter("side = 'BUY'").select("key", "seq", "qty")
    records = le.filter("side = 'SELL'").select(F.concat(F.lit("1:"), "portfolio").alias("ratio"), "seq", "key", F.concat(F.lit("n"), "seq").alias("notes"))
    return upserts.append_aligned(target, records)


@REGISTER(f"""WITH o AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'IN' || p_partkey END AS isin, p_name || ' ' || p_partkey AS name, p_type AS industry FROM part WHERE p_partkey % 4 > 0), n AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'in' || p_partkey END AS isin, upper(p_name) || ' ' || p_partkey || ' Ltd' AS name, CASE WHEN p_partkey % 5 > 0 THEN p_brand END AS industry FROM part WHERE p_partkey % 2 = 0),
a AS (SELECT coalesce(upper(isin), {sql_norm("name")}) AS id, industry FROM o), b AS (SELECT coalesce(upper(isin), {sql_norm("name")}) AS id, industry FROM n)
SELECT coalesce(a.id, b.id) AS id, coalesce(b.industry, a.industry) AS industry FROM a FULL JOIN b ON a.id = b.id""")
def industry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: by ISIN, else by name."""
    p, k = ledger.table(spark, sf_dir, "part"), F.col("p_partkey")
    old = p.filter(k % 4 > 0).select(F.when(k % 3 == 0, F.concat(F.lit("IN"), k)).alias("isin"), F.concat("p_name", F.lit(" "), k).alias("name"), F.col("p_type").alias("industry"))
    new = p.filter(k % 2 == 0).select(F.when(k % 3 == 0, F.concat(F.lit("in"), k)).alias("isin"), F.concat(F.upper("p_name"), F.lit(" "), k, F.lit(" Ltd")).alias("name"), F.when(k % 5 > 0, F.col("p_brand")).alias("industry"))
    keyed = lambda df: df.select(upserts.identity_of("isin", "name").alias("id"), "industry")
    return upserts.upsert(keyed(old), keyed(new), ["id"], ["industry"])


@REGISTER(f"""WITH {CLOSES}, f AS (SELECT key, session, close + 1 AS close FROM closes WHERE key % 3 = 0), s AS (SELECT (SELECT count(DISTINCT key) FROM f) / (SELECT count(DISTINCT key) FROM closes) >= 0.6 AS whole)
SELECT f.* FROM f UNION ALL SELECT c.* FROM closes c, s WHERE NOT whole AND NOT EXISTS (SELECT 1 FROM f WHERE f.key = c.key AND f.session = c.session)""")
def rebuild_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: a fetch that got a third of the keys is merged, not put in place of the history."""
    c = ledger.closes(spark, sf_dir)
    fetched = c.filter("key % 3 = 0").withColumn("close", F.col("close") + 1)
    return upserts.rebuild_or_merge(c, fetched, c, ["key"], "session", "close")


FOUND = f"""old AS (SELECT user_id AS isin, {DAY} AS ex_date, 'BONUS' AS kind, 'feed' AS source, CASE WHEN max(event_id) % 2 = 0 THEN 'dismissed' ELSE 'new' END AS status FROM events WHERE event_type = 'signup' GROUP BY ALL),
found AS (SELECT user_id AS isin, {DAY} AS ex_date, CASE WHEN event_id % 3 = 0 THEN 'SPLIT' ELSE 'BONUS' END AS kind, CASE WHEN event_id % 5 = 0 THEN 'exchange' ELSE 'chart' END AS source, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS rank FROM events WHERE event_type = 'click'),
n AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY isin, ex_date ORDER BY rank, source, kind) = 1),
alerts AS (SELECT coalesce(o.isin, n.isin) AS isin, coalesce(o.ex_date, n.ex_date) AS ex_date, CASE WHEN n.kind IS NOT NULL AND (o.kind IS NULL OR n.rank = 0) THEN n.kind ELSE o.kind END AS kind,
  CASE WHEN n.kind IS NOT NULL AND (o.kind IS NULL OR n.rank = 0) THEN n.source ELSE o.source END AS source, coalesce(o.status, 'new') AS status FROM old o FULL JOIN n ON o.isin = n.isin AND o.ex_date = n.ex_date)"""


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir)
    named = ev.select(F.col("user_id").alias("isin"), F.col("ts").cast("date").alias("ex_date"), "event_type", "event_id")
    old = named.filter("event_type = 'signup'").groupBy("isin", "ex_date").agg(F.max("event_id").alias("m")).select("isin", "ex_date", F.lit("BONUS").alias("kind"), F.lit("feed").alias("source"), F.when(F.col("m") % 2 == 0, "dismissed").otherwise("new").alias("status"))
    e = F.col("event_id")
    found = named.filter("event_type = 'click'").select("isin", "ex_date", F.when(e % 3 == 0, "SPLIT").otherwise("BONUS").alias("kind"), F.when(e % 5 == 0, "exchange").otherwise("chart").alias("source"), F.when(e % 5 == 0, 0).otherwise(1).alias("rank"))
    return upserts.alert_upsert(old, found)


@REGISTER(f"WITH {FOUND} SELECT * FROM alerts")
def alert_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feeds in one table; what a user dismissed stays so."""
    return _alerts(spark, sf_dir)


@REGISTER(f"""WITH {FOUND}, acts AS (SELECT user_id AS isin, {DAY} AS ex_date, arg_max(CASE WHEN event_id % 2 = 0 THEN 'dismissed' ELSE 'restored' END, event_id) AS s FROM events WHERE event_type = 'error' GROUP BY ALL)
SELECT a.isin, a.ex_date, a.kind, a.source, coalesce(acts.s, a.status) AS status FROM alerts a LEFT JOIN acts USING (isin, ex_date)""")
def alert_dismissal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K20."""
    acts = _events(spark, sf_dir).filter("event_type = 'error'").select(F.col("user_id").alias("isin"), F.col("ts").cast("date").alias("ex_date"), F.when(F.col("event_id") % 2 == 0, "dismissed").otherwise("restored").alias("status"), F.col("event_id").alias("seq"))
    return upserts.set_status(_alerts(spark, sf_dir), acts, ["isin", "ex_date"])


@REGISTER(f"""WITH s AS (SELECT {DAY} AS day, user_id % 5 AS portfolio, sum(value) AS aum, max(ts) AS at FROM events GROUP BY ALL), o AS (SELECT * FROM s WHERE day <= DATE '2024-01-20'), n AS (SELECT day, portfolio, aum + 1 AS aum FROM s WHERE day >= DATE '2024-01-19')
SELECT coalesce(o.day, n.day) AS day, coalesce(o.portfolio, n.portfolio) AS portfolio, {r2("coalesce(n.aum, o.aum)")} AS aum FROM o FULL JOIN n ON o.day = n.day AND o.portfolio = n.portfolio""")
def snapshot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each day and portfolio; a second snapshot of a day takes its place."""
    s = _events(spark, sf_dir).groupBy(F.col("ts").cast("date").alias("day"), (F.col("user_id") % 5).alias("portfolio")).agg(F.sum("value").alias("aum"))
    new = s.filter("day >= date'2024-01-19'").withColumn("aum", F.col("aum") + 1)
    out = upserts.upsert(s.filter("day <= date'2024-01-20'"), new, ["day", "portfolio"], ["aum"])
    return out.withColumn("aum", half_up(F.col("aum")))


@REGISTER(f"""WITH {LE}, i AS (SELECT key, seq, qty, side, CASE WHEN seq % 6 = 0 THEN NULL ELSE (seq // 40) END AS import_id FROM le), b AS (SELECT DISTINCT seq // 40 AS import_id FROM le WHERE seq % 400 = 0)
SELECT key, CAST(sum(CASE WHEN side='BUY' THEN qty ELSE -qty END) AS BIGINT) AS held, count(*) AS n FROM i WHERE import_id IS NULL OR import_id NOT IN (SELECT import_id FROM b) GROUP BY key""")
def import_rewind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports are taken back, then positions are derived again."""
    le = ledger.ledger_events(spark, sf_dir)
    number = F.floor(F.col("seq") / 40)
    i = le.withColumn("import_id", F.when(F.col("seq") % 6 != 0, number))
    kept = upserts.rewound(i, "import_id", le.filter("seq % 400 = 0").select(number.alias("import_id")))
    return kept.groupBy("key").agg(F.sum(F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))).alias("held"), F.count(F.lit(1)).alias("n"))


INCOMING = f"""inc AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 4 = 0 THEN 'in' || (c_custkey // 2) END AS isin, CASE WHEN c_custkey % 6 = 0 THEN '' WHEN c_custkey % 6 = 1 THEN 'New ' || (c_custkey % 50) || ' Limited' ELSE p_name || ' ' || translate(CAST(c_custkey // 2 AS VARCHAR), '0123456789', 'abcdefghij') END AS name FROM customer JOIN part ON p_partkey = c_custkey // 2)"""


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p = ledger.table(spark, sf_dir, "customer"), ledger.table(spark, sf_dir, "part")
    k, half = F.col("c_custkey"), F.floor(F.col("c_custkey") / 2)
    name = F.when(k % 6 == 0, "").when(k % 6 == 1, F.concat(F.lit("New "), k % 50, F.lit(" Limited"))).otherwise(F.concat("p_name", F.lit(" "), F.translate(half.cast("string"), "0123456789", "abcdefghij")))
    return c.join(p, half == F.col("p_partkey")).select(k.alias("seq"), F.when(k % 4 == 0, F.concat(F.lit("in"), half)).alias("isin"), name.alias("name"))


@REGISTER(f"""WITH {MASTER}, {INCOMING}, m2 AS (SELECT * FROM m WHERE k % 2 = 0), x AS (SELECT seq, isin, name, {sql_norm("name")} AS n, upper(isin) AS i FROM inc),
y AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY seq) AS a FROM x WHERE n <> '' AND n NOT IN (SELECT {sql_norm("name")} FROM m2) AND (i IS NULL OR i NOT IN (SELECT isin FROM m2 WHERE isin IS NOT NULL))),
z AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY seq) AS b FROM y WHERE a = 1) SELECT seq, isin, name FROM z WHERE i IS NULL OR b = 1""")
def master_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Securities that are new by ISIN and by name, each once."""
    return upserts.append_new(master_entries(spark, sf_dir).filter("key % 2 = 0"), _incoming(spark, sf_dir))


@REGISTER(f"""WITH {MASTER}, {INCOMING}, x AS (SELECT *, {sql_norm("name")} AS n FROM inc), r AS (SELECT {sql_norm("name")} AS n FROM m WHERE k % 4 = 1), l AS (SELECT {sql_norm("name")} AS n, isin FROM m WHERE k % 4 = 2),
y AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY seq) AS a FROM x)
SELECT seq, isin, name, CASE WHEN n = '' THEN 'blank' WHEN n IN (SELECT n FROM r) OR a > 1 THEN 'present' WHEN n IN (SELECT n FROM l) OR upper(isin) IN (SELECT isin FROM l WHERE isin IS NOT NULL) THEN 'listed' ELSE 'added' END AS outcome FROM y""")
def class_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals of an append to a register of unlisted securities."""
    m = master_entries(spark, sf_dir)
    return upserts.class_append(m.filter("key % 4 = 1"), m.filter("key % 4 = 2"), _incoming(spark, sf_dir))


@REGISTER(f"""WITH {CLOSES}, w AS (SELECT DISTINCT user_id AS key FROM events), misses AS (SELECT key FROM w EXCEPT SELECT key FROM closes WHERE session >= DATE '2024-01-28') SELECT key, 'S' || key AS name, CAST(row_number() OVER (ORDER BY 'S' || key) AS INTEGER) AS place FROM misses""")
def price_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Securities that the last sessions have no close of, by name."""
    recent = ledger.closes(spark, sf_dir).filter("session >= date'2024-01-28'").select("key")
    missing = _events(spark, sf_dir).select(F.col("user_id").alias("key")).distinct().join(recent, "key", "left_anti").withColumn("name", F.concat(F.lit("S"), "key"))
    return missing.select("key", "name", F.row_number().over(Window.orderBy("name")).alias("place"))  # one row a security without a close


@REGISTER(f"""WITH a AS (SELECT event_id AS action_id, user_id AS key, value AS cost FROM events WHERE event_type = 'signup'), u AS (SELECT user_id + 0 AS key, event_id AS at, value AS cost FROM events WHERE event_type = 'error'),
t AS (SELECT a.action_id, arg_max(u.cost, u.at) AS cost FROM a JOIN u ON u.key = a.key AND u.at > a.action_id AND u.at <= a.action_id + 20 GROUP BY a.action_id)
SELECT a.action_id, a.key, {r2("coalesce(t.cost, a.cost)")} AS cost FROM a LEFT JOIN t USING (action_id)""")
def action_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates addressed to single actions, of which two may be equal; the last one counts."""
    ev = _events(spark, sf_dir)
    a = ev.filter("event_type = 'signup'").select(F.col("event_id").alias("action_id"), F.col("user_id").alias("key"), F.col("value").alias("cost"))
    u = ev.filter("event_type = 'error'").select(F.col("user_id").alias("key"), F.col("event_id").alias("at"), F.col("value").alias("new"))
    # Both sides are put in buckets of 20 ids, so that a key's actions meet the updates near them only.
    bucket = lambda x: F.floor(x / 20)
    near = u.withColumn("bucket", F.explode(F.sequence(bucket(F.col("at") - 20), bucket(F.col("at") - 1))))
    pairs = a.withColumn("bucket", bucket(F.col("action_id"))).join(near, ["key", "bucket"])
    hit = pairs.filter(F.col("at").between(F.col("action_id") + 1, F.col("action_id") + 20)).groupBy("action_id").agg(F.max_by("new", "at").alias("cost"))
    return upserts.upsert(a.select("action_id", "cost"), hit, ["action_id"], ["cost"]).join(a.select("action_id", "key"), "action_id").select("action_id", "key", half_up(F.col("cost")).alias("cost"))


#: Quotes: two of three securities, every sixteenth without a price; some rows name the ISIN, all the name.
QUOTES = f"""pr AS (SELECT p_partkey AS row, CASE WHEN p_partkey % 6 = 0 THEN 'in' || p_partkey END AS isin, p_name || ' ' || translate(CAST(p_partkey AS VARCHAR), '0123456789', 'abcdefghij') || ' Limited' AS name, CASE WHEN p_partkey % 16 = 0 THEN 0 ELSE p_retailprice END AS price, p_partkey % 5 = 0 AS except_ FROM part WHERE p_partkey % 3 > 0 OR p_partkey % 6 = 0),
pk AS (SELECT pr.*, {sql_norm("pr.name")} AS n, coalesce(mi.k, s.k) AS k, s.k AS owner FROM pr LEFT JOIN m mi ON upper(pr.isin) = mi.isin LEFT JOIN slots s ON s.norm = {sql_norm("pr.name")}),
h AS (SELECT r.id, r.resolved AS k, q.isin, q.name, {sql_norm("q.name")} AS n, s.k AS owner, CASE WHEN r.resolved % 5 = 1 THEN 'PE' END AS asset_class, CASE WHEN r.id % 4 = 0 THEN 11.5 END AS valuation, CASE WHEN r.id % 3 = 0 THEN 7.25 END AS last_trade FROM r JOIN q USING (id) LEFT JOIN slots s ON s.norm = {sql_norm("q.name")})"""


def _resolver(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    master = master_entries(spark, sf_dir)
    k = F.col("p_partkey")
    p = ledger.table(spark, sf_dir, "part").filter((k % 3 > 0) | (k % 6 == 0))
    rows = p.select(k.alias("row"), F.when(k % 6 == 0, F.concat(F.lit("in"), k)).alias("isin"), F.concat("p_name", F.lit(" "), F.translate(k.cast("string"), "0123456789", "abcdefghij"), F.lit(" Limited")).alias("name"), F.when(k % 16 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("price"), (k % 5 == 0).alias("except"))
    # Quotes and holdings are resolved together, once; the result is written as both are read from it.
    q = rows.select(F.col("row").alias("id"), F.upper("isin").alias("isin"), "name", "price", "except", F.lit(True).alias("quote"))
    h = asked_names(spark, sf_dir).select("id", "isin", "name", F.lit(None).cast("double").alias("price"), F.lit(None).cast("boolean").alias("except"), F.lit(False).alias("quote"))
    found = written(identity.resolve(q.unionByName(h), master, aliases="aliases", named=True), "resolved").withColumnRenamed("resolved", "k")
    quotes = found.filter("quote").withColumnRenamed("id", "row").drop("how", "quote")
    held = found.filter("not quote").drop("price", "except", "quote")
    i = F.col("id")
    held = held.select("id", "k", "isin", "name", "norm", "owner", F.when(F.col("k") % 5 == 1, "PE").alias("asset_class"), F.when(i % 4 == 0, 11.5).alias("valuation"), F.when(i % 3 == 0, 7.25).alias("last_trade"))
    return held, quotes


def _found(value: str, where: str = "true") -> str:
    own = "(owner IS NULL OR k IS NULL OR owner = k)"
    return f"""bk AS (SELECT k, arg_max({value}, row) AS v FROM pk WHERE k IS NOT NULL AND {where} GROUP BY k), bi AS (SELECT upper(isin) AS i, arg_max({value}, row) AS v FROM pk WHERE isin IS NOT NULL AND {where} GROUP BY 1), bn AS (SELECT n, arg_max({value}, row) AS v FROM pk WHERE n <> '' AND {own} AND {where} GROUP BY n),
f AS (SELECT h.*, coalesce(bk.v, bi.v, CASE WHEN {own.replace("owner", "h.owner").replace(" k ", " h.k ").replace("= k", "= h.k")} THEN bn.v END) AS v FROM h LEFT JOIN bk ON bk.k = h.k LEFT JOIN bi ON bi.i = upper(h.isin) LEFT JOIN bn ON bn.n = h.n)"""


R = RESOLVED[len("WITH ") :].replace("\nSELECT q.id, coalesce", ",\nr AS (SELECT q.id, coalesce") + ")"


@REGISTER(f"""WITH {R}, {QUOTES}, {_found("price", "price > 0")} SELECT id, coalesce(v, CASE WHEN asset_class IS NOT NULL THEN coalesce(valuation, last_trade) END) AS price FROM f""")
def price_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry, ISIN, own name, then for unlisted classes the valuation and the last trade."""
    held, quotes = _resolver(spark, sf_dir)
    return pricing.priced(held, quotes, None).select("id", "price")


@REGISTER(f"""WITH {R}, {QUOTES}, own AS (SELECT * FROM pk WHERE except_) SELECT h.id, (h.isin IS NOT NULL AND upper(h.isin) IN (SELECT upper(isin) FROM own WHERE isin IS NOT NULL)) OR (h.k IS NOT NULL AND h.k IN (SELECT k FROM own WHERE k IS NOT NULL))
  OR ((h.owner IS NULL OR h.k IS NULL OR h.owner = h.k) AND h.n IN (SELECT n FROM own WHERE owner IS NULL OR k IS NULL OR owner = k)) AS flagged FROM h""")
def price_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag on any identity of a holding counts."""
    held, quotes = _resolver(spark, sf_dir)
    return pricing.flagged(held, quotes.filter("except"), None).select("id", "flagged")


@REGISTER(f"""WITH {R}, {QUOTES}, {_found("'I' || (row % 7)")} SELECT id, coalesce(v, 'Unclassified') AS industry FROM f""")
def industry_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13."""
    held, quotes = _resolver(spark, sf_dir)
    rows = quotes.withColumn("industry", F.concat(F.lit("I"), F.col("row") % 7))
    return pricing.by_identity(held, rows, None, "industry", "row").select("id", F.coalesce("found", F.lit("Unclassified")).alias("industry"))


@REGISTER(f"""WITH {R}, cols AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'IN' || p_partkey WHEN p_partkey % 3 = 1 THEN CAST(p_partkey AS VARCHAR) ELSE p_name END AS col FROM part WHERE p_partkey % 2 = 0), h AS (SELECT r.id, r.resolved AS k, q.isin, q.name, m.isin AS entry_isin FROM r JOIN q USING (id) LEFT JOIN m ON m.k = r.resolved)
SELECT id, CASE WHEN isin IN (SELECT col FROM cols) THEN isin WHEN entry_isin IN (SELECT col FROM cols) THEN entry_isin WHEN CAST(k AS VARCHAR) IN (SELECT col FROM cols) THEN CAST(k AS VARCHAR) WHEN name IN (SELECT col FROM cols) THEN name END AS col FROM h""")
def column_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid's column of a holding: its ISIN, its entry's, the key, the name, whichever the grid has."""
    k = F.col("p_partkey")
    cols = ledger.table(spark, sf_dir, "part").filter(k % 2 == 0).select(F.when(k % 3 == 0, F.concat(F.lit("IN"), k)).when(k % 3 == 1, k.cast("string")).otherwise(F.col("p_name")).alias("col")).distinct()
    master = master_entries(spark, sf_dir)
    held = identity.resolve(asked_names(spark, sf_dir), master, aliases="aliases").withColumn("__k", skew.apart(F.col("resolved").cast("string"), "id"))
    held = held.join(master.select(F.col("key").cast("string").alias("__k"), F.col("isin").alias("entry_isin")), "__k", "left")
    for i, c in enumerate(("isin", "entry_isin", "resolved", "name")):
        held = held.withColumn("__c", skew.apart(F.col(c).cast("string"), "id")).join(cols.select(F.col("col").alias("__c"), F.col("col").alias(f"__{i}")), "__c", "left")
    return held.select("id", F.coalesce("__0", "__1", "__2", "__3").alias("col"))
