"""Names, classes and scalar rules."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions import values
from lotwise.operators import classes, identity
from lotwise.plans.register import Register
from lotwise.sources import ledger

REGISTER = Register()


def sql_norm(x: str, forms: str = "limited|ltd|private|pvt|the|co") -> str:
    """The normalised name in SQL."""
    signs = f"regexp_replace(lower(coalesce({x}, '')), '[-.,()''\"]', ' ', 'g')"
    one = f"regexp_replace({signs}, '\\b(private|pvt)\\b', 'pvt', 'g')"
    return f"trim(regexp_replace(regexp_replace({one}, '\\b({forms})\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


#: A name for every supplier, in the ways that companies write theirs.
STYLES = ("The {} Co. Ltd.", "{} & Sons Limited", "M&M {}", "Acme-{} Inc", "Soci\u00e9t\u00e9 {} (Pvt)", "{} PRIVATE LIMITED", "Cothe {}'s", "")


def styled(key: str, word: Column) -> Column:
    """``word`` in the style that the key picks; null for every ninth."""
    return F.coalesce(*(F.when(F.col(key) % 9 == i, F.concat(F.lit(x.split("{}")[0]), *([word, F.lit(x.split("{}")[1])] if "{}" in x else []))) for i, x in enumerate(STYLES)))


def sql_styled(key: str, word: str) -> str:
    quoted = [x.replace("'", "''").split("{}") for x in STYLES]
    return f"CASE {key} % 9 " + " ".join(f"WHEN {i} THEN '" + (f"' || {word} || '".join(x)) + "'" for i, x in enumerate(quoted)) + " END"


@REGISTER(f"""WITH n AS (SELECT s_suppkey AS key, {sql_styled("s_suppkey", "s_name")} AS name FROM supplier)
SELECT key, {sql_norm("name")} AS norm, {sql_norm("name", "limited|ltd|the|co")} AS norm_private FROM n""")
def name_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """normName, normNamePrivate over names with company forms, signs, letters with accents, nulls and blanks."""
    n = ledger.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), styled("s_suppkey", F.col("s_name")).alias("name"))
    return n.select("key", values.norm_name(F.col("name")).alias("norm"), values.norm_private(F.col("name")).alias("norm_private"))


@REGISTER("SELECT p_name AS norm, count(DISTINCT p_partkey) AS n FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) > 1")
def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6."""
    return identity.collisions(ledger.table(spark, sf_dir, "part"), "p_partkey", "p_name")


@REGISTER("SELECT token, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part) WHERE length(token) > 1 GROUP BY token HAVING count(*) >= 6")
def generic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3."""
    return identity.generic_tokens(ledger.table(spark, sf_dir, "part"), "p_name")


#: A master of securities: a word of its own behind the part's name; half of them have an alias.
WORD = "translate(CAST(p_partkey AS VARCHAR), '0123456789', 'abcdefghij')"
MASTER = f"""m AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'IN' || p_partkey END AS isin, p_name || ' ' || {WORD} || ' Ltd' AS name,
  CASE WHEN p_partkey % 4 = 0 THEN 'The ' || {WORD} || {WORD} || ' Co.' WHEN p_partkey % 4 = 1 THEN p_name || ' ' || translate(CAST(p_partkey + 1 AS VARCHAR), '0123456789', 'abcdefghij') END AS alias FROM part),
names AS (SELECT k, norm, bool_or(own) AS own FROM (SELECT k, {sql_norm("name")} AS norm, true AS own FROM m UNION ALL SELECT k, {sql_norm("alias")}, {sql_norm("alias")} = {sql_norm("name")} FROM m WHERE alias IS NOT NULL) GROUP BY ALL),
slots AS (SELECT norm, arg_max(k, CASE WHEN own THEN 1000000000 ELSE 0 END + k) AS k FROM names WHERE norm <> '' GROUP BY norm)"""
ASKED = f"""q AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN 'IN' || c_custkey END AS isin, CASE c_custkey % 7 WHEN 0 THEN upper(p_name || ' ' || {WORD}) || ' Pvt. Ltd.' WHEN 1 THEN {WORD} WHEN 2 THEN p_name || ' ' || {WORD} || ' Holdings'
  WHEN 3 THEN p_name WHEN 4 THEN 'nobody' || {WORD} WHEN 5 THEN substr(p_name || ' ' || {WORD}, 1, 11) ELSE p_name || ' ' || {WORD} || 'x' END AS name FROM customer JOIN part ON p_partkey = c_custkey)"""


def _words(key: Column) -> Column:
    return F.translate(key.cast("string"), "0123456789", "abcdefghij")


def master_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, isin, name, aliases, private): one security for each part."""
    k, word = F.col("p_partkey"), _words(F.col("p_partkey"))
    alias = F.when(k % 4 == 0, F.concat(F.lit("The "), word, word, F.lit(" Co."))).when(k % 4 == 1, F.concat("p_name", F.lit(" "), _words(k + 1)))
    isin = F.when(k % 3 == 0, F.concat(F.lit("IN"), k))
    return ledger.table(spark, sf_dir, "part").select(k.alias("key"), isin.alias("isin"), F.concat("p_name", F.lit(" "), word, F.lit(" Ltd")).alias("name"), F.when(alias.isNotNull(), F.array(alias)).alias("aliases"))


def asked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, isin, name): names as notes write them."""
    k, word = F.col("c_custkey"), _words(F.col("p_partkey"))
    full = F.concat("p_name", F.lit(" "), word)
    styles = (F.concat(F.upper(full), F.lit(" Pvt. Ltd.")), word, F.concat(full, F.lit(" Holdings")), F.col("p_name"), F.concat(F.lit("nobody"), word), F.substring(full, 1, 11), F.concat(full, F.lit("x")))
    name = F.coalesce(*(F.when(k % 7 == i, x) for i, x in enumerate(styles)))
    c, p = ledger.table(spark, sf_dir, "customer"), ledger.table(spark, sf_dir, "part")
    return c.join(p, k == F.col("p_partkey")).select(k.alias("id"), F.when(k % 11 == 0, F.concat(F.lit("IN"), k)).alias("isin"), name.alias("name"))


TOKENS = "[y FOR y IN list_distinct(string_split({}, ' ')) IF length(y) > 1 AND NOT regexp_matches(y, '^[0-9]+$')]"
RESOLVED = f"""WITH {MASTER}, {ASKED},
n AS (SELECT *, {TOKENS.format("norm")} AS t FROM names WHERE norm <> ''), a AS (SELECT DISTINCT {sql_norm("name")} AS x FROM q), o AS (SELECT x, {TOKENS.format("x")} AS xt FROM a WHERE x NOT IN (SELECT norm FROM slots)),
g AS (SELECT token FROM (SELECT DISTINCT k, unnest(t) AS token FROM n) GROUP BY token HAVING count(*) >= 6), gl AS (SELECT coalesce(list(token), []) AS gs FROM g),
c AS (SELECT x, count(DISTINCT k) AS c, min(k) AS k FROM o, n, gl WHERE len(xt) > 0 AND ((len(t) > 0 AND list_has_all(xt, t) AND NOT (len(t) = 1 AND list_contains(gs, t[1]))) OR (list_has_all(t, xt) AND NOT (len(xt) = 1 AND list_contains(gs, xt[1])))
  OR (length(x) >= 6 AND length(norm) >= 6 AND (starts_with(x, norm) OR starts_with(norm, x)))) GROUP BY x)
SELECT q.id, coalesce(m.k, slots.k, CASE WHEN c.c = 1 THEN c.k END) AS resolved, CASE WHEN m.k IS NOT NULL THEN 'isin' WHEN slots.k IS NOT NULL THEN 'name' WHEN c.c = 1 THEN 'fuzzy' WHEN c.c > 1 THEN 'ambiguous' ELSE 'unresolved' END AS how
FROM q LEFT JOIN m ON q.isin = m.isin LEFT JOIN slots ON slots.norm = {sql_norm("q.name")} LEFT JOIN c ON c.x = {sql_norm("q.name")}"""


@REGISTER(RESOLVED)
def entity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with forms, single words, longer and cut names, shared names, aliases; the SQL compares
    every name with every entry."""
    return identity.resolve(asked_names(spark, sf_dir), master_entries(spark, sf_dir), aliases="aliases").select("id", "resolved", "how")


#: Symbols: three of five entries have one for the NSE, half a code for the BSE; some held names are named by hand.
SYMBOLS = f"""{MASTER}, {ASKED}, sm AS (SELECT m.*, CASE WHEN k % 5 < 3 THEN ' s ' || name END AS nse, CASE WHEN k % 2 = 0 THEN CAST(500000 + k AS VARCHAR) END AS bse FROM m),
hand AS (SELECT 'in' || k AS isin, NULL AS name, k + 2 AS key FROM m WHERE k % 33 = 0 UNION ALL SELECT NULL, upper(name), k - 1 FROM m WHERE k % 50 = 1),
an AS (SELECT DISTINCT k, norm FROM (SELECT k, {sql_norm("name")} AS norm FROM sm UNION ALL SELECT k, {sql_norm("alias")} FROM sm UNION ALL SELECT k, {sql_norm("nse")} FROM sm) WHERE norm <> ''),
h AS (SELECT *, {sql_norm("name")} AS x FROM q), ho AS (SELECT upper(isin) AS i, max(key) AS ho FROM hand WHERE isin IS NOT NULL GROUP BY 1), hn AS (SELECT {sql_norm("name")} AS x, max(key) AS hn FROM hand WHERE name IS NOT NULL GROUP BY 1),
ki AS (SELECT isin AS i, max(k) AS ki FROM m WHERE isin IS NOT NULL GROUP BY 1), kn AS (SELECT norm AS x, max(k) AS kn FROM an GROUP BY 1),
pre AS (SELECT x, min(k) AS lo, max(k) AS hi FROM (SELECT DISTINCT x FROM h) d JOIN an ON length(x) >= 6 AND length(norm) >= 6 AND (starts_with(x, norm) OR starts_with(norm, x)) GROUP BY x),
z AS (SELECT h.id, CASE WHEN coalesce(ho, hn) IS NOT NULL THEN 'override' WHEN ki IS NOT NULL THEN 'isin' WHEN kn IS NOT NULL THEN 'name' WHEN lo < hi THEN 'ambiguous' WHEN lo = hi THEN 'prefix' ELSE 'unknown' END AS how, coalesce(ho, hn, ki, kn, CASE WHEN lo = hi THEN lo END) AS key FROM h LEFT JOIN ho ON ho.i = h.isin LEFT JOIN hn ON hn.x = h.x LEFT JOIN ki ON ki.i = h.isin LEFT JOIN kn ON kn.x = h.x LEFT JOIN pre ON pre.x = h.x),
w AS (SELECT z.*, upper(replace(nse, ' ', '')) || '.NS' AS ns, bse || '.BO' AS bo FROM z LEFT JOIN sm ON sm.k = z.key)"""


@REGISTER(f"WITH {SYMBOLS} SELECT id, key, how, coalesce(ns, bo, '') AS \"primary\", CASE WHEN ns IS NOT NULL THEN coalesce(bo, '') ELSE '' END AS fallback FROM w")
def quote_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as notes write them to the symbols that they are quoted by; the SQL compares every name with every
    entry's."""
    k = F.col("key")
    master = master_entries(spark, sf_dir).withColumns({"nse": F.when(k % 5 < 3, F.concat(F.lit(" s "), "name")), "bse": F.when(k % 2 == 0, (k + 500000).cast("string"))})
    none = F.lit(None).cast("string")
    by_isin = master.filter(k % 33 == 0).select(F.concat(F.lit("in"), k).alias("isin"), none.alias("name"), (k + 2).alias("key"))
    by_name = master.filter(k % 50 == 1).select(none.alias("isin"), F.upper("name").alias("name"), (k - 1).alias("key"))
    out = identity.quote_symbols(asked_names(spark, sf_dir), master, by_isin.unionAll(by_name))
    return out.select("id", "key", "how", "primary", "fallback")


#: Rows of a class tab: listed names with and without ISINs, private namesakes, new companies by ISIN and by name.
CLASS_ROWS = f"""{MASTER}, cm AS (SELECT m.*, CASE WHEN k % 5 < 3 THEN 'S' || k END AS nse, CASE WHEN k % 10 = 4 THEN 'AIF' END AS own_class, CASE WHEN k % 6 = 0 THEN 'Steel' END AS own_industry FROM m),
pr AS (SELECT p_partkey AS row, p_partkey % 8 AS kind, p_name || ' ' || {WORD} AS full_name, {WORD} AS word, translate(CAST(p_partkey - 1 AS VARCHAR), '0123456789', 'abcdefghij') AS word1, CASE WHEN p_partkey % 9 > 0 THEN p_retailprice END AS valuation, CASE WHEN p_partkey % 4 > 0 THEN DATE '2024-03-31' - CAST(p_size AS INTEGER) END AS valuation_date, p_partkey % 3 = 0 AS by_isin FROM part),
cr AS (SELECT row, CASE kind WHEN 0 THEN full_name || ' Ltd' WHEN 1 THEN full_name || ' Pvt Ltd' WHEN 2 THEN full_name WHEN 3 THEN 'newco' || word || ' Pvt. Ltd.' WHEN 4 THEN 'Newco' || word1 || ' Limited' WHEN 5 THEN full_name || ' Private Limited' WHEN 6 THEN 'fresh ' || word ELSE full_name || ' Pvt' END AS company,
  CASE WHEN kind = 0 AND by_isin THEN 'IN' || row WHEN kind = 3 THEN 'INX' || row WHEN kind = 7 THEN 'INY' || row END AS isin, CASE WHEN kind = 5 THEN DATE '2024-01-01' + CAST(row % 300 AS INTEGER) END AS listed_from, valuation, valuation_date FROM pr),
b AS (SELECT cr.*, {sql_norm("company")} AS nk, {sql_norm("company", "limited|ltd|the|co")} AS dk FROM cr), t AS (SELECT b.*, mi.k AS ki, s.k AS kn, d.k AS kd, coalesce(o.nse, '') <> '' AS ticker FROM b LEFT JOIN (SELECT isin, max(k) AS k FROM cm WHERE isin IS NOT NULL GROUP BY isin) mi ON mi.isin = b.isin LEFT JOIN slots s ON s.norm = nk LEFT JOIN slots d ON d.norm = dk LEFT JOIN cm o ON o.k = s.k),
f AS (SELECT nk, arg_min(isin, row) AS new_isin FROM t WHERE isin IS NOT NULL AND ki IS NULL GROUP BY nk),
h AS (SELECT t.*, new_isin, CASE WHEN ki IS NOT NULL THEN 'isin' WHEN isin IS NULL AND kn IS NOT NULL AND ticker AND listed_from IS NULL THEN CASE WHEN dk <> nk AND kd IS NULL THEN 'twin' ELSE 'skipped' END WHEN isin IS NULL AND kn IS NOT NULL THEN 'name' ELSE 'new' END AS how FROM t LEFT JOIN f USING (nk)),
pl AS (SELECT *, CASE how WHEN 'isin' THEN CAST(ki AS VARCHAR) WHEN 'twin' THEN dk WHEN 'name' THEN CAST(kn AS VARCHAR) WHEN 'new' THEN coalesce(isin, new_isin, nk) END AS key FROM h),
fo AS (SELECT key, arg_min(company, row) AS company, arg_min(isin, row) AS row_isin, CASE WHEN bool_or(how <> 'new') THEN arg_min(how, row) FILTER (how <> 'new') ELSE 'new' END AS as_, arg_max(listed_from, row) FILTER (listed_from IS NOT NULL) AS listed_from, arg_max(valuation, row) FILTER (valuation IS NOT NULL) AS valuation, arg_max(valuation_date, row) FILTER (valuation_date IS NOT NULL) AS valuation_date FROM pl WHERE how <> 'skipped' GROUP BY key)"""


@REGISTER(f"""WITH {CLASS_ROWS} SELECT coalesce(CAST(k AS VARCHAR), key) AS key, coalesce(name, company) AS name, coalesce(cm.isin, row_isin) AS isin, coalesce(own_class, CASE WHEN as_ IS NOT NULL THEN 'PE' END) AS asset_class, listed_from, as_ IS NOT NULL AND NOT coalesce(listed_from <= DATE '2024-07-01', false) AS price_except, valuation, valuation_date,
  coalesce(own_industry, CASE WHEN as_ IS NOT NULL AND NOT coalesce(listed_from <= DATE '2024-07-01', false) THEN 'Private Equity' END) AS industry, CASE WHEN k IS NOT NULL AND as_ IS NOT NULL THEN 'folded' WHEN k IS NOT NULL THEN 'kept' ELSE as_ END AS how FROM cm FULL JOIN fo ON fo.key = CAST(k AS VARCHAR)""")
def class_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a tab, read by its headers, in the master: by ISIN, by name, as twins of listed namesakes, new."""
    out, _, _ = _class_fold(spark, sf_dir)
    return out.select("key", "name", "isin", "asset_class", "listed_from", "price_except", "valuation", "valuation_date", "industry", "how")


@REGISTER(f"WITH {CLASS_ROWS} SELECT row, company, CAST(kn AS VARCHAR) AS key FROM pl WHERE how = 'skipped'")
def class_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the tab whose name nothing tells from a listed entry's."""
    return _class_fold(spark, sf_dir)[2]


def _class_fold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k, word = F.col("p_partkey"), _words(F.col("p_partkey"))
    full, kind = F.concat("p_name", F.lit(" "), word), F.col("p_partkey") % 8
    names = (F.concat(full, F.lit(" Ltd")), F.concat(full, F.lit(" Pvt Ltd")), full, F.concat(F.lit("newco"), word, F.lit(" Pvt. Ltd.")), F.concat(F.lit("Newco"), _words(k - 1), F.lit(" Limited")), F.concat(full, F.lit(" Private Limited")), F.concat(F.lit("fresh "), word), F.concat(full, F.lit(" Pvt")))
    company = F.coalesce(*(F.when(kind == i, x) for i, x in enumerate(names)))
    isin = F.when((kind == 0) & (k % 3 == 0), F.concat(F.lit("in"), k)).when(kind == 3, F.concat(F.lit("INX"), k)).when(kind == 7, F.concat(F.lit("INY"), k))
    listed = F.when(kind == 5, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")), "dd/MM/yyyy")).when(kind == 6, "soon")
    dated = F.when(k % 4 > 0, F.date_format(F.date_sub(F.lit("2024-03-31").cast("date"), F.col("p_size").cast("int")), "dd-MM-yyyy"))
    part = ledger.table(spark, sf_dir, "part")
    tab = part.select(k.alias("sheet row"), isin.alias("ISIN"), company.alias("Name of the Company"), F.when(k % 9 > 0, F.col("p_retailprice").cast("string")).alias("CMP"), dated.alias("Valuation Date"), listed.alias("Listed As On"), F.lit("10").alias("Face Value Per Share"))
    master = master_entries(spark, sf_dir)
    key = F.col("key")
    master = master.withColumns({"nse": F.when(key % 5 < 3, F.concat(F.lit("S"), key)), "bse": F.lit(None).cast("string"), "asset_class": F.when(key % 10 == 4, "AIF"), "industry": F.when(key % 6 == 0, "Steel"), "price_except": F.lit(False)})
    return classes.fold_classes(master, classes.class_rows(tab, "PE", "sheet row"), datetime.date(2024, 7, 1))


#: Labels, and by hand what each is: ledger side, statement class, NAV side, transfer, its leg out, free shares, a split.
LABELS = (
    ("Buy", "BUY", "BUY", "BUY", 0, 0, 0, 0), ("Sell", "SELL", "SELL", "SELL", 0, 0, 0, 0), ("Redeem", "SELL", "SELL", None, 0, 0, 0, 0), ("Redemption", "SELL", "SELL", None, 0, 0, 0, 0),
    ("Buy-back", "SELL", "SELL", "BUY", 0, 0, 0, 0), ("BUY BACK", "SELL", "SELL", "BUY", 0, 0, 0, 0), ("Buyback", "SELL", "SELL", "BUY", 0, 0, 0, 0), ("Subscribed", "BUY", "BUY", None, 0, 0, 0, 0),
    ("Transfer Debit", "SELL", "OTHER", "SELL", 1, 1, 0, 0), ("Transfer Out", "SELL", "OTHER", "SELL", 1, 1, 0, 0), ("Transfer In", "BUY", "OTHER", "BUY", 1, 0, 0, 0), ("transfer credit", "BUY", "BUY", "BUY", 1, 0, 0, 0),
    ("Transfer Into", None, "OTHER", None, 0, 0, 0, 0), ("Transfer Sale", "SELL", "SELL", None, 0, 0, 0, 0), ("Transfer In (Rights)", "BUY", "RIGHT", "BUY", 1, 0, 0, 0), ("Xfer Out", "SELL", "OTHER", "SELL", 1, 1, 0, 0), ("XFERIN", "BUY", "OTHER", "BUY", 1, 0, 0, 0),
    ("Bonus", "BUY", "BONUS", "BUY", 0, 0, 1, 0), ("Stock Split", "BUY", "SPLIT", "BUY", 0, 0, 1, 1), ("Sub-division", None, "SPLIT", None, 0, 0, 0, 0), ("Consolidation", None, "SPLIT", None, 0, 0, 0, 0), ("Face  Value change", None, "SPLIT", None, 0, 0, 0, 0),
    ("Rights Issue", "BUY", "RIGHT", "BUY", 0, 0, 0, 0), ("IPO", "BUY", "BUY", "BUY", 0, 0, 0, 0), ("Allotted", "BUY", "BUY", None, 0, 0, 0, 0), ("Call money paid", "BUY", "OTHER", None, 0, 0, 0, 0), ("Off market sale", "SELL", "SELL", None, 0, 0, 0, 0),
    ("Sold", None, "SELL", None, 0, 0, 0, 0), ("Bought", None, "BUY", None, 0, 0, 0, 0), ("Purchase", "BUY", "BUY", None, 0, 0, 0, 0), ("Dividend", None, "OTHER", None, 0, 0, 0, 0), ("", None, "OTHER", None, 0, 0, 0, 0), (None, None, "OTHER", None, 0, 0, 0, 0),
)


def _literal(x: str | int | None) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


def sql_labels() -> str:
    rows = ", ".join("(" + ", ".join(map(_literal, (i, *x))) + ")" for i, x in enumerate(LABELS))
    return f"labels(i, tx_type, side, class, nav, transfer, leg_out, free, split) AS (VALUES {rows})"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, tx_type): a label for every event."""
    label = F.get(F.array(*(F.lit(x[0]) for x in LABELS)), (F.col("event_id") % len(LABELS)).cast("int"))
    return ledger.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), label.alias("tx_type"), "value")


@REGISTER(f"""WITH {sql_labels()} SELECT event_id AS seq, tx_type, side, class, nav AS nav_side, transfer = 1 AS is_transfer, leg_out = 1 AS is_out, free = 1 AS is_free, split = 1 AS is_split FROM events JOIN labels ON event_id % {len(LABELS)} = i""")
def side_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, P2, P3, P4, P5 over labels whose meaning was set down by hand."""
    t = F.col("tx_type")
    flags = {"is_transfer": values.is_transfer(t), "is_out": values.is_transfer_out(t), "is_free": values.is_free_share(t), "is_split": values.is_split(t)}
    return labelled(spark, sf_dir).select("seq", "tx_type", values.ledger_side(t).alias("side"), values.statement_class(t).alias("class"), values.nav_side(t).alias("nav_side"), *(c.alias(n) for n, c in flags.items()))


@REGISTER("""WITH a AS (SELECT p_partkey AS key, CASE p_size % 5 WHEN 0 THEN 'PE' WHEN 1 THEN 'AIF' WHEN 2 THEN 'MF' ELSE NULL END AS class, DATE '2024-01-01' + CAST(p_size AS INTEGER) AS listed_from FROM part)
SELECT key, CASE WHEN DATE '2024-01-20' < listed_from THEN class END AS class_then, CASE WHEN DATE '2024-01-20' < listed_from AND class IN ('PE','AIF') THEN 730 WHEN DATE '2024-01-20' < listed_from AND class = 'MF' THEN NULL ELSE 365 END AS lt_days FROM a""")
def class_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class holds before its listing date."""
    size = F.col("p_size")
    kind = F.when(size % 5 == 0, "PE").when(size % 5 == 1, "AIF").when(size % 5 == 2, "MF")
    a = ledger.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), kind.alias("class"), F.date_add(F.lit("2024-01-01").cast("date"), size).alias("listed_from"))
    then = F.when(F.lit("2024-01-20").cast("date") < F.col("listed_from"), F.col("class"))
    return a.select("key", then.alias("class_then"), values.long_term_days(then).alias("lt_days"))


@REGISTER("""SELECT c_custkey AS key, round(c_acctbal, 2) AS parsed FROM customer""")
def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parseNumber: grouped digits, negatives in parentheses."""
    b = F.col("c_acctbal")
    said = F.when(b < 0, F.concat(F.lit("("), F.format_number(-b, 2), F.lit(")"))).otherwise(F.format_number(b, 2))
    return ledger.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), values.parse_number(said).alias("parsed"))


@REGISTER("SELECT o_orderkey AS key, CAST(o_orderdate AS DATE) AS parsed FROM orders")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parseDMY, serial days and ISO dates."""
    d = F.col("o_orderdate").cast("date")
    said = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "dd/MM/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.datediff(d, F.lit("1899-12-30")).cast("string")).otherwise(d.cast("string"))
    return ledger.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), values.parse_date(said).alias("parsed"))
