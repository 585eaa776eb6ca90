"""Statement files, written from the supplied tables and read back by their headers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions.values import half_up
from lotwise.plans.register import LE, LI, Register, r6
from lotwise.session import fresh_path
from lotwise.sources import ledger, statements

REGISTER = Register()


def _file(rows: DataFrame, columns: dict[str, Column]) -> str:
    """A folder of CSV files in the shared folder, with two lines above the header; every other row goes to files that
    have the columns in reverse order."""
    path = fresh_path(rows.sparkSession, "statement")
    cells = rows.select(*(c.cast("string").alias(n) for n, c in columns.items()))
    half = F.pmod(F.xxhash64(*(F.col(f"`{n}`") for n in columns)), F.lit(2))
    for i, names in enumerate((list(columns), list(columns)[::-1])):
        head = ",".join(f'"{n}"' if "," in n else n for n in names)

        def below(batches: Iterator[pa.RecordBatch], head: str = head) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_pydict({"value": ["Statement of a portfolio", "", head]})
            yield from batches

        lines = cells.filter(half == i).select(F.to_csv(F.struct(*(F.col(f"`{n}`") for n in names)), {"escape": '"'}).alias("value"))
        lines.mapInArrow(below, "value string").write.mode("append").text(path)
    return path


@REGISTER("""SELECT p_name || ' ' || p_partkey AS name, p_type AS sector, CAST(p_size - 3 AS DOUBLE) AS qty, CASE WHEN p_partkey % 5 = 0 THEN 0 WHEN p_partkey % 5 = 1 THEN 0 ELSE p_retailprice END AS invested FROM part WHERE p_size > 3 AND p_partkey % 7 > 0""")
def holding_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blanks and ``inf`` cost nothing; rights and what is not held are left out."""
    k = F.col("p_partkey")
    name = F.when(k % 7 == 0, F.concat("p_name", F.lit(" Rights Entitlement"))).otherwise(F.concat("p_name", F.lit(" "), k))
    cost = F.when(k % 5 == 0, "").when(k % 5 == 1, "inf").otherwise(F.format_number("p_retailprice", 2))
    path = _file(ledger.table(spark, sf_dir, "part"), {"#": k, "Asset Name": name, "Amount Invested (Rs.)": cost, "Bal Qty": F.format_number(F.col("p_size") - 3, 0), "Industry": F.col("p_type")})
    return statements.read_holding_statement(spark, path)


@REGISTER("""SELECT CAST(o_orderdate AS DATE) AS day, CASE o_orderstatus WHEN 'F' THEN 'BUY' ELSE 'SELL' END AS type, 'S' || o_custkey AS name, CAST(o_orderkey % 90 AS DOUBLE) AS qty, round(o_totalprice, 2) AS price, CAST(0 AS DOUBLE) AS amount, CASE WHEN o_orderkey % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(o_orderkey AS DOUBLE) END AS balance FROM orders WHERE o_orderkey % 8 > 0""")
def transaction_statement_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement without an amount column; rows without a type are left out."""
    k = F.col("o_orderkey")
    kind = F.when(k % 8 == 0, " ").when(F.col("o_orderstatus") == "F", "BUY").otherwise("SELL")
    path = _file(ledger.table(spark, sf_dir, "orders"), {"Trade Date": F.date_format("o_orderdate", "dd-MM-yyyy"), "Name": F.concat(F.lit("S"), "o_custkey"), "Trans Type": kind, "Rate": F.format_number("o_totalprice", 2), "Quantity": k % 90, "Closing Qty": F.when(k % 3 == 0, "").otherwise(F.format_number(k, 0))})
    return statements.read_transaction_statement(spark, path)


@REGISTER(f"""WITH {LI}, l AS (SELECT key, trade_date, qty, CASE WHEN l_orderkey % 3 = 1 THEN NULL ELSE round(turnover, 2) END AS amount, CASE WHEN l_orderkey % 4 = 1 THEN NULL ELSE floor(price * 10000 + 0.5) / 10000 END AS price FROM li WHERE side = 'BUY')
SELECT 'S' || key AS name, trade_date AS day, CAST(qty AS DOUBLE) AS qty, {r6("coalesce(amount / qty, price)")} AS cost_per_share, {r6("coalesce(amount, price * qty)")} AS invested FROM l WHERE amount IS NOT NULL OR price IS NOT NULL""")
def holding_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The amount paid before price times quantity."""
    k = F.col("l_orderkey")
    buys = ledger.ledger_lines(spark, sf_dir).filter("side = 'BUY'")
    path = _file(buys, {"Company Name": F.concat(F.lit("S"), "key"), "Purchase Date": F.date_format("trade_date", "dd/MM/yyyy"), "Qty": F.col("qty"), "Purchase Amount": F.when(k % 3 != 1, F.format_number("turnover", 2)), "Purchase Price": F.when(k % 4 != 1, half_up(F.col("price"), 4)), "Current Value": F.lit("1")})
    out = statements.read_holding_period(spark, path)
    return out.select("name", "day", "qty", *(half_up(F.col(c), 6).alias(c) for c in ("cost_per_share", "invested")))


@REGISTER(f"""WITH {LE}, r AS (SELECT *, CASE WHEN seq % 5 = 0 THEN 'Other Co' WHEN seq % 5 = 1 THEN '' ELSE 'ACME LTD.' END AS name, CASE WHEN seq % 6 = 0 THEN round(qty * price, 2) WHEN seq % 6 = 1 THEN round(qty * price, 2) + 1 END AS turnover FROM le), s AS (SELECT *, CASE WHEN name = 'Other Co' THEN 'foreign' WHEN trade_date > DATE '2024-01-20' THEN 'dropped' ELSE 'kept' END AS state FROM r)
SELECT count(*) FILTER (state = 'kept') AS kept, count(*) FILTER (state = 'dropped') AS dropped, count(*) FILTER (state = 'foreign') AS "foreign", count(*) FILTER (state = 'kept' AND turnover > 0) AS amount_rows, count(*) FILTER (state = 'kept' AND turnover > 0 AND abs(turnover - qty * round(price, 2)) > 0.01) AS amount_diverged FROM s""")
def stock_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One security's trades up to a day, rows of others refused, turnovers compared."""
    s, q = F.col("seq"), F.col("qty") * F.col("price")
    name = F.when(s % 5 == 0, "Other Co").when(s % 5 == 1, "").otherwise("ACME LTD.")
    turnover = F.when(s % 6 == 0, F.round(q, 2)).when(s % 6 == 1, F.round(q, 2) + 1)
    path = _file(ledger.ledger_events(spark, sf_dir), {"Company": name, "Date": F.date_format("trade_date", "yyyy-MM-dd"), "Trans Type": F.col("side"), "Qty": F.col("qty"), "Rate": F.round("price", 2), "Turnover": turnover})
    return statements.read_stock_trades(spark, path, "Acme Limited", cutoff="2024-01-20")[1]


@REGISTER("""SELECT 'INE' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '1' AS isin, p_name AS name, CASE WHEN p_partkey % 9 = 0 THEN CAST(0 AS DOUBLE) ELSE round(p_retailprice, 2) END AS price, CAST(500000 + p_partkey AS VARCHAR) AS bse, '' AS nse, p_type AS industry FROM part WHERE p_partkey % 4 > 0""")
def screener_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Securities of an export; rows without a valid ISIN are left out."""
    k = F.col("p_partkey")
    isin = F.when(k % 4 == 0, F.concat(F.lit("X"), k)).otherwise(F.concat(F.lit("ine"), F.lpad(k.cast("string"), 8, "0"), F.lit("1")))
    path = _file(ledger.table(spark, sf_dir, "part"), {"Name": F.col("p_name"), "ISIN Code": isin, "BSE Code": k + 500000, "CMP Rs.": F.when(k % 9 != 0, F.format_number("p_retailprice", 2)), "Industry Group": F.col("p_type"), "P/E": F.lit(12)})
    return statements.read_screener(spark, path)


@REGISTER("""SELECT p_partkey AS key, round(p_retailprice, 2) AS close FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 5 > 0 AND p_partkey % 7 > 0""")
def end_of_day_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exchange's day file for the codes that are held, shares only."""
    k, part = F.col("p_partkey"), ledger.table(spark, sf_dir, "part")
    path = _file(part, {"TckrSymb": F.concat(F.lit("S"), k), "SctySrs": F.when(k % 5 == 0, "GB").otherwise("EQ"), "ClsPric": F.when(k % 7 == 0, F.lit("0")).otherwise(F.format_number("p_retailprice", 2))})
    return statements.read_end_of_day(spark, path, part.filter(k % 2 == 0).select(k.alias("key"), F.concat(F.lit("s"), k).alias("code")))
