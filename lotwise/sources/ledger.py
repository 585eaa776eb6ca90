"""Ledgers, closes and files as typed DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions.values import half_up, ledger_side, parse_date, parse_number


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(portfolio, key, seq, trade_date, tx_type, side, qty, price): trades of positive quantity and price."""
    kind = F.create_map(*[F.lit(x) for pair in (("purchase", "Buy"), ("signup", "IPO"), ("view", "Purchase"), ("click", "Sell"), ("error", "Dividend")) for x in pair])
    rows = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).alias("portfolio"),
        F.col("user_id").alias("key"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("date").alias("trade_date"),
        kind[F.col("event_type")].alias("tx_type"),
        (F.get_json_object("props", "$.k").cast("bigint") + 1).alias("qty"),
        F.col("value").alias("price"),
    )
    return rows.withColumn("side", ledger_side(F.col("tx_type"))).filter("side is not null and qty > 0 and price > 0")


#: What orders lineitem rows of one day; rows that agree in all of it are interchangeable.
LINE_ORDER = ["trade_date", "ord", "l_orderkey", "l_linenumber", "qty", "turnover", "brokerage", "stt"]


def ledger_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(portfolio, key, trade_date, side, ord, qty, turnover, price, brokerage, stt, l_orderkey, l_linenumber)."""
    li = table(spark, sf_dir, "lineitem")
    sell = F.col("l_returnflag") == "R"
    return li.select(
        (F.col("l_suppkey") % 10).alias("portfolio"),
        F.col("l_partkey").alias("key"),
        F.col("l_shipdate").cast("date").alias("trade_date"),
        F.when(sell, "SELL").otherwise("BUY").alias("side"),
        F.when(sell, 2).otherwise(0).alias("ord"),
        F.col("l_quantity").cast("bigint").alias("qty"),
        F.col("l_extendedprice").alias("turnover"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        half_up(F.col("l_extendedprice") * F.col("l_discount")).alias("brokerage"),
        half_up(F.col("l_extendedprice") * F.col("l_tax")).alias("stt"),
        "l_orderkey",
        "l_linenumber",
    )


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, session, close): a key's greatest value of the day; days without one are gaps."""
    ev = table(spark, sf_dir, "events").filter("event_type = 'purchase' and value > 0")
    return ev.groupBy(F.col("user_id").alias("key"), F.col("ts").cast("date").alias("session")).agg(F.max("value").alias("close"))


def read_transaction_csv(spark: SparkSession, path: str) -> DataFrame:
    """A transaction report: name, trade_date, side, qty, price; rows that are no buy or sale are dropped."""
    raw = spark.read.option("header", True).csv(path)
    by = {c.strip().lower().replace(" ", "_"): c for c in raw.columns}
    col = lambda *names: F.col(f"`{next(by[n] for n in names if n in by)}`")
    rows = raw.select(F.trim(col("scrip_name", "name", "security")).alias("name"), parse_date(F.trim(col("date", "trade_date"))).alias("trade_date"), ledger_side(col("type", "transaction_type")).alias("side"), parse_number(col("quantity", "qty")).alias("qty"), parse_number(col("rate", "price")).alias("price"))
    return rows.filter("side is not null and qty > 0 and name <> ''")


def read_price_grid(spark: SparkSession, path: str) -> DataFrame:
    """A wide grid (a date and one column for each key) as (session, key, close); a close that is not above zero is
    null, the last row of a date wins, rows without a date are dropped."""
    raw = spark.read.option("header", True).csv(path)
    day, keys = raw.columns[0], raw.columns[1:]
    rows = raw.select(parse_date(F.trim(F.col(f"`{day}`"))).alias("session"), F.monotonically_increasing_id().alias("__at"), *(F.col(f"`{k}`") for k in keys)).filter("session is not null")
    last = rows.groupBy("session").agg(*(F.max_by(f"`{k}`", "__at").alias(k) for k in keys))
    long = last.unpivot("session", [F.col(f"`{k}`") for k in keys], "key", "text")
    price = parse_number(F.col("text"))
    return long.select("session", "key", F.when(price > 0, price).alias("close"))


def quote_rows(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """Chart JSON {symbol, times[], closes[], splits{}} as (symbol, session, close, split factor or null)."""
    shape = "symbol string, times array<bigint>, closes array<double>, splits map<string, double>"
    q = raw.select(F.from_json(json_col, shape).alias("q")).select("q.*")
    bars = q.select("symbol", "splits", F.explode(F.arrays_zip("times", "closes")).alias("b"))
    return bars.select("symbol", F.timestamp_seconds("b.times").cast("date").alias("session"), F.col("b.closes").alias("close"), F.element_at("splits", F.col("b.times").cast("string")).alias("split"))
