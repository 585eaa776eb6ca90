"""Ledger queries against their SQL in DuckDB, and folds against plain loops."""

import math
from collections import Counter
from datetime import date, datetime

import duckdb
import pytest
from lotwise.functions import values
from lotwise.operators import lots, prices
from lotwise.plans.registry import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "nation", "region", "documents", "conversations"):
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(rows, names):
    order = [names.index(n) for n in sorted(names)]
    return Counter(tuple(None if r[i] is None else repr(float(r[i])) if isinstance(r[i], float) else str(r[i]).removesuffix(" 00:00:00") for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_like_sql(spark, con, name):
    out, want = QUERIES[name](spark, DIR), con.sql(ORACLE_SQL[name])
    assert sorted(out.columns) == sorted(want.columns)
    assert plain(map(tuple, out.collect()), out.columns) == plain(want.fetchall(), want.columns)


def test_average_cost_is_the_loop(spark):
    from lotwise.sources.ledger import ledger_events

    state = {}
    for r in sorted(ledger_events(spark, DIR).collect(), key=lambda r: (r["trade_date"], r["seq"])):
        q, c = state.get(r["key"], (0.0, 0.0))
        if r["side"] == "BUY":
            q, c = q + r["qty"], c + r["qty"] * r["price"]
        elif q > 0:
            sold = min(q, r["qty"])
            q, c = q - sold, c - c * sold / q
        else:
            q -= r["qty"]
        state[r["key"]] = (q, c)
    got = {r["key"]: (r["qty"], r["cost"]) for r in QUERIES["average_cost_positions"](spark, DIR).collect()}
    assert got.keys() == state.keys() and all(got[k][0] == q and abs(got[k][1] - c) < 0.011 for k, (q, c) in state.items())


def test_xirr(spark):
    rows = [("a", date(2023, 1, 1), -1000.0), ("a", date(2024, 1, 1), 2000.0), ("one-sided", date(2023, 1, 1), -5.0), ("one-sided", date(2023, 2, 1), -5.0), ("same day", date(2023, 1, 1), -5.0), ("same day", date(2023, 1, 1), 9.0), ("turns", date(2022, 1, 1), -100.0), ("turns", date(2023, 1, 1), 230.0), ("turns", date(2024, 1, 1), -132.0)]
    got = {r["key"]: r for r in prices.xirr(spark.createDataFrame(rows, "key string, ts date, amount double"), ["key"]).collect()}
    assert math.isclose(got["a"]["rate"], 1.0, abs_tol=1e-8) and got["one-sided"]["rate"] is None and got["same day"]["rate"] is None and got["turns"]["ambiguous"]


def test_oversold_is_carried_or_dropped(spark):
    rows = [("x", date(2024, 1, d), d, side, q, p) for d, side, q, p in ((1, "BUY", 10, 1.0), (2, "SELL", 15, 2.0), (3, "BUY", 8, 3.0), (4, "SELL", 2, 4.0))]
    frame = spark.createDataFrame(rows, "key string, trade_date date, seq int, side string, qty bigint, price double")
    assert [(r["net_qty"], r["invested"]) for r in lots.holdings(frame, ["key"], ["seq"]).collect()] == [(1, 3.0)]
    assert sorted((r["qty"], r["gain"]) for r in lots.realised(frame, ["key"], ["seq"]).collect()) == [(2, 2.0), (10, 10.0)]


def test_names_of_far_rows_are_as_in_sql(spark, tmp_path):
    day = datetime(2024, 1, 1)
    rows = [(1, 1, "signup", day), (4_000_000, 1, "purchase", day), (8, 1, "view", day), (5, 2, "error", day), (900_002, 2, "error", day)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, ts timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    out, want = QUERIES["names_and_dates"](spark, str(tmp_path)), c.sql(ORACLE_SQL["names_and_dates"])
    got = plain(map(tuple, out.collect()), out.columns)
    assert got == plain(want.fetchall(), want.columns) and {r["key"]: r["longest"] for r in out.collect()} == {1: "signupx", 2: "errorxx"}


def test_isin(spark):
    rows = [("US0378331005", True), ("US0378331006", False), ("INE002A01018", True), ("short", False)]
    frame = spark.createDataFrame(rows, "i string, ok boolean")
    assert frame.filter(values.isin_ok(F.col("i")) != F.col("ok")).count() == 0


def test_grid_file(spark, tmp_path):
    (tmp_path / "grid.csv").write_text("date,AAA,BBB\n01/02/2024,1.5,\n2024-02-02,0,\"1,000\"\nx,1,1\n")
    from lotwise.sources.ledger import read_price_grid

    got = {(str(r["session"]), r["key"]): r["close"] for r in read_price_grid(spark, str(tmp_path)).collect()}
    assert got == {("2024-02-01", "AAA"): 1.5, ("2024-02-01", "BBB"): None, ("2024-02-02", "AAA"): None, ("2024-02-02", "BBB"): 1000.0}


def test_import_twice_adds_nothing(spark, tmp_path):
    from lotwise.streaming.imports import import_stream

    schema, key = "key string, qty bigint", ["key", "qty"]
    at = {k: str(tmp_path / k) for k in ("in", "ledger", "state")}
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], schema)
    for _ in range(2):
        rows.coalesce(1).write.mode("append").parquet(at["in"])
        import_stream(spark, at["in"], schema, at["ledger"], at["state"], key, key).awaitTermination()
    assert sorted((r["key"], r["qty"]) for r in spark.read.schema(schema).parquet(at["ledger"]).collect()) == [("a", 1), ("a", 1), ("b", 2)]
