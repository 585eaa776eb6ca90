"""The sales register across splits, with uncovered sales and classes without a rule."""

from datetime import date

from lotwise.operators import registers

LEDGER = "key string, trade_date date, ord int, side string, qty double, price double, lt_days int, fee double"


def test_sales_by_term_with_their_lots(spark):
    rows = [
        ("a", date(2020, 1, 1), 0, "BUY", 10.0, 100.0, 365, 1.0),
        ("a", date(2021, 6, 1), 0, "BUY", 5.0, 50.0, 365, 1.0),  # on the day of the split, before it
        ("a", date(2021, 6, 1), 2, "SELL", 4.0, 60.0, 365, 2.0),  # behind the split: shares of 50
        ("a", date(2021, 8, 1), 2, "SELL", 30.0, 70.0, 365, 9.0),  # 16 of 2020, 10 of 2021, 4 that nobody bought
        ("a", date(2021, 9, 1), 0, "BUY", 1.0, 80.0, 365, 1.0),
        ("a", date(2021, 9, 2), 2, "SELL", 1.0, 81.0, 365, 0.5),  # what was lacking before is lost for good
        ("m", date(2020, 1, 1), 0, "BUY", 3.0, 10.0, None, 0.0),
        ("m", date(2022, 1, 1), 2, "SELL", 5.0, 12.0, None, 1.0),
    ]
    splits = spark.createDataFrame([("a", date(2021, 6, 1), 2.0), ("z", date(2020, 1, 1), 3.0), ("m", date(2021, 1, 1), None)], "key string, trade_date date, factor double")
    out = registers.sale_rows(spark.createDataFrame(rows, LEDGER), ["key"], ["trade_date", "ord"], splits, ["fee"])
    got = sorted((r["key"], r["sale"], r["term"], r["qty"], r["turnover"], r["fee"], r["pnl"], r["covered"], [(m["lot"], m["qty"], m["rate"]) for m in r["matched"]]) for r in out.collect())
    assert got == [
        ("a", 3, "LT", 4.0, 240.0, 2.0, 40.0, True, [(1, 4.0, 50.0)]),
        ("a", 4, "LT", 16.0, 1120.0, 4.8, 320.0, True, [(1, 16.0, 50.0)]),
        ("a", 4, "ST", 4.0, 280.0, 1.2, 0.0, False, []),
        ("a", 4, "ST", 10.0, 700.0, 3.0, 450.0, True, [(2, 10.0, 25.0)]),
        ("a", 6, "ST", 1.0, 81.0, 0.5, 1.0, True, [(5, 1.0, 80.0)]),
        ("m", 2, "NONE", 2.0, 24.0, 0.4, 0.0, False, []),
        ("m", 2, "NONE", 3.0, 36.0, 0.6, 0.0, True, [(1, 3.0, 10.0)]),
    ]
    empty = spark.createDataFrame([], LEDGER)
    assert registers.sale_rows(empty, ["key"], ["trade_date", "ord"], splits, ["fee"]).collect() == []


def test_readers_see_one_version(spark, tmp_path):
    """A frame read before a table is replaced goes on reading the old version; a job that fails changes nothing."""
    import pytest
    from lotwise.sources import derived
    from pyspark.sql import functions as F

    at = str(tmp_path / "table")
    with pytest.raises(ValueError, match="no table"):
        derived.read(spark, at)
    for i in range(4):
        before = derived.read(spark, at) if i else None
        derived.replace(spark.range(i + 1).withColumn("v", F.lit(i)), at)
        assert before is None or {r["v"] for r in before.collect()} == {i - 1}
        assert derived.read(spark, at).filter(f"v = {i}").count() == i + 1
    with pytest.raises(Exception, match="boom"):
        derived.replace(spark.range(5).select(F.raise_error(F.lit("boom")).alias("v")), at)
    assert derived.read(spark, at).count() == 4
    assert len([p for p in (tmp_path / "table").iterdir() if p.name.startswith("v")]) <= 4


def test_ratios_go_and_come_back(spark):
    from lotwise.sources import derived

    table = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "key string, num int")
    gone = spark.createDataFrame([("a", 9), (None, 9)], "key string, other int")
    back = spark.createDataFrame([("a", 10), ("b", 20)], "key string, num int")
    assert sorted((r["key"], r["num"]) for r in derived.without(table, gone, ["key"]).collect()) == [("b", 2)]
    assert sorted((r["key"], r["num"]) for r in derived.without(table, gone, ["key"], back).collect()) == [("a", 10), ("b", 2)]


def test_a_ledger_is_dealt_out_once(spark):
    """Sales, lots and what nobody bought come from one shuffle by key; rows without a key are none."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = [(k, date(2020, 1, d), 0 if side == "BUY" else 2, side, q, 3.0, 365, 1.0) for k in ("a", "b", None) for d, side, q in ((1, "SELL", 2.0), (2, "BUY", 4.0), (3, "SELL", 1.0), (3, "SELL", 5.0), (4, "SELL", 7.0))]
        splits = spark.createDataFrame([("b", date(2020, 1, 3), 2.0)], "key string, trade_date date, factor double")
        out = registers.sale_rows(spark.createDataFrame(rows, LEDGER), ["key"], ["trade_date", "ord", "qty"], splits, ["fee"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["key"], r["sale"], r["qty"], r["fee"], r["covered"], [(m["lot"], m["qty"]) for m in r["matched"]]) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    a = [("a", 1, 2.0, 1.0, False, []), ("a", 3, 1.0, 1.0, True, [(2, 1.0)]), ("a", 4, 2.0, 0.4, False, []), ("a", 4, 3.0, 0.6, True, [(2, 3.0)]), ("a", 5, 7.0, 1.0, False, [])]
    b = [("b", 1, 2.0, 1.0, False, []), ("b", 3, 1.0, 1.0, True, [(2, 1.0)]), ("b", 4, 5.0, 1.0, True, [(2, 5.0)]), ("b", 5, 2.0, 0.29, True, [(2, 2.0)]), ("b", 5, 5.0, 0.71, False, [])]
    assert got == a + b
