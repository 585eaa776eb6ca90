"""Statement files with odd headers, and formats."""

from collections import Counter

import pytest
from lotwise.functions import formats, values
from lotwise.sources import statements
from pyspark.sql import functions as F


def test_header_below_other_lines(spark, tmp_path):
    (tmp_path / "h.csv").write_text('Holdings as of,31-03-2025,,\n,,,\n#,Security,Qty,Invested Value\n1,"ACME, Ltd","1,000","12,500.50"\n2,Rights Issue,5,1\n3,Zero,0,9\n4,Free,7,inf\n5,"Say ""x""",2,\n')
    got = Counter(tuple(r) for r in statements.read_holding_statement(spark, str(tmp_path)).collect())
    assert got == Counter([("ACME, Ltd", "", 1000.0, 12500.5), ("Free", "", 7.0, 0.0), ('Say "x"', "", 2.0, 0.0)])


def test_title_above_the_header(spark, tmp_path):
    """A first line with fewer cells than the header costs no column and no row."""
    (tmp_path / "h.csv").write_text("Statement of holdings\n\nName,Qty,Amount Invested\nAcme,5,100\nBeta,2,40\n")
    assert Counter(tuple(r) for r in statements.read_holding_statement(spark, str(tmp_path)).collect()) == Counter([("Acme", "", 5.0, 100.0), ("Beta", "", 2.0, 40.0)])


def test_each_file_by_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Name,Qty,Cost\nAcme,5,100\n")
    (tmp_path / "b.csv").write_text("Report\nQty,Sector,Stock,Name,Invested\n7,Steel,Gamma,ignored,70\n")
    (tmp_path / "c.csv").write_text("")
    assert Counter(tuple(r) for r in statements.read_holding_statement(spark, str(tmp_path)).collect()) == Counter([("Acme", "", 5.0, 100.0), ("Gamma", "Steel", 7.0, 70.0)])


def test_no_header_is_an_error(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="x.csv"):
        statements.read_transaction_statement(spark, str(tmp_path))
    (tmp_path / "x.csv").write_text("Company,Date,Qty,Value\nAcme,01-04-2024,5,1\n")
    with pytest.raises(ValueError, match="x.csv"):  # lots need a price or an amount
        statements.read_holding_period(spark, str(tmp_path))
    assert statements.unmapped(["#", "Name", "Qty", "P/E", " "], statements.HOLDING) == ["#", "P/E"]


def test_foreign_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Date,Type,Qty,Price,ISIN,Company\n01-04-2024,Buy,10,5,US0378331005,Other Name\n01-04-2024,Buy,10,5,INE002A01018,Acme\n02-04-2025,Buy,1,1,,Acme\nx,Buy,1,1,,\n03-04-2024,Sell,1,2,500325,ACME (Pvt) Ltd\n,,,,,\n")
    rows, counts = statements.read_stock_trades(spark, str(tmp_path), "Acme", "US0378331005")
    assert tuple(counts.first()) == (2, 2, 1, 0, 0) and sorted(r["type"] for r in rows.collect()) == ["BUY", "SELL"]


def test_formats(spark):
    rows = [(0.0, "0.00", "0.00", "0"), (999.995, "1,000.00", "999.995", "1,000"), (1234567.5, "12,34,567.50", "12,34,567.50", "12,34,568"), (-508347.06, "(5,08,347.06)", "(5,08,347.06)", "-5,08,347"), (1075.574895, "1,075.57", "1,075.574895", "1,076"), (123456789.0, "12,34,56,789.00", "12,34,56,789.00", "12,34,56,789")]
    frame = spark.createDataFrame(rows, "n double, money string, rate string, whole string")
    got = frame.select("n", *(c.alias(x) for c, x in ((formats.money(F.col("n")), "money"), (formats.rate(F.col("n")), "rate"), (formats.quantity(F.col("n")), "whole")))).collect()
    assert [tuple(r) for r in got] == rows
    names = spark.createDataFrame([(x,) for x in ("item 10", "Item 9", "item 010b", "ITEM 1")], "n string")
    assert [r["n"] for r in names.orderBy(formats.natural_key(F.col("n"))).collect()] == ["ITEM 1", "Item 9", "item 10", "item 010b"]


def test_kinds_of_columns(spark):
    frame = spark.createDataFrame([("1", "x", "1,5", "2.5", "3", "", "7", "12d", "8")], "`Bal Qty` string, Remark string, a string, b string, `Trade Date` string, e string, `ISIN total` string, f string, `Value Date` string")
    assert formats.column_kinds(frame) == {"Bal Qty": "int", "Remark": "text", "a": "int", "b": "money", "Trade Date": "date", "e": "text", "ISIN total": "text", "f": "text", "Value Date": "date"}
    said = {"Avg Buy Price": "rate", "Cost per share": "rate", "P&L": "money", "Gain %": "pct", "Net Shares": "int", "Scrip Code": "text", "Company Name": "text", "Charges": "money", "foo": None}
    assert {h: formats.header_kind(h) for h in said} == said


def test_numbers(spark):
    said = {"12d": None, "NaN": None, "Infinity": None, "1e5": None, "(1,234.50)": -1234.5, "−5": -5.0, "+.5": 0.5, "₹ 7": 7.0, "": None, "()": None}
    rows = spark.createDataFrame([(x,) for x in said], "t string").select("t", values.parse_number(F.col("t"))).collect()
    assert dict(map(tuple, rows)) == said


def test_dates_and_report_rows_take_one_match_each(spark):
    from lotwise.functions.values import parse_date, parse_number
    from lotwise.sources import notes

    texts = ["1/2/2024", "31-02-2024", "2024-02-30", "2024-2-3", "45000", "x", "", None, "2024-01-05", "29/2/2024"]
    dates = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_date(F.col("t")).alias("d"))
    assert [str(r["d"]) for r in dates.collect()] == ["2024-02-01", "None", "None", "None", "2023-03-15", "None", "None", "None", "2024-01-05", "2024-02-29"]
    numbers = spark.createDataFrame([(t,) for t in ("1,000.5", "(2)", "(-2)", "()", "1e3", "−3", ".5", None)], "t string").select(parse_number(F.col("t")).alias("n"))
    assert [r["n"] for r in numbers.collect()] == [1000.5, -2.0, 2.0, None, None, -3.0, 0.5, None]
    report = "head 01-01-2000 DIVIDEND X 1 1.00 1.00 1.00 1 05-02-2024 BUY A $1 LTD 1,000 2.50 0.10 9.00 7 tail 06-02-2024 SELL B 1 2 3 x 4"
    out = notes.report_rows(spark.createDataFrame([(1, report)], "note int, text string"))
    assert [tuple(map(str, r))[2:] for r in out.collect()] == [("2024-02-05", "BUY", "A $1 LTD", "1000.0", "2.5", "0.1", "9.0", "7.0")]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract(piece" not in plan(out) and "gettimestamp" not in plan(dates) and "try_to_timestamp" not in plan(dates)


def test_a_line_is_parsed_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Company,Date,Qty,Cost,Rate\nALPHA,01/02/2020,"1,000",2000,9\nBETA,02/02/2020,5,,3\nGAMMA,02/02/2020,5,,\n')
    rows = statements.read_holding_period(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv(") == 1 or plan.count("csvtostructs(") == 1, plan
    assert sorted((r["name"], r["day"].day, r["cost_per_share"], r["invested"]) for r in rows.collect()) == [("ALPHA", 1, 2.0, 2000.0), ("BETA", 2, 3.0, 15.0)]
