"""Class tabs by their headers, and their rows in the master."""

import datetime

from lotwise.operators import classes

MASTER = "key bigint, name string, isin string, nse string, bse string, aliases array<string>, asset_class string, industry string, price_except boolean"


def test_headers():
    of = classes.class_columns
    assert of(["ISIN", "Company PAN", "Name of Company", "CMP", "Valuation Date", "Listed As On", "Face Value Per Share", "Type Of Company", "Drive Link", "Remarks"]) == {
        "isin": "ISIN", "pan": "Company PAN", "company": "Name of Company", "valuation": "CMP", "valuation_date": "Valuation Date", "listed_from": "Listed As On",
        "face_value": "Face Value Per Share", "company_type": "Type Of Company", "link": "Drive Link", "notes": "Remarks",
    }
    assert of(["ISIN", "Particulars", "As On", "Fair Value"]) == {"isin": "ISIN", "company": "Particulars", "valuation_date": "As On", "valuation": "Fair Value"}
    assert of(["Type", "Types of units"]) == {"company_type": "Type", "company": "Types of units"} and of(["a", "b"]) == {"company": "a"}


def test_rows(spark):
    tab = spark.createDataFrame([(1, "Acme Pvt", "1,250.5", "01-04-2024", "soon"), (2, "ACME PVT", "9", "", ""), (3, " ", "1", "", ""), (4, "Beta", "-3", "x", "45400"), (5, None, None, None, None)], "n int, Company string, CMP string, `Value Date` string, `IPO Date` string")
    got = [(r["company"], r["valuation"], r["valuation_date"], r["listed_from"], r["bad_date"], r["isin"]) for r in classes.class_rows(tab, "PE", "n").orderBy("row").collect()]
    assert got == [("Acme Pvt", 1250.5, datetime.date(2024, 4, 1), None, "soon", None), ("Beta", None, None, datetime.date(2024, 4, 18), None, None)]


def test_twins_and_guards(spark):
    """A private namesake of a listed company is an entry of its own; a new one with an ISIN does not take its name."""
    master = spark.createDataFrame([(1, "Kusum Limited", None, "KUSUM", None, None, None, None, False), (2, "Plain Ltd", None, None, None, ["Old Plain"], None, "", None), (3, "Tick Ltd", "INE000000011", None, "500001", None, "AIF", "Steel", False)], MASTER)
    rows = spark.createDataFrame(
        [(1, "Kusum Pvt Ltd", None, None), (2, "Kusum", None, None), (3, "old plain", None, None), (4, "Other", "ine000000011", None), (5, "Kusum Private Limited", "INE000000029", None), (6, "New Co", None, None), (7, "New Company", "INE000000037", None), (8, "New Company Ltd", None, datetime.date(2024, 1, 1))],
        "row int, company string, isin string, listed_from date",
    ).selectExpr("*", "'PE' as asset_class", "double(row) as valuation", "date'2024-01-01' as valuation_date", "'' as pan", "10.0 as face_value", "'' as company_type", "'' as notes")
    entries, names, skipped = classes.fold_classes(master, rows, datetime.date(2024, 6, 1))
    got = {r["key"]: (r["how"], r["asset_class"], r["price_except"], r["industry"], r["valuation"]) for r in entries.collect()}
    assert got == {
        "1": ("kept", None, False, None, None),
        "2": ("folded", "PE", True, "Private Equity", 3.0),
        "3": ("folded", "AIF", True, "Steel", 4.0),
        "kusum pvt": ("twin", "PE", True, "Private Equity", 1.0),
        "INE000000029": ("new", "PE", True, "Private Equity", 5.0),
        "new": ("new", "PE", True, "Private Equity", 6.0),
        "INE000000037": ("new", "PE", False, None, 8.0),
    }
    assert {tuple(r) for r in names.collect()} == {("kusum pvt", "kusum pvt"), ("kusum pvt", "INE000000029"), ("new", "new"), ("new company", "INE000000037")}
    assert [tuple(r) for r in skipped.collect()] == [(2, "Kusum", "1")]
