"""Streams that are stopped and started again, with late, repeated and renamed files."""

import datetime
import random

import pytest
from lotwise.operators import lots
from lotwise.streaming import imports, notes
from test_note_layouts import HTML, TEXT

SCHEMA = "portfolio bigint, key string, trade_date date, seq bigint, side string, qty double, price double"


def test_holdings_with_late_and_repeated_files(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randint(0, 1), rng.choice("abc"), datetime.date(2024, 1, 1 + i // 4), i, rng.choice(["BUY", "BUY", "SELL"]), float(rng.randint(1, 9)), float(rng.randint(1, 20))) for i in range(80)]
    at = {k: str(tmp_path / k) for k in ("in", "out", "state")}
    by = ["portfolio", "key"]
    seen, lates = set(), 0
    for chunk in (rows[:20], rows[40:60], rows[20:40], rows[40:60], rows[60:]):  # the third is late, the fourth a repeat
        spark.createDataFrame(chunk, SCHEMA).coalesce(1).write.mode("append").parquet(at["in"])
        query = imports.holdings_stream(spark, at["in"], SCHEMA, at["out"], at["state"], by)
        query.awaitTermination()
        seen |= set(chunk)
        want = {(r["portfolio"], r["key"]): (r["net_qty"], r["invested"]) for r in lots.holdings(spark.createDataFrame(sorted(seen, key=lambda r: r[3]), SCHEMA), by, ["trade_date", "seq"]).collect()}
        got = {(r["portfolio"], r["key"]): (r["net_qty"], round(r["invested"], 2)) for r in imports.holdings_now(spark, at["out"], by).collect()}
        assert got == want
    batches = {r["batch"]: r["n"] for r in spark.read.parquet(at["out"]).groupBy("batch").agg({"late": "count"}).withColumnRenamed("count(late)", "n").collect()}
    assert spark.read.parquet(at["out"]).filter("late").select("batch").distinct().count() == 1 and len(batches) <= 5


def test_import_counts_copies(spark, tmp_path):
    """A batch adds what it has more often than any before; nulls are keys."""
    schema, key = "key string, qty bigint", ["key", "qty"]
    at = {k: str(tmp_path / k) for k in ("in", "ledger", "state")}
    for rows in ([("a", 1), ("a", 1), (None, 2)], [("a", 1), (None, 2)], [("a", 1)] * 3 + [("b", None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at["in"])
        imports.import_stream(spark, at["in"], schema, at["ledger"], at["state"], key, key).awaitTermination()
    got = sorted(((r["key"], r["qty"]) for r in spark.read.schema(schema).parquet(at["ledger"]).collect()), key=str)
    assert got == sorted([("a", 1)] * 3 + [(None, 2), ("b", None)], key=str)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "notes").mkdir()
    return tmp_path / "notes"


def test_notes_import_themselves(spark, tmp_path, folder):
    axis = TEXT.replace("Letterhead", "AXISDIRECT")
    with_future = axis.replace("BETA LTD-Cash- S 10 100.00 0.00 100.00 1000.00", "NIFTY25NOV2026FUT-Cash- S 10 100.00 0.00 100.00 1000.00")
    at = {k: str(tmp_path / k) for k in ("out", "state")}

    def run():
        notes.note_stream(spark, str(folder), at["out"], at["state"]).awaitTermination()
        rows = spark.read.parquet(f"{at['out']}/trades").select("client", "name", "side", "qty").collect()
        return sorted((r["client"] or "", r["name"], r["side"], r["qty"]) for r in rows)

    (folder / "a.txt").write_text(axis)
    first = run()
    assert first == [("", "BETA LTD", "SELL", 10.0), ("AB12", "ALPHA MOTORS LIMITED", "BUY", 1500.0), ("AB12", "BETA LTD", "SELL", 10.0)]
    assert run() == first  # nothing new
    (folder / "again.txt").write_text(axis)  # the same notes under another name
    (folder / "b_T059_note.html").write_text(HTML)
    (folder / "c.txt").write_text("nothing that anybody sends")
    second = run()
    assert [r for r in second if r[0] != "T059"] == first and sorted(r[1:3] for r in second if r[0] == "T059") == [("Alpha & Sons", "BUY"), ("Alpha & Sons", "SELL"), ("Beta", "BUY"), ("Gamma", "BUY")]
    (folder / "d.txt").write_text(with_future.replace("CN-", "DN-").replace("31-JUL-24", "02-AUG-24").replace("01-AUG-2024", "05-AUG-2024"))
    third = run()
    assert len(third) == len(second) + 2 and not any("NIFTY" in r[1] for r in third)
    log = {(r["file"].rsplit("/", 1)[1], r["note"]): (r["sender"], r["trades"], r["dropped"], r["verdict"]) for r in spark.read.parquet(f"{at['out']}/log").collect()}
    assert log["a.txt", "CN-7"] == ("axis", 2, 0, "PASSED") and log["b_T059_note.html", None] == ("integrated", 4, 0, "PASSED")
    assert log["c.txt", None][1:] == (0, 0, "No layout") and log["d.txt", None][1:] == (0, 1, "Derivatives only")
