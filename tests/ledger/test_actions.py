"""Corporate actions and text lines against plain loops and cases worked out by hand."""

from collections import defaultdict
from datetime import date

import pytest
from lotwise.operators import actions, lots, schedules
from lotwise.plans import schedule_queries
from lotwise.sources import notes
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"


def day(d):
    return date(2024, 1, d)


def lots_of(spark, events):
    rows = [(k, day(d), i, kind, float(q), float(p), num, den, to, cost) for i, (k, d, kind, q, p, num, den, to, cost) in enumerate(events)]
    out = actions.replay(spark.createDataFrame(rows, actions.EVENT)).collect()
    return sorted((r["key"], r["net_qty"], r["acquired"].day if r["acquired"] else None, r["qty"], round(r["cost"], 6)) for r in out)


def trade(key, d, kind, qty, price):
    return key, d, kind, qty, price, None, None, None, None


def test_split_and_bonus(spark):
    got = lots_of(spark, [trade(1, 1, "BUY", 10, 6), (1, 2, "SPLIT", 0, 0, 3.0, 1.0, None, None), (1, 3, "BONUS", 0, 0, 1.0, 2.0, None, None), trade(1, 4, "SELL", 35, 9)])
    assert got == [(1, 10.0, 3, 10.0, 0.0)]


def test_deficit_is_covered_first(spark):
    assert lots_of(spark, [trade(1, 1, "SELL", 4, 9), trade(1, 2, "BUY", 10, 2), trade(2, 1, "SELL", 4, 9)]) == [(1, 6.0, 2, 6.0, 12.0), (2, -4.0, None, 0.0, 0.0)]


def test_merger_hands_dates_and_cost_on(spark):
    got = lots_of(spark, [trade(1, 1, "BUY", 10, 1), trade(1, 3, "BUY", 20, 4), trade(2, 2, "BUY", 5, 7), (1, 4, "MERGER", 10, 0, None, None, 2, 90.0), trade(2, 5, "SELL", 4, 9)])
    # seven and three whole shares for 20 and 10; the oldest three and one of day 2 are sold
    assert got == [(1, 0.0, None, 0.0, 0.0), (2, 11.0, 2, 4.0, 28.0), (2, 11.0, 3, 7.0, 80.0)]


def test_demerger_lowers_the_cost_of_the_parent(spark):
    got = lots_of(spark, [trade(1, 1, "BUY", 10, 10), (1, 2, "DEMERGER", 5, 0, None, None, 2, 25.0)])
    assert got == [(1, 10.0, 1, 10.0, 75.0), (2, 5.0, 1, 5.0, 25.0)]


def test_action_without_lots_makes_one_parcel(spark):
    assert lots_of(spark, [(1, 2, "MERGER", 5, 0, None, None, 2, 25.0)]) == [(1, 0.0, None, 0.0, 0.0), (2, 5.0, 2, 5.0, 25.0)]


def test_no_events(spark):
    assert lots_of(spark, []) == []


def test_replay_is_the_loop(spark):
    """All events of the table in one loop over single rows, by lists that are searched whole."""
    events = schedule_queries.action_events(spark, DIR).collect()
    rank = {"BUY": 0, "BONUS": 0, "SELL": 2}
    lots, net = defaultdict(list), defaultdict(float)
    for e in sorted(events, key=lambda e: (e["at"], rank.get(e["kind"], 1), e["seq"])):
        own, k, kind = sorted(lots[e["key"]], key=lambda x: x[0]), e["key"], e["kind"]
        if kind in ("BUY", "BONUS"):
            q = e["qty"] if kind == "BUY" else max(0, net[k]) * e["num"] / e["den"]
            own.append([e["at"], q - min(q, max(0, -net[k])), e["price"] if kind == "BUY" else 0.0])
            net[k] += q
        elif kind == "SELL":
            net[k] -= e["qty"]
            gone = e["qty"]
            for lot in own:
                cut = min(gone, lot[1])
                lot[1], gone = lot[1] - cut, gone - cut
        elif kind == "SPLIT":
            if sum(x[1] for x in own) > 1e-9:
                net[k] += sum(x[1] for x in own)
                own = [[d, q * 2, p / 2] for d, q, p in own]
        else:
            worth = sum(q * p for _, q, p in own)
            keep = 0 if kind == "MERGER" else max(0, 1 - e["cost"] / worth) if worth else 1
            given = [(d, q, q * p * (1 - keep)) for d, q, p in own if q > 1e-9]
            own = [] if kind == "MERGER" else [[d, q, p * keep] for d, q, p in own]
            net[k] = 0.0 if kind == "MERGER" else net[k]
            net[e["to_key"]] += e["qty"]
            lots[e["to_key"]] = sorted(lots[e["to_key"]] + [[d, q, c / q] for d, q, c in actions.parcels(given, e["qty"], e["cost"], e["at"])], key=lambda x: x[0])
        lots[k] = own
    got = {r["key"]: (r["net"], r["cost"]) for r in actions.replay(schedule_queries.action_events(spark, DIR)).groupBy("key").agg(F.first("net_qty").alias("net"), F.sum("cost").alias("cost")).collect()}
    assert got.keys() == net.keys()
    for k, n in net.items():
        worth = sum(q * p for _, q, p in lots[k]) if n > 1e-9 else 0.0
        assert got[k] == (pytest.approx(n), pytest.approx(worth, abs=1e-6))


def test_text_lines_keep_their_anchor(spark):
    rows = [("p", x, y, i, t) for i, (x, y, t) in enumerate([(2.0, 770.0, "b"), (1.0, 766.0, "a"), (0.0, 764.0, "d"), (1.0, 760.0, "e"), (0.0, 758.9, "g"), (5.0, 770.0, "c")])]
    out = schedules.text_lines(spark.createDataFrame(rows, "page string, x double, y double, seq int, text string"), ["page"]).collect()
    assert sorted((r["line"], r["text"]) for r in out) == [(1, "a b c"), (2, "d e"), (3, "g")]


def test_announcements(spark):
    rows = [("Bonus 1:1", "BONUS", 2.0), ("BONUS ISSUE - 2:5 of shares", "BONUS", 1.4), ("Bonus 0:1", None, None), ("Face Value Split From Rs 10/- Per Share To Rs 2/- Per Share", "SPLIT", 5.0), ("Sub-Division from Re 1 to Rs. 10", None, None), ("Dividend", None, None), (None, None, None)]
    frame = spark.createDataFrame(rows, "said string, kind string, factor double").withColumn("r", schedules.announced_ratio(F.col("said")))
    assert [(r["r"]["kind"], r["r"]["factor"]) if r["r"] else (None, None) for r in frame.collect()] == [(k, f) for _, k, f in rows]


def test_slices_are_the_whole(spark):
    rows = [sorted(map(tuple, q(spark, DIR).collect())) for q in (schedule_queries.statement_lots, schedule_queries.statement_slices)]
    assert rows[0] and [r[:2] for r in rows[0]] == [r[:2] for r in rows[1]]
    assert all(a[2:] == pytest.approx(b[2:], abs=0.011) for a, b in zip(*rows, strict=True))


def test_statement_average(spark):
    kinds = [("BUY", 10, 6, None, None), ("RIGHT", 0, 3, 1.0, 2.0), ("SPLIT", 0, 0, 2.0, 1.0), ("SELL", 40, 0, None, None), ("BUY", 30, 5, None, None)]
    got = {}
    for n in range(1, 6):
        frame = spark.createDataFrame([(1, i, k, float(q), float(p), a, b) for i, (k, q, p, a, b) in enumerate(kinds[:n])], "key int, seq int, kind string, qty double, price double, num double, den double")
        got[n] = tuple(lots.statement_average(frame, ["key"], ["seq"]).first())[1:]
    assert got == {1: (10.0, 6.0), 2: (15.0, 5.0), 3: (30.0, 2.5), 4: (-10.0, 0.0), 5: (20.0, 5.0)}


def test_senders_and_contracts(spark):
    texts = [("Date Trans Type Asset Name Bal Qty Brokerage", "transaction-report"), ("ZERODHA Broking", "zerodha"), ("Axis Securities Limited Security/Contract Buy/Sell", "axis"), ("Security/Contract Buy/Sell", "integrated"), ("Nuvama Wealth and Investment", "nuvama-v2"), ("Nuvama Wealth: WAP Mkt Rate", "nuvama-v3"), ("Edelweiss Broking Ltd", "nuvama-v1"), ("", "zerodha"), (None, "zerodha")]
    frame = spark.createDataFrame(texts, "t string, s string")
    assert [r[0] for r in frame.select(notes.sender(F.col("t"))).collect()] == [s for _, s in texts]
    names = [("NIFTY03NOV202621550PE", True), ("ULTRACEMCO25AUG2026", True), ("BF ABC25AUG2026 FUT", True), ("NIFTY(OPTIDX-1)", True), ("NIFTYBEES", False), ("May 2024 Ltd", False), (None, False)]
    frame = spark.createDataFrame(names, "n string, d boolean")
    assert frame.filter(notes.is_derivative(F.col("n")) != F.col("d")).count() == 0
    text = "1 NIFTY(OPTIDX-21550-PE) 5 1,200.50\n2 X(FUTSTK-A) n/a\n3 RELIANCE 9 99.0\nTrade Date : 03-11-2026 x"
    got = spark.createDataFrame([(text,)], "t string").select(notes.derivative_tax(F.col("t")), notes.trade_date(F.col("t"))).first()
    assert tuple(got) == (1200.5, "03-11-2026")
