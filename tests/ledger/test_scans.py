"""Average cost by ranges against the fold and against a loop."""

import random

import numpy as np
import pytest
from lotwise.operators import lots, scans


def plain(rows):
    """The state after every row, key by key."""
    out, state = {}, {}
    for key, at, side, q, p in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        held, cost = state.get(key, (0.0, 0.0))
        if side == "BUY":
            held, cost = held + q, cost + q * p
        elif held <= 0:
            held -= q
        elif held - min(held, q) > 1e-9:
            held, cost = held - q, cost - cost * q / held
        else:
            held, cost = 0.0, 0.0
        out[key, at] = state[key] = (held, cost)
    return out, state


def trades(seed, n, rise):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["b", "c", None]
    return [(rng.choice(keys), i, "BUY" if rng.random() < rise else "SELL", rng.randint(1, 9), float(rng.randint(1, 50))) for i in range(n)]


@pytest.mark.parametrize("seed, rise, size", [(1, 0.5, 7), (2, 0.7, 50), (3, 0.3, 1), (4, 0.5, 10_000)])
def test_ranges_are_the_loop(spark, seed, rise, size):
    rows = trades(seed, 600, rise)
    every, last = plain(rows)
    frame = spark.createDataFrame(rows, "key string, at int, side string, qty bigint, price double").repartition(5)
    got = {r["key"]: (r["qty"], r["cost"]) for r in scans.average_cost(frame, ["key"], ["at"], size=size).collect()}
    assert got.keys() == last.keys() and all(np.allclose(got[k], last[k], atol=1e-6) for k in last)
    got = {(r["key"], r["at"]): (r["qty"], r["cost"]) for r in scans.average_cost(frame, ["key"], ["at"], each=True, size=size).collect()}
    assert got.keys() == every.keys() and all(np.allclose(got[k], every[k], atol=1e-6) for k in every)
    assert scans.average_cost(frame.limit(0), ["key"], ["at"]).collect() == []


def test_hot_keys_go_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(lots, "HOT_ROWS", 200)
    rows = trades(9, 700, 0.5)
    every, last = plain(rows)
    frame = spark.createDataFrame(rows, "key string, at int, side string, qty bigint, price double").repartition(3)
    got = {r["key"]: (r["qty"], r["cost"]) for r in lots.average_cost(frame, ["key"], ["at"]).collect()}
    assert got.keys() == last.keys() and all(np.allclose(got[k], last[k], atol=1e-6) for k in last)
    assert lots.average_cost(frame, ["key"], ["at"], each=True).count() == len(every)


def test_maps_compose():
    """The composed map agrees with the steps for every quantity before, and stays small."""
    rng = random.Random(5)
    for rise in (0.3, 0.5, 0.8):
        signed = np.array([rng.randint(1, 9) * (1 if rng.random() < rise else -1) for _ in range(400)], float)
        upto, shifts, value = scans.composed(signed)
        for before in [*range(-40, 400, 3), 0.5, 1e6]:
            held = float(before)
            for q in signed:
                held = held + q if q > 0 or held <= 0 else held + q if held + q > 1e-9 else 0.0
            assert scans.mapped(float(before), upto, shifts, value) == held
        assert len(upto) < 200 and np.isinf(upto[-1]) and (np.diff(upto) > 0).all()
