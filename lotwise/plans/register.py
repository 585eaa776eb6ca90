"""A register of queries, and the SQL text that their oracles share."""

from __future__ import annotations

from collections.abc import Callable


class Register:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def r2(x: str) -> str:
    return f"(floor(({x}) * 100.0 + 0.5) / 100.0)"


def r6(x: str) -> str:
    return f"(floor(({x}) * 1000000.0 + 0.5) / 1000000.0)"


#: The ledger of events and that of lineitem.
LE = """le AS (SELECT user_id % 5 AS portfolio, user_id AS key, event_id AS seq, CAST(ts AS DATE) AS trade_date,
  CASE event_type WHEN 'click' THEN 'SELL' ELSE 'BUY' END AS side,
  CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) + 1 AS qty, value AS price
  FROM events WHERE event_type <> 'error' AND value > 0)"""
LI = f"""li AS (SELECT l_suppkey % 10 AS portfolio, l_partkey AS key, CAST(l_shipdate AS DATE) AS trade_date,
  CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END AS ord,
  CAST(l_quantity AS BIGINT) AS qty, l_extendedprice AS turnover, l_extendedprice / l_quantity AS price,
  {r2("l_extendedprice * l_discount")} AS brokerage, {r2("l_extendedprice * l_tax")} AS stt, l_orderkey, l_linenumber FROM lineitem)"""
LINE_ORDER = "trade_date, ord, l_orderkey, l_linenumber, qty, turnover, brokerage, stt"
CLOSES = "closes AS (SELECT user_id AS key, CAST(ts AS DATE) AS session, max(value) AS close FROM events WHERE event_type = 'purchase' AND value > 0 GROUP BY ALL)"
SQUARED = """sq AS (SELECT key, trade_date, min(seq) AS seq, count(*) AS n, sum(CASE WHEN side = 'BUY' THEN qty ELSE 0 END) AS b,
  sum(CASE WHEN side = 'BUY' THEN 0 ELSE qty END) AS s, sum(CASE WHEN side = 'BUY' THEN qty * price ELSE 0 END) AS v, max(price) AS p
  FROM le GROUP BY key, trade_date),
net AS (SELECT key, trade_date, seq, CASE WHEN b > s THEN 'BUY' ELSE 'SELL' END AS side, abs(b - s) AS qty,
  CASE WHEN n = 1 THEN p WHEN b > s THEN v / b ELSE 0 END AS price FROM sq WHERE b <> s)"""

#: Lots and sales of lineitem matched first in, first out, with the rows they come from.
MATCHED = f"""{LI}, t AS (SELECT *, row_number() OVER w AS rn, sum(CASE WHEN side='BUY' THEN qty ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS cb,
  sum(CASE WHEN side='SELL' THEN qty ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS cs, year(trade_date) - CASE WHEN month(trade_date) < 4 THEN 1 ELSE 0 END AS fy FROM li WINDOW w AS (PARTITION BY portfolio, key ORDER BY {LINE_ORDER})),
u AS (SELECT *, greatest(0, max(cs - cb) OVER (PARTITION BY portfolio, key ORDER BY rn)) AS d FROM t),
s AS (SELECT *, cs - d AS hi, coalesce(lag(cs - d) OVER (PARTITION BY portfolio, key ORDER BY rn), 0) AS lo FROM u WHERE side='SELL'),
mm AS (SELECT b.portfolio, b.key, b.rn AS brn, s.rn AS srn, b.trade_date AS buy_date, s.trade_date AS sale_date, s.fy AS sale_fy, least(b.cb, s.hi) - greatest(b.cb - b.qty, s.lo) AS qty, b.price AS bp, s.price AS sp
  FROM u b JOIN s ON b.portfolio = s.portfolio AND b.key = s.key AND b.side = 'BUY' AND least(b.cb, s.hi) > greatest(b.cb - b.qty, s.lo))"""
