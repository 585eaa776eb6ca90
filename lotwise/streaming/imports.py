"""Incremental imports with Structured Streaming: what was imported, and the lots of every key, are the stream's state."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """Stateful processors need the RocksDB store; a stream takes its settings when it starts."""
    was = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, was) if was else spark.conf.unset(PROVIDER)


def _started(spark: SparkSession, rows: DataFrame, mode: str, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    with _state_store(spark):
        return rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Unseen(StatefulProcessor):
    """Of the rows of one key those that exceed what was imported before."""

    def __init__(self, order: list[str]):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.have = handle.getValueState("have", StructType([StructField("n", LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        all_ = sorted(rows, key=lambda r: [(r[c] is not None, r[c] if r[c] is not None else 0) for c in self.order])
        have = self.have.get()[0] if self.have.exists() else 0
        if len(all_) > have:
            self.have.update((len(all_),))
            yield from all_[have:]

    def close(self) -> None:
        pass


def import_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: list[str], order: list[str], files: int | None = None) -> StreamingQuery:
    """Append every batch's rows that no batch before had, as often as they occur in it: importing the same file again
    adds nothing. How often a key was imported is the stream's state, so no batch reads the ledger at ``target``. A batch
    has a folder of its own and ``files`` files at most, so one that runs twice leaves one copy. Rows with a null in
    ``key`` are a key like any other."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)
    new = rows.groupBy(*key).transformWithState(_Unseen(order), rows.schema, "append", "none")
    return _started(spark, new, "append", write, checkpoint)


class _Lots(StatefulProcessor):
    """A key's trades and its open lots. Trades behind the last one go on from the lots; a late one replays the key."""

    def __init__(self, by: list[str]):
        self.by = by

    def init(self, handle: StatefulProcessorHandle) -> None:
        trade = "side string, qty double, price double"
        self.trades = handle.getMapState("trades", "day date, id bigint", trade)
        self.lots = handle.getListState("lots", "qty double, price double")
        self.last = handle.getValueState("last", "day date, id bigint, short double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh: dict[tuple[datetime.date, int], tuple[str, float, float]] = {}
        for r in rows:
            at = (r["trade_date"], r["seq"])
            if at not in fresh and not self.trades.containsKey(at):
                fresh[at] = (r["side"], float(r["qty"]), float(r["price"]))
                self.trades.updateValue(at, fresh[at])
        if not fresh:
            return
        last = self.last.get() if self.last.exists() else None
        late = last is not None and min(fresh) < (last[0], last[1])
        if late:
            line, lots, short = sorted((tuple(k), tuple(v)) for k, v in self.trades.iterator()), [], 0.0
        else:
            line, lots, short = sorted(fresh.items()), [tuple(x) for x in self.lots.get()] if self.lots.exists() else [], last[2] if last else 0.0
        lots, short = matched(lots, short, (t for _, t in line))
        if lots:
            self.lots.put(lots)
        else:
            self.lots.clear()
        self.last.update((*line[-1][0], short))
        yield Row(**dict(zip(self.by, key, strict=True)), net_qty=sum(q for q, _ in lots) - short, invested=float(sum(q * p for q, p in lots)), late=late)

    def close(self) -> None:
        pass


def matched(lots: list[tuple[float, float]], short: float, trades: Iterator[tuple[str, float, float]]) -> tuple[list[tuple[float, float]], float]:
    """Open lots (quantity, price), oldest first, and what is sold short after ``trades`` (side, quantity, price): sales
    take the oldest lots, what they lack is made good by the next purchases."""
    lots, first = list(lots), 0
    for side, qty, price in trades:
        if side == "BUY":
            covered = min(short, qty)
            short -= covered
            if qty > covered:
                lots.append((qty - covered, price))
            continue
        while qty > 0 and first < len(lots):
            have, paid = lots[first]
            used = min(have, qty)
            qty -= used
            if used < have:
                lots[first] = (have - used, paid)
            else:
                first += 1
        short += qty
    return lots[first:], short


def holdings_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, by: list[str], files: int | None = None) -> StreamingQuery:
    """Keep the holdings of every key up to date with files of trades (by, trade_date, seq, side, qty, price): each batch
    writes (by, net_qty, invested, late) of the keys that it changed to a folder of its own, read by holdings_now().

    A trade is known by its day and ``seq``; one that was there before changes nothing. Trades in order go on from the
    key's open lots; one that is dated before the last (``late``) puts the key's trades in order again, and no other's.
    Neither reads what was written before."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)
    out = StructType([*(rows.schema[c] for c in by), StructField("net_qty", DoubleType()), StructField("invested", DoubleType()), StructField("late", BooleanType())])
    return _started(spark, rows.groupBy(*by).transformWithState(_Lots(by), out, "update", "none"), "update", write, checkpoint)


def holdings_now(spark: SparkSession, target: str, by: list[str]) -> DataFrame:
    """(by, net_qty, invested) after the last batch of each key; sold-out keys are left out."""
    all_ = spark.read.parquet(target)
    value = [c for c in all_.columns if c not in (*by, "batch")]
    last = all_.groupBy(*by).agg(F.max_by(F.struct(*value), "batch").alias("x"))
    return last.select(*by, "x.net_qty", "x.invested").filter("net_qty <> 0")
