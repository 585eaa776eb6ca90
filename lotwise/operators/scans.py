"""Average cost of keys that hold so many rows that one task must not follow them: the recursion as a scan of maps.

Every step is a map of the position (quantity and cost): a purchase adds to both; a sale takes from the quantity, stops
at zero when it begins above zero, and scales the cost. Maps compose, so a key's rows are cut into ranges by Spark's
range partitioning, and

1. each range composes its steps into one map of the quantity: on intervals of what the quantity is before, it is shifted
   or becomes a constant. Positions that a sale brings to zero are the same from there on, so a range has few intervals.
2. One row a range: going through a key's ranges in order gives every range the quantity that it begins with.
3. Knowing that, each range is one affine map of the cost (a factor and an addend); again one row a range, in order.
4. Each range applies both, for the state after every row or after the last.

Tasks hold a range's rows at a time, whatever the key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from lotwise.session import written

#: Rows of a range, and what counts as nothing left of a position.
RANGE, NOTHING = 50_000, 1e-9


def composed(signed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The map of the quantity by trades (sales negative): (upto, shifts, value) of intervals that end at ``upto``, the
    last at infinity; a quantity of one of them is shifted by ``value`` or becomes it."""
    upto, shifts, value = np.array([np.inf]), np.array([True]), np.array([0.0])
    ends = np.flatnonzero(np.diff(signed > 0)) + 1
    for run in np.split(signed, ends):
        if len(run) and run[0] > 0:
            value = value + run.sum()
            continue
        for sold in -run:
            # A shifted interval falls apart where it meets zero and where it meets what is sold.
            cuts = np.concatenate((upto, (-value)[shifts], (sold + NOTHING - value)[shifts]))
            low = np.concatenate(([-np.inf], upto[:-1]))
            at = np.unique(cuts)
            own = np.searchsorted(upto, at, "left")
            inside = (at > low[own]) & (at <= upto[own])
            upto, shifts, value = at[inside], shifts[own[inside]], value[own[inside]]
            # every interval lies on one side of both marks now; its middle tells which, whatever its ends were rounded to
            low = np.concatenate(([-np.inf], upto[:-1]))
            middle = np.where(np.isinf(low), np.where(np.isinf(upto), 0.0, upto - 1), np.where(np.isinf(upto), low + 1, (low + upto) / 2))
            then = np.where(shifts, middle + value, value)
            gone = (then > 0) & (then <= sold + NOTHING)
            shifts, value = shifts & ~gone, np.where(gone, 0.0, value - sold)
            same = (shifts[1:] == shifts[:-1]) & (value[1:] == value[:-1])
            keep = np.append(~same, True)
            upto, shifts, value = upto[keep], shifts[keep], value[keep]
    return upto, shifts, value


def mapped(held: float, upto: np.ndarray, shifts: np.ndarray, value: np.ndarray) -> float:
    i = int(np.searchsorted(upto, held, "left"))
    return held + float(value[i]) if shifts[i] else float(value[i])


def followed(held: float, signed: np.ndarray, cash: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The quantity after every trade, and the affine map of the cost up to it: cost = factor * before + addend."""
    quantity, factor, addend = np.empty(len(signed)), np.empty(len(signed)), np.empty(len(signed))
    f, a = 1.0, 0.0
    for i, (q, c) in enumerate(zip(signed.tolist(), cash.tolist(), strict=True)):
        if q > 0:
            held, a = held + q, a + c
        elif held <= 0:
            held += q
        else:
            left = held + q
            if left > NOTHING:
                share = left / held
                held, f, a = left, f * share, a * share
            else:
                held, f, a = 0.0, 0.0, 0.0
        quantity[i], factor[i], addend[i] = held, f, a
    return quantity, factor, addend


def _floats(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.float64)


def _ranges(rows: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """(by, part, no, signed, cash, order columns as arrays, upto, shifts, value): ranges of one key's rows, in order."""
    line = rows.select(*by, *(c for c in order if c not in by), F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty")).cast("double").alias("__signed"), (F.col("qty") * F.col("price")).cast("double").alias("__cash"))
    line = line.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    marks = [c for c in order if c not in by]
    schema = StructType([*(line.schema[c] for c in by), StructField("part", LongType()), StructField("no", LongType()), *(StructField(n, BinaryType()) for n in ("signed", "cash", "upto", "shifts", "value")), *(StructField(c, ArrayType(line.schema[c].dataType)) for c in marks)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no, held = TaskContext.get().partitionId(), 0, None
        types = None

        def made(key: tuple, pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal no
            whole = pa.Table.from_batches(pieces)
            signed, cash = (whole.column(c).to_numpy().astype(np.float64) for c in ("__signed", "__cash"))
            upto, shifts, value = composed(signed)
            plain = [pa.array([v], types[c]) for c, v in zip(by, key, strict=True)]
            packed = [pa.array([x.tobytes()], pa.binary()) for x in (signed, cash, upto, shifts, value)]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole.column(c).combine_chunks()) for c in marks]
            no += 1
            return pa.RecordBatch.from_arrays([*plain, pa.array([part], pa.int64()), pa.array([no], pa.int64()), *packed, *lists], names=schema.names)

        for batch in batches:
            types = {c: batch.schema.field(c).type for c in by}
            new = np.zeros(batch.num_rows, bool)
            for c in by:
                code = batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            for a, b in zip([0, *(cuts := np.flatnonzero(new).tolist())], [*cuts, batch.num_rows], strict=True):
                key = tuple(batch.column(c)[a].as_py() for c in by)
                if held and held[0] != key:
                    yield made(*held)
                    held = None
                while a < b:
                    have = sum(p.num_rows for p in held[1]) if held else 0
                    take = min(b - a, size - have)
                    held = (key, [*(held[1] if held else []), batch.slice(a, take)])
                    a += take
                    if have + take == size:
                        yield made(*held)
                        held = None
        if held:
            yield made(*held)

    return line.mapInArrow(run, schema)


def _carried(rows: DataFrame, by: list[str], columns: list[str], step, start: tuple, names: list[str]) -> DataFrame:
    """(part, no, names): the state before every range, going through each key's ranges in order."""
    line = rows.select(*by, "part", "no", *columns).repartition(*by).sortWithinPartitions(*by, "part", "no")
    schema = StructType([StructField("part", LongType()), StructField("no", LongType()), *(StructField(n, DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, start
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[: len(by)] != key:
                    key, state = row[: len(by)], start
                out.append((*row[len(by) : len(by) + 2], *state))
                state = step(state, *row[len(by) + 2 :])
            columns = list(zip(*out, strict=True)) if out else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.float64()) for i, c in enumerate(columns)], names=schema.names)

    return line.mapInArrow(run, schema)


def average_cost(rows: DataFrame, by: list[str], order: list[str], each: bool = False, size: int = RANGE) -> DataFrame:
    """(by, qty, cost) of rows (by, order, side, qty, price) by weighted-average release, after the last row of each key
    or, if ``each``, (by, order, qty, cost) after every row; what folds.fold gives, a range at a time."""
    ranges = written(_ranges(rows, by, order, size), "ranges")
    maps = ["upto", "shifts", "value"]
    before = _carried(ranges, by, maps, lambda s, u, k, v: (mapped(s[0], _floats(u), np.frombuffer(k, bool), _floats(v)),), (0.0,), ["held"])
    place = ["part", "no"]

    def affine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = []
            for held, signed, cash in zip(*(batch.column(c).to_pylist() for c in ("held", "signed", "cash")), strict=True):
                _, factor, addend = followed(held, _floats(signed), _floats(cash))
                ends.append((factor[-1], addend[-1]))
            kept = [batch.column(c) for c in (*by, *place, "held")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([e[i] for e in ends], pa.float64()) for i in range(2))], names=[*by, *place, "held", "factor", "addend"])

    kept = StructType([*(ranges.schema[c] for c in by), StructField("part", LongType()), StructField("no", LongType()), *(StructField(n, DoubleType()) for n in ("held", "factor", "addend"))])
    known = written(ranges.select(*by, *place, "signed", "cash").join(before, place).mapInArrow(affine, kept), "affine")
    costs = _carried(known, by, ["factor", "addend"], lambda s, f, a: (s[0] * f + a,), (0.0,), ["before"])
    start = known.select(*place, "held").join(costs, place)
    marks = [c for c in order if c not in by] if each else []
    if not each:
        last = ranges.groupBy(*by).agg(F.max(F.struct(*place)).alias("__at")).select(*(F.col("__at")[c].alias(c) for c in place))
        ranges = ranges.join(last, place, "left_semi")
    out = StructType([*(ranges.schema[c] for c in by), *(StructField(c, rows.schema[c].dataType) for c in marks), StructField("qty", DoubleType()), StructField("cost", DoubleType())])

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("held", "before", "signed", "cash")}
                quantity, factor, addend = followed(row["held"], _floats(row["signed"]), _floats(row["cash"]))
                cost = row["before"] * factor + addend
                n = len(quantity) if each else 1
                keys = [batch.column(c).slice(i, 1).take(pa.array(np.zeros(n, np.int64))) for c in by]
                lists = [batch.column(c).slice(i, 1).flatten() for c in marks]
                yield pa.RecordBatch.from_arrays([*keys, *lists, pa.array(quantity[-n:]), pa.array(cost[-n:])], names=out.names)

    return ranges.select(*by, *place, "signed", "cash", *marks).join(start, place).mapInArrow(states, out)
