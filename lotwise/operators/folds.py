"""Recursions over a key's rows in order, without gathering them: Spark sorts within partitions (spilling where it must)
and a task runs through its rows with the state of one key."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType


def fold(rows: DataFrame, by: list[str], order: list[str], columns: list[str], start: tuple, step: Callable[..., tuple], names: list[str], each: bool = False) -> DataFrame:
    """(by, names...): ``step(state, *columns)`` applied to the state, a tuple of doubles that begins as ``start``, and
    every row's ``columns``, by ``order``: the last state of each key or, if ``each``, (by, order, names...) with the
    state after every row. No rows: no rows."""
    kept = [*by, *(c for c in dict.fromkeys([*order, *columns]) if c not in by)]
    line = rows.select(*kept).repartition(*by).sortWithinPartitions(*by, *order)
    named = [*by, *(c for c in order if c not in by)] if each else by
    schema = StructType([*(StructField(c, line.schema[c].dataType) for c in named), *(StructField(n, DoubleType()) for n in names)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, types = None, start, []

        def made(done: list[tuple[tuple, tuple]]) -> pa.RecordBatch:
            own = [pa.array([k[i] for k, _ in done], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([*own, *(pa.array([s[i] for _, s in done], pa.float64()) for i in range(len(names)))], names=[*named, *names])

        for batch in batches:
            types, done = [batch.schema.field(c).type for c in named], []
            keys = zip(*(batch.column(c).to_pylist() for c in by), strict=True)
            marks = zip(*(batch.column(c).to_pylist() for c in named), strict=True)
            for now, mark, values in zip(keys, marks, zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True):
                if now != key:
                    if key is not None and not each:
                        done.append((key, state))
                    key, state = now, start
                state = step(state, *values)
                if each:
                    done.append((mark, state))
            if done:
                yield made(done)
        if key is not None and not each:
            yield made([(key, state)])

    return line.mapInArrow(run, schema)
