"""What the training-data operators share."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: The whitespace of the word rule [^\x20\x09-\x0D]+ (bytes.split() splits at the same bytes).
SPACES = " \t\n\x0b\x0c\r"
#: Rows of a slice that a Python task works on at once. Spark bounds the batches it sends (64 MB of Arrow data by
#: default), slices bound what is made from them; the session's settings stay the caller's.
BATCH_ROWS = 256


def shape(*fields: tuple[str, DataType | str]) -> StructType:
    """A schema from (name, type) pairs. Types go to Spark as objects, so that fields of nested columns may have any
    name."""
    return StructType([StructField(n, DataType.fromDDL(t) if isinstance(t, str) else t) for n, t in fields])


def column(name: str) -> Column:
    """The column of that name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(batch: pa.RecordBatch, column: str) -> Iterator[str]:
    """The texts of a batch one by one; null is the empty text."""
    for x in batch.column(column):
        yield x.as_py() or ""


def batches_of(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, so that what is made from it stays small too."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def lists(parts: list[bytes], kind: np.dtype, arrow: pa.DataType) -> pa.Array:
    """An Arrow list column from the raw little-endian items of each row."""
    width = np.dtype(kind).itemsize
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // width for p in parts], out=offsets[1:])
    values = np.frombuffer(b"".join(parts), dtype=kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=arrow))


def all_of(conditions):
    """The conjunction of column conditions."""
    return functools.reduce(operator.and_, conditions)


class ChunkCache(dict):
    """chunk -> encoding, made once for each chunk that stays in use. Two generations of at most ``most`` entries
    are kept: a full one becomes the old one, from which what is used again moves on. A worker's memory stays bounded
    whatever vocabulary the corpus has."""

    def __init__(self, make, most: int = 150_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, chunk):
        if (value := self.old.get(chunk)) is None:
            value = self.make(chunk)
        return self.put(chunk, value)

    def put(self, chunk, value):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[chunk] = value
        return value

    def add(self, made: dict) -> None:
        """Many at once; a generation is larger than ``most`` only if they are."""
        if len(self) + len(made) > self.most:
            self.old = dict(self)
            self.clear()
        self.update(made)
