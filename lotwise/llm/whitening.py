"""Whitening of embeddings from an exact scatter matrix in residue numbers.

Components become integers, floor(SCALE * c). The sum of the outer products of all distinct vectors is computed without
rounding: each partition multiplies its vectors modulo several primes, as float64 matrix products of residues that stay
below 2**53, the products are summed modulo each prime by Spark, and the Chinese remainder theorem gives the integer
matrix back. As many primes are taken as the number of vectors and their largest entry ask for. The covariance is
then one rounding away from exact, whatever the order of the sums, and its eigenvectors come from a double eigh.

Only the matrix (dimensions squared, whatever the number of vectors) reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.common import column, shape, table
from lotwise.session import written

SCALE, COMPONENTS = 256, 4
#: Residues are at most half a prime in size, so that products of BLOCK_ROWS vectors stay below 2**53.
PRIME_BITS, BLOCK_ROWS = 21, 4096
#: Eigenvalues below this share of the largest are those of a direction in which the vectors do not vary.
LEAST_SHARE = 1e-12


def primes(product: int) -> list[int]:
    """The largest primes of PRIME_BITS bits whose product is beyond ``product``."""
    out, p, have = [], (1 << PRIME_BITS) - 1, 1
    while have <= product:
        if all(p % d for d in range(3, isqrt(p) + 1, 2)):
            out.append(p)
            have *= p
        p -= 2
    return out


def remainders(of: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The integers (Python's, around zero) that have the given remainders."""
    whole, value = 1, np.zeros(of[0].shape, object)
    for r, p in zip(of, moduli, strict=True):
        step = (r.astype(object) - value) * pow(whole, -1, p) % p
        value, whole = value + step * whole, whole * p
    return np.where(value > whole // 2, value - whole, value)


@dataclass(frozen=True)
class Whitening:
    """What the fit knows: n vectors, their sums, components as columns, their variances, their shares of the trace and
    the largest error of the whitened covariance."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    shares: np.ndarray
    error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Coordinates of integer vectors; nan where the vectors don't vary."""
        mean = np.array([s / self.n for s in self.sums.tolist()])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (x - mean) @ self.vectors / np.sqrt(self.values), np.nan)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n * x - sum) ** 2, exact."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums.tolist()), default=0)
        if x.shape[1] * most * most < 1 << 63:
            d = self.n * x - self.sums.astype(np.int64)
        else:
            d = self.n * x.astype(object) - self.sums
        return [int(v) for v in (d * d).sum(axis=1)]


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def integers(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec, x): the rows that take part, with floor(SCALE * c) of each entry as a long."""
    v = column(vector_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    entry = lambda c: F.floor(c.cast("double") * SCALE)  # noqa: E731  a long: there is no minus zero
    return rows.filter(v.isNotNull() & ~bad).select(column(id_col).alias("vec"), F.transform(v, entry).cast("array<bigint>").alias("x"))


def scatter(fit: DataFrame, width: int, moduli: list[int]) -> list[np.ndarray]:
    """The sum of x xT over all rows modulo each of ``moduli``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((len(moduli), width, width), np.int64), False
        for batch in batches:
            x = _matrix(batch.column(0), width)
            some |= len(x) > 0
            for a in range(0, len(x), BLOCK_ROWS):
                for k, p in enumerate(moduli):
                    r = np.mod(x[a : a + BLOCK_ROWS], p)
                    r = np.where(r > p // 2, r - p, r).astype(np.float64)
                    total[k] = (total[k] + (r.T @ r).astype(np.int64)) % p
        cells = total.reshape(len(moduli), -1)
        for k in range(len(moduli) if some else 0):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(cells.shape[1], k, np.int32)), pa.array(np.arange(cells.shape[1], dtype=np.int32)), pa.array(cells[k])], names=["modulus", "cell", "value"])

    sums = fit.select("x").mapInArrow(run, "modulus int, cell int, value bigint").groupBy("modulus", "cell").agg(F.sum("value").alias("value"))
    out = np.zeros((len(moduli), width * width), np.int64)
    for row in sums.toLocalIterator():
        out[row["modulus"], row["cell"]] = row["value"] % moduli[row["modulus"]]
    return [x.reshape(width, width) for x in out]


def fit_whitening(vectors: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """Fit on each distinct x of integers() once; None without any."""
    sized = vectors.select("x")
    width = sized.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return None
    fit = written(_padded(sized, width).distinct(), "fit")
    size = F.array_max(F.transform("x", lambda c: F.greatest(F.abs(c.cast("decimal(20,0)")), F.lit(1).cast("decimal(20,0)"))))
    n, top = fit.agg(F.count(F.lit(1)), F.max(size)).first()
    # The sum of each dimension is at most n * top, an entry of the scatter n * top ** 2; either sign.
    at = fit.select(F.posexplode("x").alias("cell", "v")).groupBy("cell").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"))
    sums = np.zeros(width, object)
    for row in at.toLocalIterator():
        sums[row["cell"]] = int(row["s"])
    moduli = primes(2 * n * int(top) ** 2)
    exact = remainders(scatter(fit, width, moduli), moduli)
    centred = n * exact - np.outer(sums, sums)  # n ** 2 times the covariance, in integers
    covariance = np.array([v / (n * n) for v in centred.ravel().tolist()]).reshape(width, width)
    values, vecs = np.linalg.eigh(covariance)
    trace = sum(centred.diagonal().tolist()) / (n * n)
    order = np.argsort(-values)[:most]
    kept = np.where(values[order] > LEAST_SHARE * max(values.max(), 0), values[order], 0.0)
    model = Whitening(n, sums, vecs[:, order], kept, kept / trace if trace else np.zeros(len(order)))
    return Whitening(n, sums, model.vectors, kept, model.shares, _error(fit, model))


def _padded(rows: DataFrame, width: int) -> DataFrame:
    """Shorter vectors end in zeros."""
    zeros = F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("x"))
    return rows.withColumn("x", F.when(F.size("x") < width, F.concat("x", zeros)).otherwise(F.col("x")))


def _error(fit: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened covariance less the identity, over components that vary."""
    live = np.flatnonzero(model.values > 0)
    width, k = len(model.sums), len(live)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # whitened() takes the exact mean away, so the products are centred
        total = np.zeros((k, k))
        for batch in batches:
            w = model.whitened(_matrix(batch.column(0), width))[:, live]
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "value"])

    sums = fit.select("x").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    got = np.zeros(k * k)
    for cell, value in sums:
        got[cell] = value / model.n
    return float(np.abs(got.reshape(k, k) - np.eye(k)).max())


def whiten(rows: DataFrame, most: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec, component, n, deviation, whitened, explained, identity_error) for each row that takes part and each of the
    first ``most`` components, numbered from 1 by falling variance; deviation is a decimal.

    Rows whose vector is null or holds null or non-finite entries take no part. Null ids stay, repeated rows each get
    their results but count once in the fit. Vectors shorter than the longest end in zeros; if none has an entry there
    are no components and no rows. There are no more components than dimensions; one in which the vectors don't vary
    has explained 0 and whitened null and is left out of identity_error. No rows: no rows. Other columns are not read.
    An entry whose integer is beyond a long is cut to the nearest long; a deviation beyond 38 digits is an error.
    """
    vectors = integers(rows, id_col, vector_col)
    model = fit_whitening(vectors, most)
    out = shape(("vec", rows.schema[id_col].dataType), ("component", "int"), ("n", "bigint"), ("deviation", "decimal(38,0)"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))
    if model is None:
        return rows.sparkSession.createDataFrame([], out)
    width, k = len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in batches:
            x = _matrix(batch.column(1), width)
            each = np.repeat(np.arange(len(x)), k)
            w = model.whitened(x).ravel()
            columns = [
                batch.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), model.n, np.int64)),
                pa.array([Decimal(v) for v in model.deviations(x)], pa.decimal128(38, 0)).take(pa.array(each)),
                pa.array(w, mask=np.isnan(w)),
                pa.array(np.tile(model.shares, len(x))),
                pa.array(np.full(len(each), model.error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return _padded(vectors, width).select("vec", "x").mapInArrow(run, out)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("vec").alias("vec_id"), "component", "n", F.col("deviation").cast("bigint").alias("deviation"), "whitened", "explained", "identity_error")
