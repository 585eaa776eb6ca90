"""Exact top-k inner products over norm-sorted blocks.

Vectors are laid out in blocks by descending length. The block of the longest vectors is searched first and gives
every query a threshold, its k-th best score so far. A task then goes through its blocks by descending length: a block
whose longest vector cannot reach a query's threshold, by Cauchy-Schwarz, is passed over; within a block, inner
products are summed in the order of a rotation by the second moment's eigenvectors (the SVD of all vectors), and a pair
is dropped as soon as its partial sum plus the product of the residual lengths falls below the threshold. What is left
is scored in integers, and every block that is searched tightens the thresholds of the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotwise.llm.common import batches_of, column, table
from lotwise.session import fresh_path, written

SCALE, K, EVERY = 256, 5, 50
BLOCK, QUERY_BLOCK = 4096, 1024
#: Queries are searched in rounds of this many bytes, which are broadcast; a round is a job over all blocks.
QUERY_BYTES = 64 << 20
#: Doubles hold whole numbers exactly below this, longs below the other.
EXACT, LONG = float(2**53), 2**63 - 1
BLOCK_ROW = "block bigint, longest double, ids binary, data binary"
FOUND = "q_at bigint, query_id bigint, vec_id bigint, at bigint, score bigint, exact string"
RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v array<double> of whole numbers, length): floor(scale * x) of every component. Vectors that are null or
    hold a null or non-finite component (after scaling, too), and rows without an id, are left out."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) != float("inf"))
    rows = vectors.select(column(id_col).cast("bigint").alias("id"), column(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            whole = np.floor(scale * v.flatten().to_numpy(zero_copy_only=False))
            edges = np.concatenate(([0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))))
            length = [norm(whole[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(whole)), pa.array(length, pa.float64())], names=["id", "v", "length"])

    return rows.mapInArrow(run, "id bigint, v array<double>, length double")


def norm(x: np.ndarray) -> float:
    """The length of a vector, also where its square is no double; at most the greatest double."""
    top = np.abs(x).max(initial=0.0)
    with np.errstate(over="ignore"):
        return min(float(top * np.linalg.norm(x / top)), np.finfo(float).max) if top else 0.0


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a batch as rows; shorter ones end in zeros."""
    out = np.zeros((len(lists), dims))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x.values.to_numpy()
    return out


def rotation(rows: DataFrame, dims: int) -> np.ndarray:
    """Eigenvectors of the second moment of all directions, largest first; dims x dims numbers reach the driver."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for whole in batches:
            for batch in batches_of(whole, BLOCK):
                x = matrix(batch.column("v"), dims) / np.maximum(batch.column("length").to_numpy(), 1.0)[:, None]
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    parts = rows.select("v", "length").mapInArrow(moments, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
    out = np.zeros((dims, dims))
    for r in parts.groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        out[r["i"], r["j"]] = r["x"]
    return np.linalg.eigh(out)[1][:, ::-1].copy()


def blocks_of(rows: DataFrame, dims: int, size: int, parts: int) -> DataFrame:
    """BLOCK_ROW: ranges of descending length, each in blocks of ``size``; equally long vectors are split by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n, held = TaskContext.get().partitionId() << 32, 0, []

        def block(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            ids, lengths, data = (np.concatenate(x) for x in zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([base + n]), pa.array([float(lengths.max())]), pa.array([ids.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], names=["block", "longest", "ids", "data"])

        for whole in batches:
            for batch in batches_of(whole, min(1024, size)):
                held.append((batch.column("id").to_numpy(), batch.column("length").to_numpy(), matrix(batch.column("v"), dims)))
                if sum(len(x[0]) for x in held) >= size:
                    yield block(held)
                    n, held = n + 1, []
        if held:
            yield block(held)

    spread = rows.repartitionByRange(parts, F.desc("length"), F.xxhash64("id"), F.monotonically_increasing_id())
    return spread.sortWithinPartitions(F.desc("length")).mapInArrow(run, BLOCK_ROW)


def places(block: int, n: int) -> np.ndarray:
    """A number for each of a block's rows that no other row has."""
    return block + (np.arange(n, dtype=np.int64) << 50)


class Block:
    """Candidates: ids, places, components, their rotation and the lengths of what is left after some of it."""

    def __init__(self, block: int, ids: bytes, data: bytes, rotate: np.ndarray):
        self.ids, self.v = np.frombuffer(ids, np.int64), np.frombuffer(data).reshape(-1, len(rotate))
        self.at, self.most = places(block, len(self.ids)), np.abs(self.v).max(initial=0.0)
        with np.errstate(over="ignore", invalid="ignore"):
            self.turned = self.v @ rotate
        self.rests: dict[int, np.ndarray] = {}

    def rest(self, done: int) -> np.ndarray:
        if done not in self.rests:
            with np.errstate(over="ignore", invalid="ignore"):
                self.rests[done] = np.nan_to_num(np.linalg.norm(self.turned[:, done:], axis=1), nan=np.inf)
        return self.rests[done]


class Queries(Block):
    """A block of queries with the k best of each so far: (score, -id, -place), and the score to reach."""

    def __init__(self, ids: bytes, at: bytes, data: bytes, rotate: np.ndarray, k: int, least: np.ndarray | None = None):
        super().__init__(0, ids, data, rotate)
        self.at, self.k = np.frombuffer(at, np.int64), k
        self.best: list[list[tuple[int, int, int]]] = [[] for _ in self.ids]
        self.least = np.full(len(self.ids), -np.inf) if least is None else least.copy()

    def search(self, c: Block, steps: tuple[int, ...]) -> None:
        """Every query's k best of what was found and this block."""
        size = self.most * c.most
        with np.errstate(over="ignore", invalid="ignore"):
            sums = float(size) * self.v.shape[1]
            left = np.ones((len(self.ids), len(c.ids)), bool)
            if np.isfinite(sums):
                partial, done, slack = np.zeros(left.shape), 0, 1e-9 * sums + 1e-6
                for upto in steps:
                    partial += self.turned[:, done:upto] @ c.turned[:, done:upto].T
                    done = upto
                    left &= partial + np.outer(self.rest(done), c.rest(done)) + slack >= self.least[:, None]
                    if left.mean() < 0.05:
                        break
        scores = self.v @ c.v.T if sums < EXACT and left.mean() >= 0.1 else None
        for i in range(len(self.ids)):
            j = np.flatnonzero(left[i] & (c.at != self.at[i]))
            if not len(j):
                continue
            if sums < EXACT:
                s = scores[i, j] if scores is not None else c.v[j] @ self.v[i]
                if len(j) > 4 * self.k:  # only the k-th best and its equals may count
                    keep = s >= np.partition(s, len(s) - self.k)[len(s) - self.k]
                    j, s = j[keep], s[keep]
                found = [(int(x), -int(c.ids[y]), -int(c.at[y])) for x, y in zip(s, j, strict=True)]
            else:  # beyond doubles: Python's integers
                own = [int(x) for x in self.v[i]]
                found = [(sum(a * int(b) for a, b in zip(own, c.v[y], strict=True)), -int(c.ids[y]), -int(c.at[y])) for y in j]
            self.best[i] = sorted([*self.best[i], *found], reverse=True)[: self.k]
            if len(self.best[i]) == self.k:
                self.least[i] = max(self.least[i], clipped(self.best[i][-1][0]))


def clipped(score: int) -> float:
    """A double that is not above the score."""
    return float(np.nextafter(float(min(score, 10**308)), -np.inf)) if score > -(10**308) else -np.inf


def query_blocks(blocks: DataFrame, head: Block, rotate: np.ndarray, k: int, every: int, size: int, steps: tuple[int, ...]) -> DataFrame:
    """The vectors whose id is divisible by ``every``, in blocks, with the k-th best score of each in the block of the
    longest vectors and the length a candidate must have to reach it: (q_block, q_ids, q_at, q_data, q_least, q_reach)."""
    dims = len(rotate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n, held = TaskContext.get().partitionId() << 32, 0, []

        def block() -> pa.RecordBatch:
            ids, at, data = (np.concatenate(x) for x in zip(*held, strict=True))
            raw = (ids.tobytes(), at.tobytes(), data.tobytes())
            own = Queries(*raw, rotate, k)
            own.search(head, steps)
            reach = reach_of(own.least, own.rest(0))
            return pa.RecordBatch.from_arrays([pa.array([base + n]), *(pa.array([x], pa.binary()) for x in (*raw, own.least.tobytes())), pa.array([reach])], names=["q_block", "q_ids", "q_at", "q_data", "q_least", "q_reach"])

        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                i = np.flatnonzero(ids % every == 0)
                for at in range(0, len(i), size):
                    some = i[at : at + size]
                    held.append((ids[some], places(row["block"], len(ids))[some], np.frombuffer(row["data"]).reshape(-1, dims)[some]))
                    if sum(len(x[0]) for x in held) >= size:
                        yield block()
                        n, held = n + 1, []
        if held:
            yield block()

    return blocks.select("block", "ids", "data").mapInArrow(run, "q_block bigint, q_ids binary, q_at binary, q_data binary, q_least binary, q_reach double")


def reach_of(least: np.ndarray, length: np.ndarray) -> float:
    """How long a candidate must be to reach any of the thresholds (negative: any length does)."""
    with np.errstate(over="ignore"):
        return float(np.min(np.where(least <= 0, -1.0, least / np.maximum(length, 1e-9)), initial=np.inf) * (1 - 1e-9))


def search(rotate: np.ndarray, k: int, steps: tuple[int, ...]):
    """Arrow task over (candidate block, query block) pairs, candidates by descending length: FOUND rows, the k best of
    each query among the task's blocks. It holds one candidate block and the round's queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, Queries] = {}
        now: tuple[int, Block] | None = None
        for whole in batches:
            for batch in batches_of(whole, 1):
                row = batch.to_pylist()[0]
                q = asked.get(row["q_block"])
                if q is None:
                    q = asked[row["q_block"]] = Queries(row["q_ids"], row["q_at"], row["q_data"], rotate, k, np.frombuffer(row["q_least"]))
                if row["longest"] * (1 + 1e-9) < reach_of(q.least, q.rest(0)):
                    continue
                if now is None or now[0] != row["block"]:
                    now = (row["block"], Block(row["block"], row["ids"], row["data"], rotate))
                q.search(now[1], steps)
        for q in asked.values():
            rows = [(int(q.at[i]), int(q.ids[i]), -c, -at, max(-LONG - 1, min(LONG, s)), str(s) if abs(s) > LONG else None) for i, best in enumerate(q.best) for s, c, at in best]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 6, [*[pa.int64()] * 5, pa.string()], strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

    return run


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of every vector whose id is divisible by
    ``every`` with all other rows (all, if they are fewer), ties to the smaller id.

    Left out: null vectors, those with null or non-finite components, and rows with a null id. Vectors of different
    lengths are filled up with zeros. Rows that repeat an id are rows of their own: each is a query, and a candidate
    for the others. Scores are exact for components of any size; one beyond 64 bits ranks by its exact value and is
    returned as the nearest long. No vectors: no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = written(quantized(vectors, id_col, vector_col, scale), "vectors")
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    if not shape["n"]:
        return spark.createDataFrame([], RESULT)
    dims = max(1, shape["dims"])
    rotate = rotation(rows, dims)
    steps = tuple(sorted({max(1, dims // 8), max(1, dims // 2)}))
    blocks = written(blocks_of(rows, dims, BLOCK, max(4, -(-shape["n"] // (2 * BLOCK)))), "blocks")
    first = blocks.orderBy(F.desc("longest"), "block").limit(1).first()  # one block reaches the driver
    head = Block(first["block"], bytes(first["ids"]), bytes(first["data"]), rotate)
    asked = written(query_blocks(blocks, head, rotate, k, every, QUERY_BLOCK, steps), "queries")
    path = fresh_path(spark, "found")
    for at, (low, high) in enumerate(rounds(asked)):
        own = asked.filter(F.col("q_block").between(low, high))  # QUERY_BYTES, or one block
        pairs = blocks.join(F.broadcast(own), F.col("longest") * (1 + 1e-9) >= F.col("q_reach"))
        pairs.select("block", "longest", "ids", "data", "q_block", "q_ids", "q_at", "q_data", "q_least").mapInArrow(search(rotate, k, steps), FOUND).write.parquet(f"{path}/round={at}")
    found = spark.read.schema(f"{FOUND}, round int").parquet(path) if not asked.isEmpty() else spark.createDataFrame([], FOUND)
    order = Window.partitionBy("q_at").orderBy(F.desc("score"), F.desc(_beyond("exact")), "vec_id", "at")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _beyond(exact: str) -> Column:
    """Orders scores that were cut to a long, among those that were not, by sign, number of digits and digits."""
    digits = F.regexp_replace(exact, "^-", "")
    size = F.lpad(F.length(digits).cast("string"), 6, "0")
    up = F.concat(F.lit("1"), size, digits)
    down = F.concat(F.lit("0"), F.lpad((F.lit(999999) - F.length(digits)).cast("string"), 6, "0"), F.translate(digits, "0123456789", "9876543210"))
    return F.when(F.col(exact).isNull(), "0~").when(F.col(exact).startswith("-"), down).otherwise(up)


def rounds(asked: DataFrame) -> Iterator[tuple[int, int]]:
    """Ranges of query blocks of at most QUERY_BYTES."""
    low = high = None
    size = 0
    for r in asked.select("q_block", (F.octet_length("q_data") + 4 * F.octet_length("q_ids")).alias("bytes")).orderBy("q_block").toLocalIterator():
        if low is not None and size + r["bytes"] > QUERY_BYTES:
            yield low, high
            low, size = None, 0
        low, high, size = (r["q_block"] if low is None else low), r["q_block"], size + r["bytes"]
    if low is not None:
        yield low, high


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))
