"""Near-duplicate texts by shingle similarity: candidates from SimHash and from minima of shingle hashes, each checked
exactly.

Two texts are near when their sets of 5-word shingles have a Jaccard similarity of 0.8 or more. 64 SimHash bits of such
a pair differ in about ten places, more than covering masks reach, so the fingerprints (within simhash.RADIUS) are
joined by BANDS keys of ROWS minima each: a pair of similarity 0.8 shares none of them with probability
(1 - 0.8^ROWS)^BANDS, about one in 100,000. What candidates tie together is a proposal only: the texts of a proposed
group are compared by their whole shingle sets, and only near ones are linked.

Groups of up to BLOCK distinct texts are compared in a task each. In larger ones every text is first compared with one
head, spread over tasks; texts that are not near the head are then compared with all texts of the group, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import simhash
from lotwise.llm.common import BATCH_ROWS, batches_of, column, shape, texts
from lotwise.operators.graph import connected_components
from lotwise.operators.skew import hot_keys, skew_join
from lotwise.session import written

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 3
#: Most distinct texts of a group that one task compares.
BLOCK = 256
_RNG = np.random.default_rng(2024)
FLIP = _RNG.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64)
TIMES = _RNG.integers(0, 2**63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def bands(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys, each of ROWS minima of the shingle hashes under hash functions of its own."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[None, at : at + 2048] ^ FLIP) * TIMES).min(axis=1))
    least, key = least.reshape(BANDS, ROWS), np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = (key ^ least[:, i]) * MIX
        key ^= key >> np.uint64(29)
    return key


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, h: the text's hash, fp, bands) for every row; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, BATCH_ROWS):
                fps, keys = np.zeros(batch.num_rows, np.uint64), np.zeros((batch.num_rows, BANDS), np.uint64)
                for i, t in enumerate(texts(batch, "text")):
                    own = simhash.shingles(t, WORDS)
                    fps[i], keys[i] = simhash.folded(own), bands(own)
                flat = pa.array(keys.view(np.int64).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * (batch.num_rows + 1), BANDS, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps.view(np.int64)), lists], names=["doc", "h", "fp", "bands"])

    text = F.coalesce(column(text_col), F.lit(""))
    return docs.select(column(id_col).alias("doc"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(run, shape(("doc", docs.schema[id_col].dataType), ("h", "bigint"), ("fp", "bigint"), ("bands", "array<bigint>")))


def shingle_sets(rows: DataFrame) -> DataFrame:
    """(root, n, h, own: the sorted distinct shingle hashes as bytes) from (root, n, h, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, BATCH_ROWS):
                own = pa.array([np.unique(simhash.shingles(t, WORDS)).tobytes() for t in texts(batch, "text")], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], own], names=["root", "n", "h", "own"])

    return rows.select("root", "n", "h", "text").mapInArrow(run, "root bigint, n bigint, h bigint, own binary")


def enough(common: np.ndarray, sizes: np.ndarray, size: int, similarity: float) -> np.ndarray:
    """Whether sets of ``sizes`` that have ``common`` members with one of ``size`` are near it; empty sets are equal."""
    return common >= similarity * (sizes + size - common) - 1e-9


def near_edges(similarity: float):
    """Arrow task: each row has the texts of a group (or of two blocks of one); edges with the same components as all
    near pairs among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for row in batch.column("members"):
                members = {x["h"]: x["own"] for x in row.as_py()}
                ids, sets = list(members), [np.frombuffer(x, "<u8") for x in members.values()]
                left = list(range(len(ids)))
                while left:
                    front, left = [left[0]], left[1:]
                    while front and left:  # breadth first; every text is compared with the unseen ones once
                        j = front.pop()
                        sizes = np.array([len(sets[i]) for i in left])
                        stops = np.cumsum(sizes)
                        flat = np.concatenate([sets[i] for i in left])
                        at = np.searchsorted(sets[j], flat)
                        inside = np.zeros(len(flat) + 1, np.int64)
                        if len(sets[j]):
                            inside[1:] = np.cumsum(sets[j][np.minimum(at, len(sets[j]) - 1)] == flat)
                        hit = enough(inside[stops] - inside[stops - sizes], sizes, len(sets[j]), similarity)
                        near = [i for i, y in zip(left, hit, strict=True) if y]
                        left = [i for i, y in zip(left, hit, strict=True) if not y]
                        front += near
                        src += [ids[j]] * len(near)
                        dst += [ids[i] for i in near]
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return run


def head_edges(similarity: float):
    """Arrow task: (root, n, h, head, near) of rows that have a text's set and its head's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for a, b in zip(batch.column("own"), batch.column("head_own"), strict=True):
                a, b = (np.frombuffer(x.as_py(), "<u8") for x in (a, b))
                common = len(np.intersect1d(a, b, assume_unique=True))
                near.append(bool(enough(np.array(common), np.array(len(a)), len(b), similarity)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(near, pa.bool_())], names=["root", "n", "h", "head", "near"])

    return run


def near_links(sets: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(src, dst): edges with the same components as all near pairs within each root of ``sets`` (root, n: texts of
    that root, h, own)."""
    spark, edge = sets.sparkSession, "src bigint, dst bigint"
    members = F.collect_list(F.struct("h", "own")).alias("members")
    found = sets.filter(F.col("n") <= block).groupBy("root").agg(members).select("members").mapInArrow(near_edges(similarity), edge)
    large = sets.filter(F.col("n") > block)
    roots = large.select("root", "n").distinct()
    if roots.isEmpty():
        return found
    heads = large.groupBy("root").agg(F.min(F.struct("h", "own")).alias("x")).select("root", F.col("x.h").alias("head"), F.col("x.own").alias("head_own"))
    tried = written(skew_join(large, heads, ["root"], hot=roots).select("root", "n", "h", "head", "own", "head_own").mapInArrow(head_edges(similarity), "root bigint, n bigint, h bigint, head bigint, near boolean"), "heads")
    found = found.unionAll(tried.filter("near").select(F.col("head").alias("src"), F.col("h").alias("dst")))
    rest = tried.filter("not near").select("root", "h")
    counts = written(rest.groupBy("root").agg(F.count(F.lit(1)).alias("r")), "rest")
    if counts.isEmpty():
        return found
    all_ = skew_join(large, counts, ["root"], hot=roots.join(counts, "root", "left_semi"))
    i_of, j_of = (F.ceil(F.col(c) / (block // 2)).cast("int") for c in ("r", "n"))
    deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "h"), n).cast("int")
    ours = all_.join(rest.select("h"), "h", "left_semi").select("root", deal(1, i_of).alias("i"), F.explode(F.sequence(F.lit(0), j_of - 1)).alias("j"), "h", "own")
    theirs = all_.select("root", F.explode(F.sequence(F.lit(0), i_of - 1)).alias("i"), deal(2, j_of).alias("j"), "h", "own")
    return found.unionAll(ours.unionAll(theirs).groupBy("root", "i", "j").agg(members).select("members").mapInArrow(near_edges(similarity), edge))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc, h): the least id of each group of texts that near pairs tie together, and its text's hash (xxhash64).

    Nulls: a null text is empty, and texts without words are near each other only; a null id is the least. No rows:
    no rows. Other columns are not read.
    """
    rows = written(sketches(docs, id_col, text_col), "sketches")
    nodes = written(rows.groupBy("h").agg(F.min("doc").alias("doc"), F.min("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    keyed = nodes.select(F.explode("bands").alias("key"), "fp").distinct()
    shared = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("least")).filter("n > 1"), "bands")
    hot = hot_keys(shared, ["key"], "n", shared.agg(F.sum("n")).first()[0] or 0)
    banded = skew_join(keyed, shared.select("key", "least"), ["key"], hot=hot).select(F.col("least").alias("src"), F.col("fp").alias("dst"))
    proposed = connected_components(simhash.links(nodes.select("fp").distinct()).unionAll(banded.filter("src <> dst")))
    rooted = written(nodes.select("h", "doc", "fp").join(proposed.select(F.col("node").alias("fp"), "root"), "fp", "left").select("h", "doc", F.coalesce("root", "fp").alias("root")), "rooted")
    sizes = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    checked = written(skew_join(rooted, sizes, ["root"]).select("root", "n", "h", "doc"), "checked")
    text = F.coalesce(column(text_col), F.lit(""))
    own = docs.select(column(id_col).alias("id"), F.xxhash64(text).alias("__h"), text.alias("text"))
    same = own["id"].eqNullSafe(checked["doc"]) & (own["__h"] == checked["h"])
    sets = written(shingle_sets(own.join(checked, same).select("root", "n", "h", "text")).dropDuplicates(["h"]), "sets")
    linked = connected_components(near_links(sets, similarity, block))
    named = rooted.select("h", "doc").join(linked.select(F.col("node").alias("h"), F.col("root").alias("group")), "h", "left")
    first = named.groupBy(F.coalesce("group", "h").alias("group")).agg(F.min(F.struct("doc", "h")).alias("x"))
    return first.select("x.doc", "x.h")

