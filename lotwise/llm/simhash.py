"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a non-zero vector m(i) of radius+1 bits; table v (each of the 2^(radius+1)-1 non-zero
vectors) keys a fingerprint by the positions with <m(i), v> = 1. Positions where two fingerprints differ, at most
radius of them, span at most radius dimensions, so some v is orthogonal to all their m(i): in that table the two
collide. Every pair within the radius therefore meets; what else meets is compared and dropped.

Only distinct fingerprints are hashed, buckets of two are compared by Spark itself, larger ones in tasks of at most
BUCKET fingerprints, and still larger ones are first cut by a second family of masks and at last into pairs of
blocks, so that no bucket is capped and none is gathered whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.common import BATCH_ROWS, batches_of, column, shape, table, texts
from lotwise.operators.graph import connected_components
from lotwise.operators.skew import HOT_SHARE, skew_join
from lotwise.session import written

WORDS, RADIUS, SEED = 4, 4, 42
#: Most fingerprints of one bucket that a task compares at once.
BUCKET = 2048
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The hashes of a whole text's ``words``-word shingles in their order, repeats included."""
    parts = text.encode().translate(LOWER).split()
    if not parts:
        return np.zeros(0, "<u8")
    joined, ends = b" ".join(parts), np.cumsum([len(p) + 1 for p in parts]) - 1
    k = min(words, len(parts))
    stops = ends[k - 1 :].tolist()
    starts = [0, *(ends[: len(parts) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), "<u8", len(starts))


def folded(hashes: np.ndarray) -> int:
    """The SimHash of shingle hashes."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        total += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int = WORDS) -> int:
    """The SimHash of a whole text over its ``words``-word shingles, repeats included."""
    return folded(shingles(text, words))


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, fp bigint: the 64 bits as a signed number) for every row; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, BATCH_ROWS):
                fps = np.array([fingerprint(t, words) for t in texts(batch, "text")], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc", "fp"])

    return docs.select(column(id_col).alias("doc"), column(text_col).alias("text")).mapInArrow(run, shape(("doc", docs.schema[id_col].dataType), ("fp", "bigint")))


def masks(radius: int, family: int = 0, bits: int = 64) -> list[int]:
    """The masks of a covering family, as signed 64-bit numbers; ``family`` changes which position has which
    vector. Vectors are dealt evenly, so each mask has about half of the positions."""
    size = (1 << (radius + 1)) - 1
    order = np.random.default_rng(1000 + family).permutation(bits)
    m = np.empty(bits, np.int64)
    m[order] = 1 + np.arange(bits) % size
    out = []
    for v in range(1, size + 1):
        odd = [i for i in range(bits) if (int(m[i]) & v).bit_count() % 2]
        x = sum(1 << i for i in odd)
        out.append(x - (1 << bits) if x >> (bits - 1) else x)
    return out


def near(a: Column, b: Column, radius: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def keyed(fps: DataFrame, radius: int, family: int) -> DataFrame:
    """(key, fp): every fingerprint under each mask of the family, within the bucket ``key`` if there is one."""
    within = [F.col("key")] if "key" in fps.columns else []
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(x)), *within) for i, x in enumerate(masks(radius, family))]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def star_edges(radius: int):
    """Arrow task: each row has the fingerprints of a bucket (or of two blocks of one); edges from every
    fingerprint to the root of its component among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for row in batch.column("fps"):
                x = np.unique(np.asarray(row.values, np.int64).view(np.uint64))
                seen = np.zeros(len(x), bool)
                for i in range(len(x)):
                    if seen[i]:
                        continue
                    seen[i], front = True, [i]
                    while front:  # breadth first; every fingerprint is compared with the unseen ones once
                        j, left = front.pop(), np.flatnonzero(~seen)
                        if not len(left):
                            break
                        hit = left[np.bitwise_count(x[left] ^ x[j]) <= radius]
                        seen[hit] = True
                        front += hit.tolist()
                        src += [x[i]] * len(hit)
                        dst += x[hit].tolist()
            pairs = [np.array(c, np.uint64).view(np.int64) for c in (src, dst)]
            yield pa.RecordBatch.from_arrays([pa.array(p) for p in pairs], names=["src", "dst"])

    return run


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, families: int = 3) -> DataFrame:
    """(src, dst) over the distinct fingerprints ``fps``: edges with the same components as all pairs within
    the radius."""
    # Each fingerprint becomes as many rows as there are masks, so few input partitions are dealt out first.
    found, inside = [], fps.repartition("fp")
    for family in range(families):
        rows = keyed(inside, radius, family)
        sized = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"), "buckets")
        found.append(sized.filter((F.col("n") == 2) & near(F.col("a"), F.col("b"), radius)).select(F.col("a").alias("src"), F.col("b").alias("dst")))
        total = sized.agg(F.sum("n").alias("n"), F.max("n").alias("m")).first()
        if not total["n"] or total["m"] < 3:
            return _union(found)
        hot = sized.filter(F.col("n") > max(bucket, total["n"] // HOT_SHARE)).select("key")
        some = written(skew_join(rows, sized.filter("n > 2").select("key", "n"), ["key"], hot=hot), "members")
        gathered = some.filter(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("fps"))
        found.append(gathered.select("fps").mapInArrow(star_edges(radius), "src bigint, dst bigint"))
        if total["m"] <= bucket:
            return _union(found)
        inside = some.filter(F.col("n") > bucket)
    # What three families leave together is compared block by block: each fingerprint goes to every pair of
    # blocks that has its own.
    blocks = F.ceil(F.col("n") / (bucket // 2)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = inside.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = other.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list("fp").alias("fps"))
    found.append(paired.select("fps").mapInArrow(star_edges(radius), "src bigint, dst bigint"))
    return _union(found)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionAll(x)
    return out


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, fp, component) for every row: component is the smallest document id that is reachable over
    fingerprints at ``radius`` or fewer differing bits.

    Nulls: a null, empty or wordless text has fingerprint zero and links like any other; rows with a null id get
    their component too, which is null only if no document there has an id. Repeated rows each come back. No rows:
    no rows. Other columns are not read.
    """
    rows = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    parts = connected_components(links(distinct.select("fp"), radius))
    rooted = distinct.join(parts.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    of = written(skew_join(rooted.select("fp", "root", "n"), named, ["root"]), "components")
    total = of.agg(F.sum("n")).first()[0] or 0
    hot = of.filter(F.col("n") > max(50, total // HOT_SHARE)).select("fp")
    return skew_join(rows, of.select("fp", "component"), ["fp"], hot=hot).select("doc", "fp", "component")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select(F.col("doc").alias("doc_id"), text.alias("fingerprint"), F.col("component").alias("component_id"))
