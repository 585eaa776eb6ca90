"""Suffix-array deduplication by bucket-pointer refinement.

Which substrings of ``length`` bytes start at two places or more is read off the buckets of a suffix array sorted that
far. ``refined_places`` is the method in its plain form: every place of the corpus is a row, its initial bucket is that
of its q-gram, and a bucket is refined by sorting it on the bucket pointers at the later offset p+q; the new pointers
are used by the next, doubled, refinement. It shuffles some hundred bytes for every byte of text in each round (figures
in the README), so ``repeated_spans``, which the operator uses, keeps the corpus in runs and refines only what is open:

1. Initial buckets: a window of ``length`` bytes falls in the bucket of the least Q-gram identifier in it, which equal
   windows share. Neighbouring windows of one bucket are one run; runs are 1 to 2 percent as many as bytes. Buckets
   with one run are done: their windows occur once.
2. Runs of one bucket are refined by the bytes from the first to the last window. A run equal to another run is done:
   all its windows repeat.
3. Only runs left in shared buckets (where a repeat begins or ends, or a Q-gram is common) are refined further. A run
   falls into pieces of at most PIECE windows, cut at distances from the least Q-gram, so that equal windows lie in
   pieces that share their core: the bytes common to all windows such a piece can have. A core that occurs once has
   no repeats; pieces that share core and extent repeat as a whole.
4. The windows of the remaining pieces are told apart by core, place and the PIECE-1 bytes around the core.

Q-gram identifiers (64 bits, doubled from 1, 2, 4, ... bytes) only choose buckets, where a collision costs work and no
result. What is said to repeat is equal in 128 bits: BLAKE2b of the bytes of runs, pieces and cores, and two chained
64-bit hashes of core digest, place and the bytes around it for windows. At 1e14 places the chance that any two
different strings meet is below 1e-9. Every step counts with map-side combination; nothing is gathered by bucket, and
hot ones are spread before joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.common import batches_of, column, shape, table
from lotwise.operators.skew import HOT_SHARE, skew_join
from lotwise.session import discard, release_shuffles, written

LENGTH, Q, PIECE = 200, 32, 32
RUN = "doc_key bigint, text_key bigint, first int, last int, bucket bigint, tie boolean, extent bigint, extent2 bigint"
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def refined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """New bucket identifiers from those at p and at a later offset."""
    x = left * _A
    x ^= x >> np.uint64(32)
    x += right * _B
    x *= _C
    x ^= x >> np.uint64(29)
    return x


def identifiers(data: bytes, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each length (ascending) the identifiers of the substrings of that length at all places."""
    have, size = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1), 1
    out = []
    for want in lengths:
        while size * 2 <= want:
            have, size = refined(have[:-size], have[size:]), size * 2
        # two overlapping substrings of ``size`` bytes make one of ``want`` bytes
        out.append(have if size == want else refined(have[: len(have) - (want - size)], have[want - size :]))
    return out


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Least (or greatest) of every ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        x, size = pick(x[:-size], x[size:]), size * 2
    return x if size == width else pick(x[: len(x) - (width - size)], x[width - size :])


def digests(parts: Iterator[bytes]) -> np.ndarray:
    """Two 64-bit halves of the 128-bit digest of each part, as rows."""
    return np.frombuffer(b"".join([blake2b(p, digest_size=16).digest() for p in parts]), np.int64).reshape(-1, 2)


def runs_of(data: bytes, length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, ...]:
    """first, last, bucket, tie and extent (two halves) of a text's runs of windows. tie: the least Q-gram stands twice
    in the run's windows, so that windows of the run may equal one another."""
    if len(data) < length:
        return tuple(np.empty(0, t) for t in (np.int32, np.int32, np.int64, bool, np.int64, np.int64))
    (grams,) = identifiers(data, (q,))
    span = length - q + 1
    least = sliding(grams, span, np.minimum)
    cut = np.flatnonzero(least[1:] != least[:-1]) + 1
    first = np.concatenate(([0], cut))
    last = np.concatenate((cut, [len(least)])) - 1
    if (long := last - first >= span).any():  # a run is never longer than what its Q-gram's windows can be
        parts = [np.arange(a, b + 1, span) for a, b in zip(first[long], last[long], strict=True)]
        ends = [np.append(p[1:] - 1, b) for p, b in zip(parts, last[long], strict=True)]
        first, last = np.concatenate([first[~long], *parts]), np.concatenate([last[~long], *ends])
        order = np.argsort(first, kind="stable")
        first, last = first[order], last[order]
    bucket = least[first]
    # Places whose Q-gram is the least of a window: two of them near each other with the same Q-gram are a tie.
    pad = np.concatenate((np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)))
    place = np.flatnonzero(sliding(pad, span, np.maximum) == grams)
    order = np.argsort(grams[place], kind="stable")
    at, gram = place[order], grams[place][order]
    close = (gram[1:] == gram[:-1]) & (at[1:] - at[:-1] <= 2 * span)
    tie = np.isin(bucket, gram[1:][close])
    extent = digests(data[a:b] for a, b in zip(first.tolist(), (last + length).tolist(), strict=True))
    return first.astype(np.int32), last.astype(np.int32), bucket.view(np.int64), tie, extent[:, 0], extent[:, 1]


def _packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, doc_key, text_key, raw): the two keys name a row's content; rows that share both are copies, which
    get the same answer. raw is compressed, as it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            raw = [squeeze.compress((x.as_py() or "").encode()) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(raw, pa.binary())], names=["doc", "doc_key", "text_key", "raw"])

    return _keyed(docs, id_col, text_col).mapInArrow(run, shape(("doc", docs.schema[id_col].dataType), ("doc_key", "bigint"), ("text_key", "bigint"), ("raw", "binary")))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(column(text_col), F.lit(""))
    return docs.select(column(id_col).alias("doc"), F.xxhash64(F.lit("doc"), column(id_col)).alias("doc_key"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _runs(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, 64):
                cols: list[list[np.ndarray]] = [[] for _ in range(8)]
                for key, text_key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    own = runs_of(text.as_py().encode(), length)
                    for c, x in zip(cols, (np.full(len(own[0]), key, np.int64), np.full(len(own[0]), text_key, np.int64), *own), strict=True):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=[x.split()[0] for x in RUN.split(", ")])

    return _keyed(docs, id_col, text_col).select("doc_key", "text_key", "text").mapInArrow(run, RUN)


PIECES = "doc_key bigint, text_key bigint, first int, last int, core bigint, core2 bigint, extent bigint, extent2 bigint, lead int, edge binary"


def pieces_of(data: bytes, runs: list[tuple[int, int, int]], length: int = LENGTH, q: int = Q, most: int = PIECE) -> Iterator[tuple]:
    """(first, last, core, core2, extent, extent2, lead, edge) of the pieces of runs (first, last, bucket): the digests
    of the core and of the whole piece, how far the core begins behind ``first``, and the bytes of all windows before
    and after the core."""
    size = length - most + 1
    (grams,) = identifiers(data, (q,))
    found: list[tuple[int, int, int]] = []
    for first, last, bucket in runs:
        at = first + np.flatnonzero(grams[first : last + length - q + 1].view(np.int64) == bucket)
        starts = np.arange(first, last + 1)
        anchor = at[np.searchsorted(at, starts)]  # a window's leftmost Q-gram of the bucket
        place = anchor - (anchor - starts) // most * most
        cut = np.flatnonzero(place[1:] != place[:-1]) + 1
        found += [(first + a, first + b, int(place[a])) for a, b in zip([0, *cut.tolist()], [*(cut - 1).tolist(), last - first], strict=True)]
    cores = digests(data[c : c + size] for _, _, c in found).tolist()
    whole = digests(data[a : b + length] for a, b, _ in found).tolist()
    for (a, b, c), core, extent in zip(found, cores, whole, strict=True):
        yield a, b, *core, *extent, c - a, data[a:c] + data[c + size : b + length]


def _pieces(rows: DataFrame, length: int, most: int) -> DataFrame:
    """PIECES of the runs listed with each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        schema = pa.schema([(n, {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in PIECES.split(", "))])
        for whole in batches:
            for batch in batches_of(whole, 16):
                out = []
                for row in batch.to_pylist():
                    runs = sorted({(r["first"], r["last"], r["bucket"]) for r in row["runs"]})
                    out += [(row["doc_key"], row["text_key"], *x) for x in pieces_of(expand.decompress(row["raw"]), runs, length, most=most)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, PIECES)


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The packed documents, and (doc_key, text_key, first, last): ranges of starts of repeated windows."""
    docs_key = ["doc_key", "text_key"]
    runs = written(_runs(docs, id_col, text_col, length), "runs")
    # 1. Buckets with two runs or more, or with a tie.
    ends = [f(c).alias(n) for c in ("extent", "extent2") for f, n in ((F.min, f"{c}_lo"), (F.max, f"{c}_hi"))]
    one_extent = (F.col("extent_lo") == F.col("extent_hi")) & (F.col("extent2_lo") == F.col("extent2_hi"))
    buckets = runs.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("tie").alias("any_tie"), *ends)
    shared = written(buckets.filter("n > 1 or any_tie").select("bucket", "n", "any_tie", (one_extent & ~F.col("any_tie")).alias("one")), "buckets")
    total = shared.agg(F.sum("n")).first()[0] or 0
    hot = written(shared.filter(F.col("n") > max(50, total // HOT_SHARE)).select("bucket"), "hot")
    inside = written(skew_join(runs, shared.select("bucket", "any_tie", "one"), ["bucket"], hot=hot).select(*docs_key, "first", "last", "bucket", "extent", "extent2", "any_tie", "one"), "shared")
    discard(runs, shared)
    release_shuffles(docs.sparkSession)
    done = inside.filter("one").select(*docs_key, "first", "last")
    # 2. The rest by extent: equal runs are done, one of them stands for all in step 3. A tie or a run of its own
    #    in a bucket is open.
    mixed, extent = inside.filter("not one"), ["bucket", "extent", "extent2"]
    extents = written(mixed.groupBy(*extent).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*docs_key, "first")).alias("stand")), "extents")
    open_ = extents.groupBy("bucket").agg(F.min("n").alias("least"))
    hot_extents = extents.filter(F.col("n") > max(50, total // HOT_SHARE)).select(*extent)
    known = written(skew_join(mixed, extents, extent, hot=hot_extents), "known")
    equal = known.filter("n > 1").select(*docs_key, "first", "last")
    found = written(done.unionAll(equal), "found")
    release_shuffles(docs.sparkSession)
    stands = known.filter(F.col("stand") == F.struct(*docs_key, "first"))
    stands = skew_join(stands, open_, ["bucket"], hot=hot).filter((F.col("least") == 1) | F.col("any_tie"))
    # 3. Piece by piece.
    todo = stands.groupBy(*docs_key).agg(F.collect_list(F.struct("first", "last", "bucket")).alias("runs"))
    packed = _packed(docs, id_col, text_col)
    most = min(PIECE, length - Q)
    pieces = _pieces(packed.select(*docs_key, "raw").join(todo, docs_key).dropDuplicates(docs_key), length, most)
    pieces = written(pieces, "pieces")
    discard(inside, extents, known, hot)
    release_shuffles(docs.sparkSession)
    core = ["core", "core2"]
    cores = written(pieces.groupBy(*core).agg(F.count(F.lit(1)).alias("n"), *ends).filter("n > 1").select(*core, "n", one_extent.alias("one")), "cores")
    total = cores.agg(F.sum("n")).first()[0] or 0
    hot = cores.filter(F.col("n") > max(50, total // HOT_SHARE)).select(*core)
    shared_pieces = written(skew_join(pieces.drop("extent", "extent2"), cores.select(*core, "one"), core, hot=hot), "shared")
    discard(pieces, cores)
    whole = shared_pieces.filter("one").select(*docs_key, "first", "last")
    # 4. Window by window.
    windows = shared_pieces.filter("not one").withColumn("at", F.explode(F.sequence("first", "last")))
    around = F.substring("edge", F.col("at") - F.col("first") + 1, F.lit(most - 1))
    place = F.col("first") + F.col("lead") - F.col("at")
    key = ["window", "window2"]
    windows = windows.select(*docs_key, "at", F.xxhash64(*core, place, around).alias("window"), F.xxhash64(around, place, *reversed(core)).alias("window2"))
    again = written(windows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated")
    total = again.agg(F.sum("n")).first()[0] or 0
    hot = again.filter(F.col("n") > max(50, total // HOT_SHARE)).select(*key)
    single = skew_join(windows, again.select(*key), key, hot=hot).select(*docs_key, F.col("at").alias("first"), F.col("at").alias("last"))
    spans = written(found.unionAll(whole).unionAll(single), "spans")
    discard(found, shared_pieces, again)
    release_shuffles(docs.sparkSession)
    return packed, spans


def refined_places(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_key, text_key, at): the starts of all strings of ``length`` bytes that start at two places or more, by
    bucket-pointer refinement of every place: no hashes, but rows and shuffles for every byte. Rows that are equal in
    id and text count as one place more. A null text is empty."""
    docs_key = ["doc_key", "text_key"]
    place = [*docs_key, "at"]
    raw = _keyed(docs, id_col, text_col).groupBy(*docs_key).agg(F.encode(F.first("text"), "UTF-8").alias("raw"), F.count(F.lit(1)).alias("times"))
    ends = F.octet_length("raw") - length + 1
    size = max(s for s in (1, 2, 4, 8) if s <= length)
    first = raw.filter(F.octet_length("raw") >= size).select(*docs_key, "times", ends.alias("ends"), F.col("raw"), F.explode(F.sequence(F.lit(0), F.octet_length("raw") - size)).alias("at"))
    grams = first.select(*place, "times", "ends", F.substring("raw", F.col("at") + 1, F.lit(size)).alias("gram"))
    pointers = grams.groupBy("gram").agg(F.min(F.struct(*place)).alias("bucket"), F.sum("times").alias("n"))
    rows = written(grams.join(pointers, "gram").drop("gram"), "places")
    while size < length:
        step = min(size, length - size)  # the last later offset overlaps
        later = rows.select(*docs_key, (F.col("at") - step).alias("at"), F.col("bucket").alias("later"))
        pairs = rows.filter("n > 1").drop("n").join(later, place)
        pointers = pairs.groupBy("bucket", "later").agg(F.min(F.struct(*place)).alias("to"), F.sum("times").alias("n"))
        rows = written(pairs.join(pointers, ["bucket", "later"]).select(*place, "times", "ends", F.col("to").alias("bucket"), "n"), "places")
        size += step
    return rows.filter("n > 1 and at < ends").select(*place)


def cover(n: int, spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """The maximal byte ranges that windows starting in ``spans`` cover."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        a, b = first, min(n, last + length)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """(doc, n_bytes, n_removed, spans, kept) for every row: each byte that lies in a string of ``length`` bytes
    which starts anywhere else too, in the same or another row, is removed; kept has the rest, as bytes or, with
    ``as_text``, as text without what is left of characters that were cut.

    Nulls: a null text is empty; null ids stay; repeated rows are other places, so their long strings all go. Texts
    under ``length`` bytes never change. No rows: no rows. Other columns are not read.
    """
    packed, spans = repeated_spans(docs, length, id_col, text_col)
    docs_key = ["doc_key", "text_key"]
    of = spans.groupBy(*docs_key).agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        kinds = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for whole in batches:
            for batch in batches_of(whole, 64):
                size, gone, cuts, kept = [], [], [], []
                for raw, own in zip(batch.column("raw"), batch.column("spans"), strict=True):
                    data = expand.decompress(raw.as_py())
                    cut = cover(len(data), [(s["first"], s["last"]) for s in own.as_py() or ()], length)
                    edges = [0, *(x for c in cut for x in c), len(data)]
                    kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    size.append(len(data))
                    gone.append(len(data) - len(kept[-1]))
                    cuts.append([{"start": a, "stop": b} for a, b in cut])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(cuts, kinds), pa.array([k.decode(errors="ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())], names=["doc", "n_bytes", "n_removed", "spans", "kept"])

    joined = packed.join(of, docs_key, "left").select("doc", "raw", "spans")
    return joined.mapInArrow(run, shape(("doc", docs.schema[id_col].dataType), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("spans", "array<struct<start:int,stop:int>>"), ("kept", "string" if as_text else "binary")))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
