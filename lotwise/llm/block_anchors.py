"""Substring dedup over words by fixed-block anchors.

Every document is cut into reference blocks of BLOCK words that don't overlap, and the blocks are indexed. Every
rolling window of BLOCK words probes the index: a place is a hit if its words are a block anywhere and stand at two
places or more. A string of ``window`` words that stands twice holds a whole block of either document, as two blocks
less one word are no longer than it, so that both places have the same hits, at least one of them in the first words.

Hits are extended to maximal exact repeats. A window is anchored at the least hit among its first words; neighbouring
windows with one anchor form a run, whose extent is its hit extended to both sides as far as its windows reach. Equal
windows have equal anchors, therefore:

1. A run whose extent stands elsewhere too repeats as a whole, which settles nearly all copies at once.
2. Of the other runs only those matter whose anchor has another extent anywhere (the edges of a repeat). Their windows
   are compared one by one, by digests, with those of all extents of the same anchor, each once a chunk.

What is repeated is then the union of windows, whose maximal ranges are the maximal repeats. All four questions (hits,
extents, anchors, windows) go through ``shared_keys``. 44-bit hashes choose hits and anchors only, where a collision
costs work and no result; what is said to repeat is equal in 126 bits of BLAKE2b.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from lotwise.llm.common import column, shape, table
from lotwise.llm.shared_keys import BITS, MANY, WANTED, answers, dealt, distinct, merged, parts_for
from lotwise.session import discard, written

WINDOW, BLOCK = 35, 18
#: Bytes of words in a chunk; a longer document is a chunk of its own. Bytes that are hashed at once.
CHUNK_BYTES, PIECE_BYTES = 4 << 20, 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept between calls."""
    have = _POWERS.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate((have, have * np.uint64(pow(base, len(have), 1 << 64))))
    _POWERS[base] = have if len(have) <= 4 * PIECE_BYTES else have[: 4 * PIECE_BYTES]
    return have[:n]


class Words:
    """The words of a chunk: documents in a row, words parted by a space and documents by a line feed."""

    def __init__(self, raw: bytes):
        self.raw = raw
        data = np.frombuffer(raw, np.uint8)
        gap = (data == 32) | (data == 10)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.doc = np.searchsorted(np.flatnonzero(data == 10), self.starts)
        self.n = len(self.starts)
        first = np.searchsorted(self.doc, self.doc)  # the first word of each word's document
        self.place = np.arange(self.n) - first

    def whole(self, width: int) -> np.ndarray:
        """Whether the ``width`` words from each word on are in its document."""
        out = np.zeros(self.n, bool)
        if self.n >= width:
            out[: self.n - width + 1] = self.doc[: self.n - width + 1] == self.doc[width - 1 :]
        return out

    def hashes(self, width: int) -> np.ndarray:
        """A hash of BITS bits for the ``width`` words from each word on, as far as there are so many."""
        out = np.zeros(max(0, self.n - width + 1), np.uint64)
        a = 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(self.starts, self.starts[a] + PIECE_BYTES)))
            b = min(b, len(out))
            low, high = int(self.starts[a]), int(self.ends[b + width - 2])
            data = np.frombuffer(self.raw, np.uint8)[low:high].astype(np.uint64) + np.uint64(1)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(data * powers(_BASE, high - low), out=sums[1:])
            s, e = self.starts[a:b] - low, self.ends[a + width - 1 : b + width - 1] - low
            x = (sums[e] - sums[s]) * powers(_BACK, high - low)[s]
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0x94D049BB133111EB)
            out[a:b] = x >> np.uint64(64 - BITS)
            a = b
        return out

    def digests(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """128 bits of the words from ``first`` to ``last``, as two unsigned words a row."""
        raw = self.raw
        spans = zip(self.starts[first].tolist(), self.ends[last].tolist(), strict=True)
        return np.frombuffer(b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in spans]), np.uint64).reshape(-1, 2)


def probes(words: Words, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The places that have ``block`` words, and their distinct hashes with codes and which of them each place has."""
    at = np.flatnonzero(words.whole(block))
    hashes = words.hashes(block)[at]
    keys, times, which = distinct(hashes[:, None])
    codes = np.where(times > 1, MANY, 0)
    codes[which[words.place[at] % block == 0]] |= WANTED
    return at, keys, codes, which


def runs_of(words: Words, at: np.ndarray, hashes: np.ndarray, window: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first, last and anchor hash of the runs of windows over hits at ``at``, which ascend."""
    none = np.uint64(1 << 63)
    reach = window - block + 1
    n = max(0, words.n - window + 1)
    least = np.full(n + reach - 1, none)
    inside = at < len(least)
    least[at[inside]] = hashes[inside]
    who = np.arange(len(least))
    size = 1
    while size < reach:  # least of each ``reach`` neighbours, the first of equal ones, by doubling
        step = min(size, reach - size)
        left = least[:-step] <= least[step:]
        least, who = np.where(left, least[:-step], least[step:]), np.where(left, who[:-step], who[step:])
        size += step
    some = np.flatnonzero((least[:n] < none) & words.whole(window)[:n])
    if not len(some):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    new = np.flatnonzero((np.diff(some) != 1) | (np.diff(who[some]) != 0)) + 1
    first = some[np.concatenate(([0], new))]
    return first, some[np.append(new - 1, len(some) - 1)], least[first]


def chunks_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(chunk, docs, n, words): documents by chunks, in order; n counts words, which are compressed."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        number = TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        own: list[bytes] = []
        size = n = 0

        def out() -> pa.RecordBatch:
            nonlocal ids, own, size, n, number
            flat = pa.concat_arrays(ids)
            columns = [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), pa.array([n], pa.int64()), pa.array([squeeze.compress(b"\n".join(own))], pa.binary())]
            ids, own, size, n, number = [], [], 0, 0, number + 1
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "docs", "n", "words"])

        for batch in batches:
            done = 0
            for i, x in enumerate(batch.column(1)):
                words = (x.as_py() or "").encode().split()
                n += len(words)
                own.append(b" ".join(words))
                size += len(own[-1]) + 1
                if size >= CHUNK_BYTES:
                    ids.append(batch.column(0).slice(done, i + 1 - done))
                    done = i + 1
                    yield out()
            if done < batch.num_rows:
                ids.append(batch.column(0).slice(done))
        if own:
            yield out()

    return docs.select(column(id_col).alias("doc"), column(text_col).alias("text")).mapInArrow(run, shape(("chunk", "bigint"), ("docs", ArrayType(kind)), ("n", "bigint"), ("words", "binary")))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows one by one, with their words laid out."""
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names if name != "docs"}
            if row.get("words") is not None:
                row["words"] = Words(expand.decompress(row["words"]))
            yield row


def _batch(rows: Iterator[tuple], *fields: tuple[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    for row in rows:
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, (_, kind) in zip(row, fields, strict=True)], names=[n for n, _ in fields])


def _dealing(parts: int, keys_of):
    """A function of mapInArrow that deals the keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            if out := list(dealt(row["chunk"], *keys_of(row), parts)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["part", "chunk", "keys"])

    return run


def _array(data: bytes, kind=np.int64) -> np.ndarray:
    return np.frombuffer(data, kind)


def _extents(row: dict) -> tuple[np.ndarray, np.ndarray]:
    keys, times, _ = distinct(_array(row["extent"], np.uint64).reshape(-1, 2))
    return keys, np.where(times > 1, MANY, 0) | WANTED


def _anchors(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors; one is wanted where it has an open extent, and many if it has several extents."""
    bucket, is_open = _array(row["bucket"], np.uint64), _array(row["state"], np.uint8)
    keys, _, which = distinct(bucket[:, None])
    extents = np.bincount(which[is_open < 2], minlength=len(keys))
    codes = np.where(extents > 1, MANY, 0)
    codes[which[is_open == 1]] |= WANTED
    return keys, codes, which


def repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The chunks, and (chunk, first, last, at, known, answers): ranges of starts of repeated windows, and single
    starts ``at`` of windows ``known``, which repeat where the answers say so."""
    block = (window + 1) // 2
    chunks = written(chunks_of(docs, id_col, text_col), "chunks")
    n = chunks.agg(F.sum("n")).first()[0] or 0
    parts = parts_for(n)
    texts = chunks.select("chunk", "words")

    hits = answers(texts, _dealing(parts, lambda row: probes(row["words"], block)[1:3]), 1)

    def to_runs(batches):
        def rows():
            for row in _rows(batches):
                words = row["words"]
                at, keys, _, which = probes(words, block)
                hit = merged(row["answers"])[which]
                first, last, bucket = runs_of(words, at[hit], keys[which[hit], 0], window, block)
                if len(first):
                    yield row["chunk"], first.tobytes(), last.tobytes(), bucket.tobytes(), words.digests(first, last + window - 1).tobytes()

        return _batch(rows(), ("chunk", pa.int64()), *((c, pa.binary()) for c in ("first", "last", "bucket", "extent")))

    runs = written(texts.join(hits, "chunk").mapInArrow(to_runs, "chunk bigint, first binary, last binary, bucket binary, extent binary"), "runs")
    total = runs.agg(F.sum(F.octet_length("first"))).first()[0] or 0
    parts = parts_for(total // 8)
    same = answers(runs.select("chunk", "extent"), _dealing(parts, _extents), 2)

    def to_states(batches):
        def rows():
            for row in _rows(batches):
                keys, _, which = distinct(_array(row["extent"], np.uint64).reshape(-1, 2))
                state = np.where(merged(row["answers"]), 0, 1).astype(np.uint8)[which]
                again = np.ones(len(which), bool)
                again[np.unique(which, return_index=True)[1]] = False
                state[again] = 2  # its extent is settled by another run of the chunk
                yield row["chunk"], row["first"], row["last"], row["bucket"], state.tobytes()

        return _batch(rows(), ("chunk", pa.int64()), *((c, pa.binary()) for c in ("first", "last", "bucket", "state")))

    states = written(runs.join(same, "chunk").mapInArrow(to_states, "chunk bigint, first binary, last binary, bucket binary, state binary"), "states")
    discard(runs)
    contested = answers(states.select("chunk", "bucket", "state"), _dealing(parts, lambda row: _anchors(row)[:2]), 1)

    def to_windows(batches):
        def rows():
            for row in _rows(batches):
                first, last, state = _array(row["first"]), _array(row["last"]), _array(row["state"], np.uint8)
                mine = merged(row["answers"])[_anchors(row)[2]] & (state < 2)
                a, size = first[mine], last[mine] - first[mine] + 1
                at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
                closed = state != 1
                yield row["chunk"], first[closed].tobytes(), last[closed].tobytes(), at.tobytes(), row["words"].digests(at, at + window - 1).tobytes()

        return _batch(rows(), ("chunk", pa.int64()), *((c, pa.binary()) for c in ("first", "last", "at", "known")))

    windows = written(texts.join(states, "chunk").join(contested, "chunk").mapInArrow(to_windows, "chunk bigint, first binary, last binary, at binary, known binary"), "windows")
    discard(states)
    total = windows.agg(F.sum(F.octet_length("at"))).first()[0] or 0
    known = windows.select("chunk", F.col("known").alias("extent"))
    return chunks, windows.join(answers(known, _dealing(parts_for(total // 8), _extents), 2), "chunk", "left")


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_words, n_removed, spans, kept) for every row: each word that lies in a string of ``window`` words which
    starts anywhere else too, in the same or another row, is removed. spans has the maximal ranges of removed words,
    kept the other words with a space between them.

    Words are runs of other characters than ASCII white space, unchanged. Nulls: a null text has no words; null ids
    stay; repeated rows are other places, so their long strings all go. Texts under ``window`` words never change. No
    rows: no rows. Other columns are not read.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    chunks, found = repeats(docs, window, id_col, text_col)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("first", "last", "at", "known", "answers")}
                raw = expand.decompress(batch.column("words")[i].as_py())
                texts = raw.split(b"\n")
                n, cuts, kept = [], [], []
                if row["first"] is None:
                    n, cuts, kept = [len(t.split()) for t in texts], [[]] * len(texts), texts
                else:
                    words = Words(raw)
                    at = _array(row["at"])
                    if len(at):
                        at = at[merged(row["answers"])[distinct(_array(row["known"], np.uint64).reshape(-1, 2))[2]]]
                    edge = np.zeros(words.n + window + 1, np.int64)
                    for a, b in ((_array(row["first"]), _array(row["last"])), (at, at)):
                        np.add.at(edge, a, 1)
                        np.add.at(edge, b + window, -1)
                    gone = np.cumsum(edge)[: words.n] > 0
                    bounds = np.searchsorted(words.doc, np.arange(len(texts) + 1))
                    for t, a, b in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                        own = gone[a:b]
                        n.append(b - a)
                        if not own.any():
                            cuts.append([])
                            kept.append(t)
                            continue
                        sides = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).view(np.int8)))
                        cuts.append([{"start": x, "stop": y} for x, y in sides.reshape(-1, 2).tolist()])
                        split, around = t.split(b" "), [0, *sides.tolist(), b - a]
                        kept.append(b" ".join([w for x, y in zip(around[::2], around[1::2], strict=True) for w in split[x:y]]))
                docs_ = batch.column("docs").slice(i, 1).flatten()
                lost = [sum(c["stop"] - c["start"] for c in own) for own in cuts]
                for a in range(0, len(texts), 256):
                    part = slice(a, a + 256)
                    yield pa.RecordBatch.from_arrays([docs_.slice(a, 256), pa.array(n[part], pa.int64()), pa.array(lost[part], pa.int64()), pa.array(cuts[part], spans), pa.array([k.decode() for k in kept[part]], pa.string())], names=["doc", "n_words", "n_removed", "spans", "kept"])

    joined = chunks.select("chunk", "docs", "words").join(found, "chunk", "left")
    return joined.mapInArrow(run, shape(("doc", docs.schema[id_col].dataType), ("n_words", "bigint"), ("n_removed", "bigint"), ("spans", "array<struct<start:bigint,stop:bigint>>"), ("kept", "string")))


def op12_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("spans").cast("bigint").alias("n_spans"))
