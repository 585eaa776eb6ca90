"""Which keys of a chunk stand anywhere else: an exchange of packed keys.

A chunk is a row that stands for many texts. It deals its distinct keys, sorted and packed, over parts of the key
space: one row for each chunk and part. A part counts its keys over all chunks and answers each chunk with one bit a
key, in the chunk's own order. A key that stands in very many texts is one entry a chunk, so no key makes a part large.
Parts are as many as the keys ask for; at 100 TB both chunks and parts want to be larger (CHUNK_BYTES, PART_KEYS), as
there is a row for each pair.

A key has a code besides: WANTED if it may be answered with yes, MANY if it stands twice or more in its chunk. It is
answered with yes if some chunk wants it and it stands at two places or more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WANTED, MANY = 1, 2
#: Keys for one part; a part is sorted in one task.
PART_KEYS = 2_000_000
#: One-word keys have so many bits, so that what lies between two sorted ones fits in 30.
BITS = 44
_CODES = np.uint64(3)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys (rows of one or two unsigned words), how often each stands, and which of them each key is."""
    order = np.lexsort(keys.T[::-1]) if keys.shape[1] > 1 else np.argsort(keys[:, 0])
    rows = keys[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    inverse = np.empty(len(rows), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return rows[new], np.diff(np.append(np.flatnonzero(new), len(rows))), inverse


def packed(keys: np.ndarray, codes: np.ndarray) -> bytes:
    """Sorted distinct keys with their codes: one-word keys as distances in 30 bits beside the code, two-word keys
    (digests) whole, with the code in place of their last two bits."""
    codes = codes.astype(np.uint64)
    if keys.shape[1] > 1:
        out = keys.copy()
        out[:, 1] = out[:, 1] & ~_CODES | codes
        return out.tobytes()
    step = np.diff(keys[:, 0], prepend=np.uint64(0)) << np.uint64(2) | codes
    if len(step) < 2 or int(step[1:].max()) < 1 << 32:
        planes = np.ascontiguousarray(step[1:].astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
        return b"\x01" + step[:1].tobytes() + zstandard.ZstdCompressor(level=1).compress(planes)
    return b"\x00" + step.tobytes()


def unpacked(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys and codes of packed()."""
    if width > 1:
        both = np.frombuffer(data, np.uint64).reshape(-1, width)
        keys = both.copy()
        keys[:, 1] &= ~_CODES
        return keys, (both[:, 1] & _CODES).astype(np.uint8)
    if data[:1] == b"\x00":
        step = np.frombuffer(data, np.uint64, offset=1)
    else:
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[9:]), np.uint8).reshape(4, -1)
        rest = np.ascontiguousarray(planes.T).view("<u4").ravel()
        step = np.concatenate((np.frombuffer(data[1:9], np.uint64), rest.astype(np.uint64)))
    return np.cumsum(step >> np.uint64(2), dtype=np.uint64)[:, None], (step & _CODES).astype(np.uint8)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key, ascending with the keys."""
    top = keys[:, 0] >> np.uint64(32 if keys.shape[1] > 1 else BITS - 32)
    return (top * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def dealt(chunk: int, keys: np.ndarray, codes: np.ndarray, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """(part, chunk, packed keys) of sorted distinct keys, for each part that gets any."""
    if len(keys):
        where = part_of(keys, parts)
        starts = np.flatnonzero(np.diff(where, prepend=-1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
            yield int(where[a]), chunk, packed(keys[a:b], codes[a:b])


def answers(frame: DataFrame, deal: Callable, width: int) -> DataFrame:
    """(chunk, answers) for the keys that ``deal`` (a function of mapInArrow) yields as rows (part, chunk, keys);
    answers has a row of bits for each part, as merged() reads them."""

    def told(table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_numpy()
        found = [unpacked(x.as_py(), width) for x in table.column("keys")]
        sizes = [len(k) for k, _ in found]
        keys, codes = np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found])
        del found
        rows, _, inverse = distinct(keys)
        times = np.bincount(inverse, weights=1 + (codes >= MANY), minlength=len(rows))
        wanted = np.zeros(len(rows), bool)
        wanted[inverse[(codes & WANTED) > 0]] = True
        yes = (wanted & (times > 1))[inverse]
        bits = [np.packbits(x).tobytes() for x in np.split(yes, np.cumsum(sizes)[:-1])]
        return pa.table({"chunk": chunks, "part": table.column("part"), "n": pa.array(sizes, pa.int32()), "bits": pa.array(bits, pa.binary())})

    keyed = frame.mapInArrow(deal, "part int, chunk bigint, keys binary")
    told_ = keyed.groupBy("part").applyInArrow(told, "chunk bigint, part int, n int, bits binary")
    # A chunk gets as many bits as it has sent keys.
    return told_.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("part", "n", "bits"))).alias("answers"))


def merged(answers: list[dict] | None) -> np.ndarray:
    """One boolean for each of the chunk's distinct keys, in their order."""
    own = [np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["n"]).astype(bool) for a in answers or ()]
    return np.concatenate(own) if own else np.zeros(0, bool)


def parts_for(n: int) -> int:
    return max(1, -(-n // PART_KEYS))
