"""SentencePiece encoding and decoding for merge-type vocabularies, by a score-ordered agenda.

The agenda holds adjacent symbol pairs whose concatenation is a piece; the best score (leftmost on ties) merges
first, and the new symbol's pairs enter the agenda. No symbol can span two characters that stand side by side in no
piece, so a text falls apart there (before U+2581, at line feeds, between most letters and signs) and a worker merges
each distinct part once. The short chunks that are new in a slice of rows have their agendas in common arrays: a round
merges the best pair of each of them. Every text is checked against the sentencepiece library, its ids and what they decode to: a
difference is an error that names the texts, so that a wrong encoder or decoder cannot go unseen.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.common import BATCH_ROWS, ChunkCache, batches_of, column, lists, shape, table, texts

SPACE = "▁"
#: Parts of up to that many characters have their agenda in a list or in arrays; a pair that is no piece has the score NONE.
SHORT, NONE = 40, float("-inf")
#: Characters of texts, and of new chunks, that are taken at once at the most (but for a longer text).
AT_ONCE = 1 << 20
#: In arrays a symbol is a number below 1 << BITS, and what is none is NEVER.
BITS, CHARS, NEVER, ODD = 21, 0x110000, np.iinfo(np.int32).max, np.uint64(0x9E3779B97F4A7C15)
CHUNK = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Differs(RuntimeError):
    """The codec and the library give different answers."""


class Agendas:
    """The agendas of many short chunks in arrays. A piece's number is its place by falling score, its rank the least number of
    that score, so the least rank is the best; a character that is no piece has the number of pieces plus its code point."""

    def __init__(self, score: dict[str, float], ids: dict[str, int]):
        ranked = sorted(score, key=score.get, reverse=True)
        self.n, number = len(ranked), dict(zip(ranked, range(len(ranked))))
        if self.n + CHARS > 1 << BITS:
            raise ValueError("the vocabulary has too many pieces")
        fall = np.array([score[p] for p in ranked])
        rank = np.searchsorted(-fall, -fall).astype(np.int32)
        self.shared = np.bincount(rank, minlength=self.n) > 1
        self.ids = np.array([ids[p] for p in ranked], np.int32)
        self.number = np.arange(self.n, self.n + CHARS, dtype=np.int32)
        self.number[[ord(p) for p in ranked if len(p) == 1]] = [number[p] for p in ranked if len(p) == 1]
        halves, whole = [], []
        for p in ranked:
            for i in range(1, len(p)):
                if (a := self._of(number, p[:i])) is not None and (b := self._of(number, p[i:])) is not None:
                    halves.append(a << BITS | b)
                    whole.append(number[p])
        self.shift = np.uint64(64 - max(4, (3 * len(halves)).bit_length()))
        self.keys = np.full(1 << (64 - int(self.shift)), -1)
        self.whole, self.rank = (np.full(len(self.keys), NEVER, np.int32) for _ in range(2))
        left, whole = np.array(halves, np.int64), np.array(whole, np.int32)
        slot = self._slot(left)
        while len(left):  # a pair goes to its slot, or to the next that is free
            free = self.keys[slot] < 0
            self.keys[slot[free]] = left[free]
            more = self.keys[slot] != left
            self.whole[slot[~more]], self.rank[slot[~more]] = whole[~more], rank[whole[~more]]
            left, whole, slot = left[more], whole[more], (slot[more] + 1) % len(self.keys)

    def _of(self, number: dict[str, int], s: str) -> int | None:
        return number.get(s, self.n + ord(s) if len(s) == 1 else None)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * ODD >> self.shift).view(np.int64)

    def joined(self, values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The number (values: whole) or rank (values: rank) of the piece that two neighbours make, or NEVER."""
        keys = left.astype(np.int64) << BITS | right
        slot = self._slot(keys)
        there, out = self.keys[slot], values[slot]
        other = np.flatnonzero(there != keys)
        out[other] = NEVER
        other = other[there[other] >= 0]
        slot = slot[other]
        while len(other):
            slot = (slot + 1) % len(self.keys)
            there, found = self.keys[slot], values[slot]
            same = there == keys[other]
            out[other[same]] = found[same]
            more = ~same & (there >= 0)
            other, slot = other[more], slot[more]
        return out

    def merge(self, chunks: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Groups of chunks as they come to an end: their places, how many symbols each has, and all their symbols."""
        who, size = np.arange(len(chunks)), np.array([len(c) for c in chunks])
        symbol = self.number[np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")]
        ends = np.cumsum(size)
        agenda = np.full(len(symbol), NEVER, np.int32)
        agenda[:-1] = self.joined(self.rank, symbol[:-1], symbol[1:])
        agenda[ends - 1] = NEVER
        while len(who):
            best = np.minimum.reduceat(agenda, ends - size)
            going = best != NEVER
            if not going.all():
                stay = np.repeat(going, size)
                yield who[~going], size[~going], symbol[~stay]
                who, size, best, symbol, agenda = who[going], size[going], best[going], symbol[stay], agenda[stay]
                if not len(who):
                    return
                ends = np.cumsum(size)
            at = np.flatnonzero(agenda == np.repeat(best, size))
            if len(at) > len(who):  # the leftmost of equals
                at = at[np.searchsorted(at, ends - size)]
            if len(equal := np.flatnonzero(self.shared[best])):
                i = at[equal]
                best[equal] = self.joined(self.whole, symbol[i], symbol[i + 1])
            symbol[at] = best
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            symbol, agenda = symbol[stay], agenda[stay]
            gone = np.arange(len(who))
            at, size, ends = at - gone, size - 1, ends - gone - 1
            agenda[at] = NEVER
            right, left = at[at < ends - 1], at[at > ends - size] - 1
            pairs = np.concatenate([right, left])
            agenda[pairs] = self.joined(self.rank, symbol[pairs], symbol[pairs + 1])


class PieceCodec:
    """Encoder and decoder of one vocabulary (BPE with byte fallback, identity normalization, dummy prefix)."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        special = [sp.is_control(i) or sp.is_unknown(i) for i in range(size)]
        self.bytes = {int(p[1:-1], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
        self.score = {p: sp.get_score(i) for i, p in enumerate(pieces) if not special[i] and not sp.is_byte(i) and not sp.is_unused(i)}
        self.id = {p: i for i, p in enumerate(pieces) if p in self.score}
        if len(self.bytes) != 256 or any(re.search(f"[^{SPACE}]{SPACE}|.\n|\n.", p, re.S) for p in self.score):
            raise ValueError("the vocabulary needs byte fallback and pieces that stay within chunks")
        back = {i: bytes([b]) for b, i in self.bytes.items()}
        unknown = " \u2047 ".encode()  # what the library writes for an unknown piece
        written = [unknown if sp.is_unknown(i) else b"" if special[i] else back[i] if i in back else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.text, self.size = np.frombuffer(b"".join(written), np.uint8), np.array(list(map(len, written)))
        self.start = np.cumsum(self.size) - self.size
        self.dummy = np.array([not special[i] and p.startswith(SPACE) for i, p in enumerate(pieces)])
        self.end = np.array([sp.eos_id()], "<i4").tobytes()
        self.beside = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.chunks, self.parts = ChunkCache(self._chunk, 400_000), ChunkCache(self._part, 200_000)

    @functools.cached_property
    def agendas(self) -> Agendas:
        return Agendas(self.score, self.id)

    def merge(self, part: str) -> list[str]:
        """The part's symbols when no pair of the agenda is left."""
        return self._merge_short(part) if len(part) <= SHORT else self._merge_long(part)

    def _merge_short(self, part: str) -> list[str]:
        """The agenda as a list of every adjacent pair's score: one pass finds the best, the leftmost of equals."""
        symbol, known = list(part), self.score.get
        agenda = [known(pair, NONE) for pair in map(str.__add__, part, part[1:])]
        while agenda and (top := max(agenda)) != NONE:
            i = agenda.index(top)
            symbol[i] = both = symbol[i] + symbol.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = known(symbol[i - 1] + both, NONE)
            if i < len(agenda):
                agenda[i] = known(both + symbol[i + 1], NONE)
        return symbol

    def _merge_long(self, part: str) -> list[str]:
        """The agenda as a heap, for parts of any length."""
        symbol, n = list(part), len(part)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0 and (score := self.score.get(both := symbol[left] + symbol[right])) is not None:
                heapq.heappush(agenda, (-score, left, right, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, left, right, both = heapq.heappop(agenda)
            if after[left] != right or symbol[left] + symbol[right] != both or not symbol[left]:
                continue  # one of the two has merged meanwhile
            symbol[left], symbol[right] = both, ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            after[right] = -1
            offer(before[left], left)
            offer(left, after[left])
        return [s for s in symbol if s]

    def _chunk(self, chunk: str) -> bytes:
        beside, parts = self.beside, self.parts
        ends = [i for i, pair in enumerate(map(str.__add__, chunk, chunk[1:]), 1) if pair not in beside]
        if not ends:
            return parts[chunk]
        return b"".join([parts[chunk[at:end]] for at, end in zip([0, *ends], [*ends, None])])

    def _part(self, part: str) -> bytes:
        ids: list[int] = []
        known = self.id
        for s in self.merge(part):
            if s in known:
                ids.append(known[s])
            else:
                ids += [self.bytes[b] for b in s.encode()]
        return array("i", ids).tobytes()

    def _new(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        """Chunks of up to SHORT characters with their ids."""
        own, most = self.agendas, AT_ONCE // SHORT
        for some in (chunks[at : at + most] for at in range(0, len(chunks), most)):
            for who, size, symbol in own.merge(some):
                ends = np.cumsum(size)
                ids, named = own.ids[np.minimum(symbol, own.n - 1)].tobytes(), map(some.__getitem__, who.tolist())
                odd = set(np.searchsorted(ends, np.flatnonzero(symbol >= own.n), "right").tolist())
                each = [ids[a:b] for a, b in zip((4 * (ends - size)).tolist(), (4 * ends).tolist(), strict=True)]
                for k in odd:
                    each[k] = self._spelt(symbol[ends[k] - size[k] : ends[k]])
                yield from zip(named, each, strict=True)

    def _spelt(self, symbols: np.ndarray) -> bytes:
        """Ids of symbols with characters among them that are no piece: these are written in bytes."""
        ids: list[int] = []
        for s in symbols.tolist():
            if s < self.agendas.n:
                ids.append(self.agendas.ids[s])
            else:
                ids += [self.bytes[b] for b in chr(s - self.agendas.n).encode()]
        return array("i", ids).tobytes()

    def encode_all(self, rows: list[str]) -> list[bytes]:
        """Ids of each text as little-endian signed 32-bit items, the end id last."""
        group = (np.cumsum([len(t) for t in rows]) // AT_ONCE).tolist()
        return [ids for _, places in groupby(range(len(rows)), group.__getitem__) for ids in self._encoded([cut(rows[i]) for i in places])]

    def _encoded(self, apart: list[list[str]]) -> list[bytes]:
        distinct = set().union(*apart)
        here = dict(zip(distinct, map(self.chunks.get, distinct), strict=True))
        rest = [c for c, ids in here.items() if ids is None]
        here |= zip(rest, map(self.chunks.old.get, rest), strict=True)
        here |= self._new([c for c in rest if here[c] is None and 0 < len(c) <= SHORT])
        here |= [(c, self._chunk(c)) for c in rest if here[c] is None]
        self.chunks.add({c: here[c] for c in rest})
        return [b"".join(map(here.__getitem__, x)) + self.end for x in apart]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def checked(self, rows: list[str]) -> tuple[list[bytes], list[str], list[int]]:
        """Ids and decoded text of every row, and the places of rows of which the library says otherwise."""
        ids = self.encode_all(rows)
        want = self.library.encode(rows, add_eos=True, num_threads=1, return_type="numpy")  # arrays, not an object an id
        back = [self.decode(np.frombuffer(x, "<i4")) for x in ids]
        said = zip(ids, back, want, self.library.decode(want, num_threads=1), strict=True)
        return ids, back, [i for i, (a, b, c, d) in enumerate(said) if a != c.tobytes() or b != d]

    def _written(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.text[np.repeat(self.start[ids] - ends + size, size) + np.arange(ends[-1])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text: pieces in turn, bytes put together as UTF-8 (a byte that fits nowhere is U+FFFD), the dummy
        prefix gone."""
        raw = b"".join([self._written(ids[at : at + AT_ONCE // SHORT]) for at in range(0, len(ids), AT_ONCE // SHORT)])
        if len(ids) and raw[:1] == b" " and self.dummy[ids[0]]:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return loose(raw)


def cut(text: str) -> list[str]:
    """The chunks of a text whose spaces are U+2581, one more before it. Empty ones may stand between them."""
    if not text:
        return []
    if text[0] == " " or "  " in text or SPACE in text:
        return CHUNK.findall(SPACE + text.replace(" ", SPACE))
    return (SPACE + text).replace(" ", " " + SPACE).replace("\n", " \n ").split(" ")


def _single(error: UnicodeError) -> tuple[str, int]:
    return "\ufffd", error.start + 1


codecs.register_error("lotwise-single", _single)


def loose(raw: bytes) -> str:
    """UTF-8 with U+FFFD for every single byte that is no part of a character."""
    return raw.decode(errors="lotwise-single")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, ids array<int> with the end id, decoded string) for every row.

    Nulls: a null text is empty (the end id alone, decoded empty); null and repeated document ids stay. No rows:
    no rows. Other columns are not read. A text that the library encodes or decodes otherwise fails the job, with its id.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for whole in batches:
            for batch in batches_of(whole, BATCH_ROWS // 4):
                ids, back, wrong = own.checked(list(texts(batch, "text")))
                if wrong:
                    raise Differs(f"the library differs for documents {[batch.column(0)[i].as_py() for i in wrong[:20]]}")
                yield pa.RecordBatch.from_arrays([batch.column(0), lists(ids, np.int32, pa.int32()), pa.array(back, pa.string())], names=["doc", "ids", "decoded"])

    rows = docs.select(column(id_col).alias("doc"), column(text_col).alias("text"))
    return rows.mapInArrow(run, shape(("doc", docs.schema[id_col].dataType), ("ids", "array<int>"), ("decoded", "string")))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("doc").alias("doc_id"),
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
