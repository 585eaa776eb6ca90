"""Packing by concatenate and cut: two passes of prefix sums over partition token totals.

Pass one tokenizes every document once and writes its ids, with the number of ids before it in its partition;
the partitions' totals (one row each) then give every partition its global offset. Pass two adds the two and cuts
the corpus-long id stream at multiples of the window: a document that spans windows becomes several boundary
records. Only the last window can be short, so padding is less than one window for the whole corpus.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.llm.common import BATCH_ROWS, ChunkCache, batches_of, column, shape, table, texts
from lotwise.session import written

WINDOW = 2048
END_ID = 1


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkEncoder:
    """Chunks between ASCII whitespace -> ids as little-endian unsigned 32-bit bytes.

    The vocabulary drops whitespace before it merges, so a text's ids are its chunks' ids in turn. Where it also puts
    texts in lower case and cuts letters from signs, a word with signs behind it is its small letters and its signs, so
    that ``Word`` and ``word,`` need no tokenizing of their own; each ends with the one id of it that ends a word. A batch's
    distinct parts that the cache does not have are tokenized together, others with a word between them whose one id
    tells them apart.
    """

    TOGETHER = 2000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), ChunkCache(None, 300_000)
        words = (w[:-4] for w, _ in sorted(self.tokenizer.get_vocab().items(), key=lambda x: -x[1]) if re.fullmatch("[a-z]{9,}</w>", w))
        self.between = next(w for w in words if len(self.tokenizer.encode(w, add_special_tokens=False).ids) == 1)
        self.mark = self.tokenizer.encode(self.between, add_special_tokens=False).ids[0]
        self.cuts = cuts_words(json.loads(self.tokenizer.to_str()))
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True

    def tokenize(self, chunks: list[bytes]) -> Iterator[bytes]:
        """The ids of each chunk."""
        groups = [[c.decode() for c in chunks[i : i + self.TOGETHER]] for i in range(0, len(chunks), self.TOGETHER)]
        made = self.tokenizer.encode_batch_fast([f" {self.between} ".join(g) for g in groups], add_special_tokens=False)
        for group, e in zip(groups, made, strict=True):
            ids = np.array(e.ids, "<u4")
            cut = np.flatnonzero(ids == self.mark)
            if len(cut) != len(group) - 1:  # a chunk has the word itself
                yield from (np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(group, add_special_tokens=False))
                continue
            raw, ends = ids.tobytes(), (4 * cut).tolist()
            for a, b in zip([0, *(x + 4 for x in ends)], [*ends, len(raw)], strict=True):
                yield raw[a:b]

    def words(self, parts: list[bytes]) -> Iterator[bytes]:
        """The ids of parts that are one word each."""
        groups = [[c.decode() for c in parts[i : i + self.TOGETHER]] for i in range(0, len(parts), self.TOGETHER)]
        made = self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, e in zip(groups, made, strict=True):
            ids = np.array(e.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) != len(group):  # a vocabulary without ends of words
                yield from self.tokenize([g.encode() for g in group])
                continue
            raw = ids.tobytes()
            for a, b in zip([0, *ends], ends):
                yield raw[a:b]

    def parts(self, chunk: bytes) -> tuple[bytes, ...]:
        """What a chunk's ids are put together from."""
        if self.cuts and (m := WORD_AND_SIGNS.fullmatch(chunk)):
            return (m[1].lower(), m[2]) if m[2] else (m[1].lower(),)
        return (chunk,)

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        chunks = [t.encode().split() for t in texts]
        ids, new, cache, old = {}, [], self.cache, self.cache.old
        for c in set().union(*chunks):
            if (value := cache.get(c)) is None:
                if (value := old.get(c)) is None:
                    new.append(c)
                    continue
                cache.put(c, value)
            ids[c] = value
        made = [self.parts(c) for c in new]
        known: dict[bytes, bytes] = {}
        words, others = [], []
        for part in set().union(*made):
            if (value := cache.get(part)) is None and (value := old.get(part)) is None:
                (words if self.cuts and (not part.strip(SIGNS) or WORD_AND_SIGNS.fullmatch(part)) else others).append(part)
            else:
                known[part] = value
        for todo, ids_of in ((words, self.words), (others, self.tokenize)):
            for part, value in zip(todo, ids_of(todo), strict=True):
                known[part] = cache.put(part, value)
        for c, own in zip(new, made, strict=True):
            ids[c] = known[own[0]] if len(own) == 1 else known[own[0]] + known[own[1]]
            if own[0] != c:
                cache.put(c, ids[c])
        return [b"".join(map(ids.__getitem__, own)) for own in chunks]


#: Letters of ASCII and Latin-1, then signs that no rule of such a vocabulary joins with letters.
SIGNS = b".,;:!?"
WORD_AND_SIGNS = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,;:!?]*)")


def cuts_words(tokenizer: dict) -> bool:
    """Whether a vocabulary puts all in lower case and its first step takes runs of letters, and runs of what is neither
    letter nor number, as words of their own."""
    steps = lambda x, of: x.get(of, [x]) if x else []
    lower = any(n["type"] == "Lowercase" for n in steps(tokenizer["normalizer"], "normalizers"))
    first = next(iter(steps(tokenizer["pre_tokenizer"], "pretokenizers")), {})
    return lower and first.get("type") == "Split" and {r"[\p{L}]+", r"[^\s\p{L}\p{N}]+"} <= set(first["pattern"].get("Regex", "").split("|"))


@functools.lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core already
    return ChunkEncoder(path)


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Pass one, lazily: (doc, part, before, n, ids) with the ids' raw bytes, ``end_id`` included."""
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = chunk_encoder(path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in batches_of(whole, 4 * BATCH_ROWS):
                ids = [x + end for x in encoder.encode(texts(batch, "text"))]
                n = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())], names=["doc", "part", "before", "n", "ids"])

    rows = docs.select(column(id_col).alias("doc"), column(text_col).alias("text"))
    return rows.mapInArrow(encode, shape(("doc", docs.schema[id_col].dataType), ("part", "int"), ("before", "bigint"), ("n", "bigint"), ("ids", "binary")))


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc, start (the document's ids before it), length, ids (raw unsigned 32-bit
    little-endian), doc_tokens, sequence_id, offset (position in the sequence).

    Nulls: a null text is empty and gives the one end id; null and repeated document ids stay as they are, each
    row being a document of its own. No documents: no pieces. Other columns are not read.
    """
    part = written(tokenized(docs, path or tokenizer_path(), id_col, text_col, end_id), "tokens")
    # One row a partition: their number is that of the input's splits, never that of the documents.
    totals = part.groupBy("part").agg(F.sum("n").alias("total"))
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    rows = part.join(F.broadcast(bases), "part").withColumn("at", F.col("base") + F.col("before"))
    first, last = F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("n") - 1) / window)
    cut = rows.withColumn("sequence_id", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    start = F.greatest(F.lit(0).cast("bigint"), F.col("sequence_id") * window - F.col("at"))
    stop = F.least(F.col("n"), (F.col("sequence_id") + 1) * window - F.col("at"))
    cut = cut.withColumns({"start": start, "length": stop - start})
    return cut.select(
        "doc",
        "start",
        "length",
        F.substring("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")).alias("ids"),
        F.col("n").alias("doc_tokens"),
        "sequence_id",
        (F.col("at") + F.col("start") - F.col("sequence_id") * window).alias("offset"),
    )


def pieces(docs: DataFrame) -> DataFrame:
    """pack() with the ids as their CRC-32."""
    out = pack(docs)
    return out.select(F.col("doc").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(table(spark, sf_dir, "documents"))
