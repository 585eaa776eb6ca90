"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty for what no pattern knows.

A candidate is a long unbroken string in a sensitive context (a word such as password, bearer or credential shortly
before it). Its novelty is its marginal cost: the bytes zstandard needs for context and candidate together, less
those for the context alone, with a dictionary of identifiers and the document's own surroundings as prefix. The
dictionary holds the corpus's most frequent identifiers, counted over all texts, behind a few that every code base has.

A short word costs nearly as many bytes as it is long whatever it says, so the cost is held against a control: what the
candidate's own characters cost in the same place in random order. Names, words and paths share beginnings and endings
with the dictionary and cost less than their control; random keys have nothing to lose and cost as much.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.llm.common import BATCH_ROWS, batches_of, column, shape, table, texts

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # AKIA[A-Z0-9]+ of 16 or more: a shorter run holds no longer one
HEX = re.compile(r"[0-9a-f]{32,}")
#: A text without any of these, lower-cased, has no match of ASSIGN.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SENSITIVE = ("password", "passwd", "secret", "token", "apikey", "api_key", "api-key", "credential", "bearer", "private_key", "private-key", "access_key", "access-key", "auth_key", "passphrase", "client_id")
CONTEXT = re.compile("|".join(SENSITIVE), re.A | re.I)
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}")
#: A candidate begins at most REACH characters behind its sensitive word; AROUND characters on either side prime it.
REACH, AROUND = 48, 256
#: Bytes that a character of a candidate must cost at least (see costly() for long ones), and its share of what its
#: SHUFFLES random orders cost on average.
NOVELTY, OF_CONTROL, SHUFFLES = 0.5, 0.92, 8
LEVEL, CONTROLLED = 19, 256
IDENTIFIERS = (
    "username password passwd secret token api_key apikey access_key secret_key private_key public_key client_id client_secret "
    "authorization bearer basic credential credentials session cookie config configuration environment variable default example "
    "placeholder changeme your_password_here your_api_key_here insert_token_here localhost database connection string server host "
    "port user admin root test production development staging https http www com org net json xml yaml index value object function "
    "return import export class public static void const let var true false null none undefined request response header content "
    "length type application charset encoding license version github release the and for that with this from have abcdefghijklmnop"
    "qrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 -----------------================________________................"
)


#: Bytes of identifiers that the corpus gives to the dictionary, which goes to every task: its bound at any size.
DICTIONARY_BYTES = 110 << 10
#: Texts are dealt to 64 classes by their content. An identifier has to stand in texts of SPREAD classes, so that what
#: stands in copies of one text only, a key say, never becomes a known name.
SPREAD = 8


def corpus_identifiers(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY_BYTES, spread: int = SPREAD) -> str:
    """The most frequent identifiers (4 to 24 letters and underscores) by how many texts hold them, rarest first, as
    near ends of a dictionary are cheapest to point at; ``most`` bytes of them at most. Nulls hold none."""
    text = F.coalesce(column(text_col), F.lit(""))
    words = F.array_distinct(F.filter(F.split(text, "[^A-Za-z0-9_]+"), lambda w: w.rlike("^[A-Za-z_]{4,24}$")))
    rows = docs.select(F.pmod(F.xxhash64(text), F.lit(64)).cast("int").alias("at"), words.alias("words"))
    each = rows.select(F.explode("words").alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at")).alias("bit"))
    counts = each.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.bit_or("bit").alias("classes")).filter(F.bit_count("classes") >= spread)
    # In each of 16 classes the first names, then the first of those in one task: as many at any size, and the driver
    # gets what the dictionary takes.
    limit = most // 5  # names of four letters and a blank, at most
    first = F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("word"), F.lit(16))).orderBy(F.desc("n"), "word"))
    few = counts.select("word", "n", first.alias("r")).filter(F.col("r") <= limit)
    before = F.sum(F.length("word") + 1).over(Window.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, 0))
    top = few.select("word", "n", before.alias("size")).filter(F.col("size") <= most).select("word", "n").collect()
    return " ".join(r["word"] for r in sorted(top, key=lambda r: (r["n"], r["word"])))


@functools.lru_cache(maxsize=4)
def compressor(dictionary: str = IDENTIFIERS):
    import zstandard

    primed = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False, write_checksum=False)


def added(text: str, start: int, end: int, dictionary: str = IDENTIFIERS) -> Callable[[str], int]:
    """How many compressed bytes a string adds to the surroundings of text[start:end]."""
    size = compressor(dictionary).compress
    around = (text[max(0, start - AROUND) : start] + text[end : end + AROUND] + "\n").encode()
    alone = len(size(around))
    return lambda x: len(size(around + x.encode())) - alone


def marginal(text: str, start: int, end: int, dictionary: str = IDENTIFIERS) -> float:
    """Compressed bytes that text[start:end] adds to its surroundings, for each of its characters."""
    return added(text, start, end, dictionary)(text[start:end]) / (end - start)


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping for each kind."""
    out = []
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def costly(text: str, start: int, end: int, novelty: float = NOVELTY, dictionary: str = IDENTIFIERS) -> bool:
    """Whether each character costs ``novelty`` bytes or, in a string of over 100, what random digits cost at least
    (zstandard stores short strings as they are and codes longer ones down to their entropy, 0.415 for digits), and the
    string OF_CONTROL of what its characters cost in random order. The orders follow from the string, so that a text is
    judged alike wherever it is read again; of a long string the first CONTROLLED characters are shuffled."""
    own, cost = text[start:end], added(text, start, end, dictionary)
    if cost(own) < min(novelty, 0.42 + 13 / len(own)) * len(own):
        return False
    sample = own[:CONTROLLED]
    order = random.Random(sample)
    control = sum(cost("".join(order.sample(sample, len(sample)))) for _ in range(SHUFFLES)) / SHUFFLES
    return cost(sample) >= OF_CONTROL * control


def novel_spans(text: str, low: str, novelty: float = NOVELTY, dictionary: str = IDENTIFIERS) -> list[tuple[int, int, int]]:
    """(start, kind, end) of incompressible candidates in a sensitive context; a candidate begins within REACH and
    ends where its run of characters does, however long."""
    tried: dict[int, tuple[int, bool]] = {}
    if any(w in low for w in SENSITIVE):
        for m in CONTEXT.finditer(text):
            at = m.end()
            while c := CANDIDATE.search(text, at, m.end() + REACH + LEAST):
                start = c.start()
                if start not in tried:
                    end = CANDIDATE.match(text, start).end()
                    tried[start] = (end, costly(text, start, end, novelty, dictionary))
                at = tried[start][0]
    return sorted((start, 3, end) for start, (end, yes) in tried.items() if yes)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", novelty: float = NOVELTY, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc, base, spans, clean, *keep): base and spans are arrays of (kind, start, stop) in code points, the end
    exclusive, by start and then by kind; spans are those of the patterns and those that novelty adds. clean is the
    text with every span replaced by ``[SECRET]``. Columns named in ``keep`` come along.

    Nulls: a null text is empty and has no spans; null and repeated ids stay. No rows: no rows.
    """
    dictionary = f"{IDENTIFIERS} {corpus_identifiers(docs, text_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        for whole in batches:
            for batch in batches_of(whole, BATCH_ROWS):
                both, clean = ([], []), []
                for t in texts(batch, "__text"):
                    low = t.lower()
                    base = base_spans(t, low)
                    every = sorted({*base, *novel_spans(t, low, novelty, dictionary)})
                    for rows, spans in zip(both, (base, every), strict=True):
                        rows.append([{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in spans])
                    clean.append(masked(t, every))
                own = [pa.array(rows, spans_of) for rows in both] + [pa.array(clean, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *own, *batch.columns[2:]], names=["doc", "base", "spans", "clean", *(f"__{i}" for i in range(len(keep)))])

    rows = docs.select(column(id_col).alias("__doc"), column(text_col).alias("__text"), *(column(c).alias(f"__{i}") for i, c in enumerate(keep)))
    span = "array<struct<kind:string,start:int,stop:int>>"
    out = rows.mapInArrow(run, shape(("doc", docs.schema[id_col].dataType), ("base", span), ("spans", span), ("clean", "string"), *((f"__{i}", docs.schema[c].dataType) for i, c in enumerate(keep))))
    return out.select("doc", "base", "spans", "clean", *(F.col(f"__{i}").alias(c) for i, c in enumerate(keep)))


def masked(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with the union of the spans replaced, one mark for each run."""
    out, at = [], 0
    for start, _, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return out.select(F.col("doc").alias("doc_id"), *map(count, KINDS[:3]), F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"))
