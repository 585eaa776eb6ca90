"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document is measured once. Of the documents that pass the base rule, a KLL sketch of every measure is kept for
each (language, source) group; sketches merge, so a language's and the corpus's come from the groups' without another
look at the documents. Of measures that are zero for most texts, those above zero are sketched. A group's quartiles are drawn towards its language's, and these towards the corpus's, by
PRIOR_DOCS documents' worth, so that small groups lean on what is known of larger ones and large ones on themselves. A
cutoff lies FENCE half-spreads from the median: the spread of its own half, but at most LIFT times that of the other
half, so that a group with up to half of junk at one end cannot lift its own cutoff out of reach. The cutoffs are
joined back to the documents, hot groups spread out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.common import BATCH_ROWS, SPACES, all_of, batches_of, column, shape, table, texts
from lotwise.operators.skew import hot_keys, skew_join
from lotwise.session import written

SYMBOLS = "#*$%&|<>"
#: Half-spreads between median and cutoff, the most that one half's spread counts beside the other's, and how many
#: documents of its parent a group's quartiles are mixed with.
FENCE, LIFT, PRIOR_DOCS = 8.0, 3.0, 10.0
#: Size of a sketch: exact up to that many documents, a rank error of about 0.2 % beyond.
SKETCH_K = 2048
QUARTILES = (0.25, 0.5, 0.75)
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_signs")
#: measure -> (count, of what, whether low values fail too, whether texts without any say nothing of what is usual)
MEASURES = {
    "word_length": ("word_chars", "n_words", True, False),
    "signs": ("n_signs", "word_chars", False, False),  # SYMBOLS are among them
    "dup_lines": ("n_dup_lines", "n_lines", False, True),
    "repeats": ("n_repeat_words", "n_words", False, True),
}
#: All bytes but ASCII punctuation.
NO_SIGNS = bytes(b for b in range(256) if not (33 <= b < 127) or chr(b).isalnum())


def value(measure: str) -> Column:
    """A measure, over the counts of measured()."""
    count, of, _, _ = MEASURES[measure]
    return F.when(F.col(of) > 0, F.col(count) / F.col(of)).otherwise(0.0)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words which occurs twice or more. Hashes find windows that may be
    equal; their words decide."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    own = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(width):
        key = (key ^ own[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    at = np.flatnonzero(maybe).tolist()
    seen = Counter(tuple(words[i : i + width]) for i in at)
    twice = np.array([i for i in at if seen[tuple(words[i : i + width])] > 1], np.int64)
    edge = np.zeros(len(words) + 1, np.int64)
    edge[twice] += 1
    np.add.at(edge, twice + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def counts(text: str) -> tuple[int, ...]:
    """COUNTS of a whole text."""
    data = text.encode()
    words = data.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines), len(data.translate(None, NO_SIGNS)))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc, lang, source, COUNTS) for every row; null language or source counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, BATCH_ROWS):
                rows = np.array([counts(t) for t in texts(batch, "text")], np.int64).reshape(-1, len(COUNTS))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, rows.T.copy())], names=["doc", "lang", "source", *COUNTS])

    group = [F.coalesce(column(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]
    rows = docs.select(column(id_col).alias("doc"), *group, column(text_col).alias("text"))
    return rows.mapInArrow(run, shape(("doc", docs.schema[id_col].dataType), ("lang", "string"), ("source", "string"), *((c, "bigint") for c in COUNTS)))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def fences(rows: DataFrame, fence: float = FENCE, lift: float = LIFT, prior: float = PRIOR_DOCS) -> DataFrame:
    """(lang, source, n, <measure>_min, <measure>_max): the cutoffs of each group of measured rows, n counting all of
    its rows. A group of which no document counts for a measure has its language's cutoffs, or the corpus's; a cutoff
    is null where none of the corpus counts."""

    def counted(m: str) -> Column:
        seen = ~base_failed() & (F.col(MEASURES[m][0]) > 0) if MEASURES[m][3] else ~base_failed()
        return F.when(seen, value(m))

    own = [x for m in MEASURES for x in (F.kll_sketch_agg_double(counted(m), F.lit(SKETCH_K)).alias(m), F.count(counted(m)).alias(f"{m}_n"))]
    groups = written(rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *own), "sketches")
    merge = [x for m in MEASURES for x in (F.kll_merge_agg_double(m).alias(m), F.sum(f"{m}_n").alias(f"{m}_n"))]

    def quartiles(level: str, df: DataFrame, on: list[str]) -> DataFrame:
        q = lambda m, r: F.when(F.col(f"{m}_n") > 0, F.kll_sketch_get_quantile_double(m, F.lit(r)))
        return df.select(*on, *(F.coalesce(f"{m}_n", F.lit(0)).alias(f"{m}_{level}_n") for m in MEASURES), *(q(m, r).alias(f"{m}_{level}_{i}") for m in MEASURES for i, r in enumerate(QUARTILES)))

    langs, all_ = groups.groupBy("lang").agg(*merge), groups.agg(*merge)
    joined = groups.select("lang", "source", "n").join(quartiles("group", groups, ["lang", "source"]), ["lang", "source"])
    joined = joined.join(quartiles("lang", langs, ["lang"]), "lang").join(F.broadcast(quartiles("all", all_, [])), on=F.lit(True))  # one row

    def mixed(m: str, i: int) -> Column:
        q = F.col(f"{m}_all_{i}")
        for level in ("lang", "group"):
            n = F.col(f"{m}_{level}_n")
            q = F.when(n > 0, (n * F.col(f"{m}_{level}_{i}") + prior * q) / (n + prior)).otherwise(q)
        return q

    near = joined.select("lang", "source", "n", *(mixed(m, i).alias(f"{m}_{i}") for m in MEASURES for i in range(3)))
    cut = []
    for m, (_, _, both, _) in MEASURES.items():
        low, mid, high = (F.col(f"{m}_{i}") for i in range(3))
        below, above = mid - low, high - mid
        cut += [(mid - fence * F.least(below, lift * above)).alias(f"{m}_min")] if both else []
        cut.append((mid + fence * F.least(above, lift * below)).alias(f"{m}_max"))
    return written(near.select("lang", "source", "n", *cut), "fences")


def filtered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", fence: float = FENCE) -> DataFrame:
    """(doc, COUNTS, base_failed, kept) for every row.

    base_failed: under MIN_WORDS words, or over MAX_REPEAT_PERCENT of the words in repeated 5-word windows. kept: not
    base_failed and no measure beyond its group's cutoff.

    Nulls: a null text has no words; null languages and sources form a group with the empty ones; null and repeated
    ids stay. No rows: no rows. Other columns are not read.
    """
    rows = written(measured(docs, id_col, text_col, lang_col, source_col), "measured")
    cutoffs = fences(rows, fence)
    total = cutoffs.agg(F.sum("n")).first()[0] or 0
    out = skew_join(rows, cutoffs, ["lang", "source"], hot=hot_keys(cutoffs, ["lang", "source"], "n", total))
    none = lambda m: F.col(MEASURES[m][0]) == 0 if MEASURES[m][3] else F.lit(False)
    within = all_of(none(m) | F.coalesce(value(m) <= F.col(f"{m}_max"), F.lit(True)) for m in MEASURES)
    within &= all_of(F.coalesce(value(m) >= F.col(f"{m}_min"), F.lit(True)) for m in MEASURES if MEASURES[m][2])
    return out.select("doc", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & within).alias("kept"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filtered(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), *COUNTS[:5], "base_failed", "kept")
