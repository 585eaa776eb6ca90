"""From raw documents to packed sequences: quality, near duplicates, repeated passages, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of documents. Rows with nulls in any column, empty texts,
repeated rows and empty tables go through all stages; what each does with them its docstring says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import near_texts, packing, quality_model, secret_scan, suffix_dedup
from lotwise.session import discard, temporary, written


def _rest(docs: DataFrame) -> Column:
    """All columns but the text, as one struct that rides along whatever they are called."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest")


def _with_text(out: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The columns of documents again, with a new text and its length."""
    made = {"text": text, "n_chars": F.length(text)}
    return out.select(*(made[c].cast("bigint").alias(c) if c == "n_chars" else made[c].alias(c) if c in made else F.col(f"rest.`{c}`").alias(c) for c in columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores THRESHOLD or more; it learns from the labels outside the held-out fold.
    A null text is scored as an empty one."""
    model = quality_model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select("doc_id", "text", F.struct("*").alias("row"))
    return quality_model.score(rows, model, keep=("row",)).filter(F.col("score") >= quality_model.THRESHOLD).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, similarity near_texts.SIMILARITY or more, checked
    exactly): that with the smallest id, those without an id last. Of rows that repeat id and text one stays; texts
    without words are a group of their own."""
    text = F.coalesce("text", F.lit(""))
    key = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("text"))
    groups = near_texts.one_of_each(docs.select(key.alias("key"), "text"), id_col="key")
    kept = groups.select(F.col("doc.id").alias("id"), F.col("doc.text").alias("h"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("h"))
    same = rows["id"].eqNullSafe(kept["id"]) & (rows["h"] == kept["h"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["id", "h"]).select("row.*")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of 200 bytes that stand anywhere else too; what is left of a
    character that was cut goes. A null text becomes an empty one."""
    out = suffix_dedup.remove_repeats(docs.select(_rest(docs), "text"), id_col="rest", as_text=True)
    return _with_text(out.select(F.col("doc").alias("rest"), "kept"), docs.columns, F.col("kept"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its secrets replaced by a mark. A null text becomes an empty one."""
    out = secret_scan.scan(docs.select("doc_id", "text", _rest(docs)), keep=("rest",))
    return _with_text(out.select("rest", "clean"), docs.columns, F.col("clean"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, ids included; a null text gives its end id alone."""
    return packing.pack(docs).select(F.col("doc").alias("doc_id"), "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", passages),
    ("secret scans", secrets),
    ("packing", packed),
]
#: SQL can express neither the classifier nor the tokens; tests/llm/test_pipeline.py has brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. What a stage wrote on its way goes when its result is written, and
    that when the next one's is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before = docs
        with temporary(spark):
            docs = written(stage(spark, before, sf_dir), name.split()[0].lower(), outlives=True)
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
