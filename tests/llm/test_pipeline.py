"""The pipeline's stages against brute force, each on its own input."""

from collections import Counter

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from test_texts import components, plain_fp

DIR = "/root/testdata/sf0.001"


def base(docs):
    return docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("bigint").alias("n_chars"))


def test_near_dedup_keeps_one_of_each_group(spark, docs, rows, none):
    out = corpus_pipeline.near_dedup(spark, base(docs), DIR)
    assert out.columns == base(docs).columns
    kept = Counter((r["doc_id"], r["text"]) for r in out.collect())
    comp = components([plain_fp(r[1]) for r in rows])
    groups = {}
    for r, c in zip(rows, comp):
        groups.setdefault(c, []).append((r[0] is None, r[0] or 0, r))
    assert sum(kept.values()) == len(groups)
    assert Counter(i for i, _ in kept.elements()) == Counter(None if g[0][0] else g[0][1] for g in map(sorted_ids, groups.values()))
    assert corpus_pipeline.near_dedup(spark, base(none), DIR).collect() == []


def sorted_ids(group):
    return sorted(group, key=lambda x: x[:2])


def test_texts_change_and_columns_stay(spark, docs, rows, none):
    for stage in (corpus_pipeline.passages, corpus_pipeline.secrets):
        out = stage(spark, base(docs), DIR)
        assert out.columns == base(docs).columns
        got = out.collect()
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
        assert all(r["n_chars"] == len(r["text"]) for r in got)
        assert stage(spark, base(none), DIR).collect() == []
    clean = {r["doc_id"]: r["text"] for r in got}
    was = {r[0]: r[1] for r in rows}
    assert not any("AKIAABCD" in t or "hunter2" in t for t in clean.values())
    assert clean[15] == was[15]


def test_cut_characters_go(spark):
    same = "é" * 150
    frame = spark.createDataFrame([(1, "aé" + same + "xyz", "en", "s", 5), (2, "b" + same + "q", "en", "s", 5)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.passages(spark, frame, DIR).collect()}
    assert got == {1: "axyz", 2: "bq"}


def test_all_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, DIR)
        assert docs.columns == before.columns, name
        assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        docs = spark.createDataFrame(docs.collect(), before.schema)
    out = corpus_pipeline.run(spark, DIR).collect()
    at = 0
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert (r["sequence_id"], r["offset"]) == divmod(at, 2048) and len(r["ids"]) == 4 * r["length"]
        at += r["length"]
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in docs.collect()}


def test_quality_keeps_what_the_model_accepts(spark, docs, rows, none):
    """Nulls, empty and repeated rows and clashing names go through; a row stays as it is or goes by its score."""
    from lotwise.llm import quality_model

    model = quality_model.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    scored = quality_model.score(docs.select("doc_id", "text"), model).collect()
    want = Counter(r["doc"] for r in scored if r["score"] >= quality_model.THRESHOLD)
    out = corpus_pipeline.quality(spark, docs, DIR)
    assert out.columns == docs.columns
    got = out.collect()
    assert Counter(r["doc_id"] for r in got) == want and Counter(map(tuple, got)) <= Counter(map(tuple, docs.collect()))
    assert corpus_pipeline.quality(spark, none, DIR).collect() == []


def test_packed_holds_every_id_once(spark, docs, rows, none):
    from lotwise.llm import packing
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter((r[0], tuple([*tok.encode(r[1] or "", add_special_tokens=False).ids, packing.END_ID])) for r in rows)
    pieces = sorted(corpus_pipeline.packed(spark, docs, DIR).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    got, ids = Counter(), []
    for i, r in enumerate(pieces):
        assert (r["sequence_id"] * packing.WINDOW + r["offset"]) == sum(p["length"] for p in pieces[:i]) and r["start"] == len(ids)
        ids += np.frombuffer(r["ids"], "<u4").tolist()
        if len(ids) == r["doc_tokens"]:
            got[r["doc_id"], tuple(ids)] += 1
            ids = []
    assert got == want and not ids
    assert corpus_pipeline.packed(spark, none, DIR).collect() == []


def test_stages_take_clashing_columns(spark, docs, none):
    """Further columns, whatever they are called, stay with their rows."""
    more = docs.selectExpr("*", "9 as doc", "10 as rest", "11 as kept", "12 as row", "13 as `a.b`", "14 as clean", "15 as h", "16 as id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, DIR)
        assert out.columns == more.columns, name
        kept = {(r["doc"], r["rest"], r["kept"], r["row"], r["a.b"], r["clean"], r["h"], r["id"], r["key"], r["fp"]) for r in out.collect()}
        assert kept <= {(9, 10, 11, 12, 13, 14, 15, 16, 2, 6)}, name
        assert stage(spark, more.limit(0), DIR).collect() == [], name
