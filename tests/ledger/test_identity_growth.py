"""Resolvers on many rows: rows without a key, frequent words, names that are normalised once."""

from collections import Counter

import pytest
from lotwise.functions import values
from lotwise.operators import identity, pricing, skew
from pyspark.sql import functions as F


@pytest.fixture
def dealt(spark):
    """No broadcasts and no merged partitions, so that a partition shows what one task gets."""
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    was = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v)


def most(out):
    """The most rows that a task returns."""
    return max(Counter(r["p"] for r in out.withColumn("p", F.spark_partition_id()).collect()).values())


def test_holdings_without_a_key_do_not_meet_in_one_task(dealt):
    none = F.lit(None).cast("string")
    holdings = dealt.range(4000).select("id", F.lit(None).cast("bigint").alias("k"), none.alias("isin"), F.lit("").alias("name"))
    holdings = holdings.unionByName(dealt.range(4000, 8000).select("id", F.col("id").alias("k"), none.alias("isin"), F.lit("Shared Ltd").alias("name")))
    facts = dealt.createDataFrame([(7, 4005, None, "x", "steel"), (8, None, "IN1", "shared", "coal")], "row bigint, k bigint, isin string, name string, industry string")
    slots = dealt.createDataFrame([("shared", 1)], "norm string, k bigint")  # another entry's name, so that none of them uses it
    out = pricing.by_identity(holdings, facts, slots, "industry", "row")
    assert {r["id"]: r["found"] for r in out.filter("found is not null").collect()} == {4005: "steel"} and out.count() == 8000
    assert most(out.filter("id >= 4000")) < 1000  # the last join is by names, and none of these may use its own


def test_resolve_names_owners_and_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(identity, "WORD_ROWS", 5)  # the words large and ring are dealt over parts
    master = spark.createDataFrame([(i, None, f"Large Ring w{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]} Ltd") for i in range(40)] + [(99, "IN9", "Large Cone Only Ltd"), (98, None, "Large-Cone Only.")], "key bigint, isin string, name string")
    rows = spark.createDataFrame([(1, None, "ring large"), (2, None, "large cone"), (3, "IN9", None), (4, None, "THE Large, Ring (waa) Pvt. Ltd."), (5, None, "wba ring"), (6, None, "ring"), (7, None, "cone")], "id bigint, isin string, name string")
    out = {r["id"]: (r["resolved"], r["how"], r["norm"], r["owner"]) for r in identity.resolve(rows, master, named=True).collect()}
    assert out == {1: (None, "ambiguous", "ring large", None), 2: (None, "ambiguous", "large cone", None), 3: (99, "isin", "", None), 4: (0, "name", "large ring waa", 0), 5: (1, "fuzzy", "wba ring", None), 6: (None, "unresolved", "ring", None), 7: (None, "ambiguous", "cone", None)}


def test_names_with_signs_and_blanks(spark):
    said = ["The A--b\tCo.", "(Pvt)A", "a's  private-limited", " - ", None, "Cothe\ncoé co"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, n string").select("i", values.norm_name(F.col("n")).alias("a"), values.norm_private(F.col("n")).alias("b")).orderBy("i").collect()
    assert [(r["a"], r["b"]) for r in got] == [("a b", "a b"), ("a", "pvt a"), ("a s", "a s pvt"), ("", ""), ("", ""), ("cothe coé", "cothe coé")]


def test_rows_without_a_key_find_nothing(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None), (3, "")], "id int, key string").withColumn("key", skew.apart(F.col("key"), "id"))
    found = rows.join(spark.createDataFrame([("x", 1), (None, 2), ("", 3)], "key string, v int"), "key", "left")
    assert sorted((r["id"], r["v"]) for r in found.collect()) == [(1, 1), (2, None), (3, 3)]
