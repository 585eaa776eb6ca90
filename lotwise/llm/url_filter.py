"""URL filters by a Bloom filter cascade, with DataFrame functions only.

A url's keys are its host and every parent domain, each with every path prefix of a listed length. All keys of the
corpus are the universe. Level one of a cascade encodes the listed keys of the universe; level two the other keys that
level one lets pass; level three the listed keys that level two lets pass; and so on until nothing passes wrongly. A
key is listed exactly when the first level that lets it through no more is an even one, for every key of the
universe, so urls are judged by looking bits up in a few literals, without a join.

Level one's false-positive rate is set so that about as many keys pass it wrongly as are listed; later levels have a
rate of one half. A cascade's size therefore grows with the listed keys times the logarithm of the universe's share,
never with the universe. It is checked against MOST_BYTES; a list beyond that is cut by a hash of the key into parts with
a cascade each over that part's universe, and the urls are judged by one part after the other.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.common import column, table
from lotwise.session import written

#: The rules of the query: (action, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: A cascade's literals go to every task; larger ones are built in parts.
MOST_BYTES = 32 << 20
WORD = 8  # bits of a filter are kept in bytes
#: Bytes of a filter that Spark joins into one row before the driver puts the rows together.
CHUNK = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def keys_of(host: Column, path: Column, most_labels: int, lengths: list[int]) -> Column:
    """Array of (key, size) of a url: parent domains of up to ``most_labels`` labels with path prefixes of the
    listed lengths, longest first; size is the key's length in characters."""
    labels = F.split(host, "\\.")
    domains = F.transform(F.sequence(F.least(F.size(labels), F.lit(most_labels)), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    usable = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path))
    both = F.flatten(F.transform(domains, lambda d: F.transform(usable, lambda n: F.struct(F.concat(d, F.substring(path, F.lit(1), n)).alias("key"), (F.length(d) + n).alias("size")))))
    return F.when(host == "", F.array().cast(both_type())).otherwise(both)


def both_type() -> str:
    return "array<struct<key:string,size:int>>"


class Level:
    """A Bloom filter as a literal: ``bits`` positions, ``hashes`` of them for each key."""

    def __init__(self, number: int, bits: int, hashes: int, data: bytes):
        self.number, self.bits, self.hashes, self.data = number, bits, hashes, data

    def passes(self, key: Column) -> Column:
        literal = F.unbase64(F.lit(base64.b64encode(self.data).decode()))
        hit = F.lit(True)
        for p in positions(key, self.number, self.bits, self.hashes):
            byte = F.conv(F.hex(F.substring(literal, (p / F.lit(WORD)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            hit = hit & (F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.pmod(p, F.lit(WORD)))), F.lit(2)) == 1)
        return hit


def positions(key: Column, number: int, bits: int, hashes: int) -> list[Column]:
    """Where a key's bits are; every level hashes differently."""
    return [F.pmod(F.xxhash64(F.lit(number), F.lit(i), key), F.lit(bits)) for i in range(hashes)]


def level(number: int, keys: DataFrame, n: int, rate: float) -> Level:
    """The filter of ``n`` keys with a false-positive rate of about ``rate``. Spark sets the bits and joins the bytes;
    the driver gets one row for each CHUNK bytes."""
    hashes = max(1, round(-math.log2(rate)))
    size = max(WORD, math.ceil(n * hashes / math.log(2) / WORD))
    at = keys.select(F.explode(F.array(*positions(F.col("key"), number, size * WORD, hashes))).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1), F.pmod("p", F.lit(WORD)).cast("int"))
    unset = keys.sparkSession.range(size).select(F.col("id").alias("cell"), F.lit(0).alias("byte"))
    cells = at.select(F.floor(F.col("p") / WORD).alias("cell"), bit.alias("byte")).unionAll(unset).groupBy("cell").agg(F.bit_or("byte").alias("byte"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("cell", "byte"))), lambda c: F.lpad(F.hex(c["byte"]), 2, "0"))
    rows = cells.groupBy(F.floor(F.col("cell") / CHUNK).alias("chunk")).agg(F.array_join(text, "").alias("hex")).orderBy("chunk")
    return Level(number, size * WORD, hashes, b"".join(bytes.fromhex(r["hex"]) for r in rows.toLocalIterator()))  # ``size`` bytes, checked by the caller


def bytes_of(listed: int, others: int) -> float:
    """About what the cascade of so many listed keys among others takes."""
    return listed * -math.log2(first_rate(listed, others)) / math.log(2) / 8 * 3


def first_rate(listed: int, others: int) -> float:
    return min(0.5, max(1e-9, listed / max(1, others)))


class Cascade:
    """Exact membership of ``listed`` keys among the keys of ``universe`` (both with a column ``key``)."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        inside = written(universe.join(listed.select("key").distinct(), "key", "left_semi").select("key").distinct(), "listed")
        outside = written(universe.join(listed.select("key"), "key", "left_anti").select("key").distinct(), "others")
        n = inside.count()
        self.levels: list[Level] = []
        rate = first_rate(n, outside.count())
        while n:
            self.levels.append(level(len(self.levels) + 1, inside, n, rate))
            wrong = written(outside.filter(self.levels[-1].passes(F.col("key"))), "passed")
            inside, outside, n, rate = wrong, inside, wrong.count(), 0.5

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for x in reversed(self.levels):
            out = F.when(~x.passes(key), F.lit(x.number % 2 == 0)).otherwise(out)
        return out

    @property
    def size(self) -> int:
        return sum(len(x.data) for x in self.levels)


def part_of(key: Column, parts: int) -> Column:
    """The part of a list that a key belongs to."""
    return F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts))


def keys_of_part(part: int, parts: int) -> Column:
    return F.filter("keys", lambda k: part_of(k["key"], parts) == part)


def best_of(cascades: dict[str, Cascade], keys: Column) -> Column:
    """The longest listed key of a url as (size, key, allow, block), an allow before a block; null without one."""
    verdicts = F.transform(keys, lambda k: F.struct(k["size"].alias("size"), k["key"].alias("key"), *(c.holds(k["key"]).alias(a) for a, c in cascades.items())))
    return F.array_max(F.filter(verdicts, lambda v: v["allow"] | v["block"]))


def longest(rows: DataFrame, listed: DataFrame, actions: Iterable[str] = ("allow", "block"), most_bytes: int = MOST_BYTES) -> DataFrame:
    """``rows`` with best_of() their keys. Where the cascades of a whole list would take more than ``most_bytes``, rows
    are judged by one part of the list after the other, and written between."""
    universe = written(rows.select(F.explode("keys.key").alias("key")).distinct(), "universe")
    n, all_ = listed.select("action", "key").distinct().count(), universe.count()
    parts = max(1, math.ceil(bytes_of(min(n, all_), all_) / most_bytes))
    out = rows
    for part in range(parts):
        mine = part_of(F.col("key"), parts) == part
        cascades = {a: Cascade(listed.filter(mine & (F.col("action") == a)), universe.filter(mine)) for a in actions}
        found = best_of(cascades, F.col("keys") if parts == 1 else keys_of_part(part, parts))
        out = out.withColumn("best", found if part == 0 else F.greatest("best", found))
        out = out if parts == 1 else written(out, "judged")
    return out


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc, host, path, rule, verdict) for every row, by ``rules`` (action, host, path).

    A rule fits its host and all subdomains where the url's path starts with the rule's; the longest wins, and an
    allow before a block where the same rule is listed as both. Without a rule the verdict is ``default``.

    Nulls: a null url, and one without ``://``, has an empty host and path and fits no rule; null and repeated ids
    stay. Rules with a null column are left out. No rows: no rows. Other columns are not read.
    """
    host = F.translate("host", UPPER, LOWER)
    listed = rules.dropna(subset=["action", "host", "path"]).select("action", "path", host.alias("host"), F.concat(host, "path").alias("key"))
    # What rules look like: the number of distinct path lengths and of labels is bounded by their maximum.
    size = listed.agg(F.collect_set(F.length("path")).alias("lengths"), F.max(F.size(F.split("host", "\\."))).alias("labels")).first()
    host, path = host_path(column(url_col))
    rows = pages.select(column(id_col).alias("doc"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("keys", keys_of(F.col("host"), F.col("path"), size["labels"] or 1, sorted(size["lengths"], reverse=True)))
    out = longest(rows, listed, most_bytes=most_bytes)
    return out.select("doc", "host", "path", F.col("best.key").alias("rule"), F.when(F.col("best").isNull(), F.lit(default)).when(F.col("best.allow"), "allow").otherwise("block").alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    return judge(table(spark, sf_dir, "pages"), rules).withColumnRenamed("doc", "page_id")
