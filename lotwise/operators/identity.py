"""Identity of securities: names, aliases, ambiguous and generic tokens."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.values import norm_name, norm_private, tokens
from lotwise.operators.skew import apart
from lotwise.session import written


def generic_tokens(master: DataFrame, name: str = "name", least: int = 6) -> DataFrame:
    """(token, n): tokens of ``least`` or more entries."""
    t = master.select(F.explode(tokens(norm_name(F.col(name)))).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def collisions(master: DataFrame, key: str, name: str = "name") -> DataFrame:
    """(norm, n): normalised names that several entries own."""
    return master.select(norm_name(F.col(name)).alias("norm"), F.col(key).alias("k")).groupBy("norm").agg(F.countDistinct("k").alias("n")).filter("n > 1 and norm <> ''")


def entries(master: DataFrame, key: str, name: str, aliases: str | None = None, private: str | None = None) -> DataFrame:
    """(k, norm, own, private): every name an entry goes by, normalised; own is whether it is the entry's first name.
    ``aliases`` is an array of further names; entries flagged ``private`` go by names with the word for private too."""
    more = F.coalesce(F.col(aliases), F.array().cast("array<string>")) if aliases else F.array().cast("array<string>")
    flag = F.coalesce(F.col(private), F.lit(False)) if private else F.lit(False)
    said = master.select(F.col(key).alias("k"), flag.alias("private"), F.posexplode(F.concat(F.array(name), more)).alias("place", "said"))
    plain = said.select("k", norm_name(F.col("said")).alias("norm"), (F.col("place") == 0).alias("own"), F.lit(False).alias("private"))
    twins = said.filter("private").select("k", norm_private(F.col("said")).alias("norm"), F.lit(True).alias("own"), F.lit(True).alias("private"))
    return plain.unionAll(twins.filter(F.col("norm").rlike(r"\bpvt\b"))).filter("norm <> ''").groupBy("k", "norm").agg(F.max("own").alias("own"), F.max("private").alias("private"))


def alias_slots(names: DataFrame) -> DataFrame:
    """(norm, k): which entry a normalised name belongs to: one whose first name it is before one that has it as an
    alias, then the later one (the greater key)."""
    return names.groupBy("norm").agg(F.coalesce(F.max(F.when(F.col("own"), F.col("k"))), F.max("k")).alias("k"))


def beginnings(asked: DataFrame, names: DataFrame, least: int = 6) -> DataFrame:
    """(q, k): asked names (q) and entries' names (k, norm) of which one begins with the whole other, both of ``least``
    letters or more; equal names are there twice. A name is cut at those lengths only that names with the same first
    letters have on the other side, so that the equi-join on beginnings has few rows however long the names are."""
    stem = lambda c: F.left(c, F.lit(least))
    q, n = asked.filter(F.length("q") >= least).distinct(), names.filter(F.length("norm") >= least).distinct()

    def cut(long: DataFrame, c: str, short: DataFrame, of: str) -> DataFrame:
        sizes = short.groupBy(stem(of).alias("stem")).agg(F.collect_set(F.length(of)).alias("sizes"))  # no more than lengths of names
        each = long.withColumn("stem", stem(c)).join(sizes, "stem").withColumn("size", F.explode(F.filter("sizes", lambda x: x <= F.length(c))))
        return each.withColumn("head", F.substring(F.col(c), F.lit(1), F.col("size"))).drop("stem", "sizes", "size")

    longer = cut(q, "q", n, "norm").join(n, F.col("head") == F.col("norm")).select("q", "k")
    shorter = cut(n, "norm", q, "q").join(q, F.col("head") == F.col("q")).select("q", "k")
    return longer.unionAll(shorter)


def quote_symbols(held: DataFrame, master: DataFrame, overrides: DataFrame, least: int = 6) -> DataFrame:
    """``held`` (..., isin, name) with (key, how, primary, fallback): the symbols that a security is quoted by.

    ``overrides`` (isin, name, key; either of the first two may be null) name an entry by hand and come first, then an
    entry of ``master`` (key, isin, name, aliases, nse, bse) with the ISIN, then one that goes by the name, an alias or
    its symbol (the greater key of several), then the only one of which a name begins with the held one or is its
    beginning; if several entries do, that is ``ambiguous`` and none. NSE symbols go before BSE codes; without either a
    security has no symbols."""
    said = F.concat(F.array("name", "nse"), F.coalesce("aliases", F.array().cast("array<string>")))
    names = written(master.select(F.col("key").alias("k"), F.explode(said).alias("said")).select("k", norm_name(F.col("said")).alias("norm")).filter("norm <> ''").distinct(), "names")
    rows = held.withColumns({"__q": norm_name(F.col("name")), "__i": F.upper(F.trim("isin"))})
    rows = rows.withColumn("__i", apart(F.col("__i"), *rows.columns))
    by = lambda frame, c: frame.groupBy(c).agg(F.max("key").alias("key"))
    hand_isin = by(overrides.filter("isin is not null").withColumn("__i", F.upper(F.trim("isin"))), "__i").withColumnRenamed("key", "ho")
    hand_name = by(overrides.filter("name is not null").withColumn("__q", norm_name(F.col("name"))), "__q").withColumnRenamed("key", "hn")
    own = by(master.filter("isin is not null").withColumn("__i", F.upper(F.trim("isin"))), "__i").withColumnRenamed("key", "ki")
    exact = names.groupBy(F.col("norm").alias("__q")).agg(F.max("k").alias("kn"))
    out = rows.join(hand_isin, "__i", "left").join(own, "__i", "left").join(hand_name, "__q", "left").join(exact, "__q", "left")
    begun = beginnings(rows.select(F.col("__q").alias("q")), names, least).groupBy(F.col("q").alias("__q")).agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    out = out.join(begun, "__q", "left")
    hand = F.coalesce("ho", "hn")
    how = F.when(hand.isNotNull(), "override").when(F.col("ki").isNotNull(), "isin").when(F.col("kn").isNotNull(), "name").when(F.col("lo") < F.col("hi"), "ambiguous").when(F.col("lo") == F.col("hi"), "prefix").otherwise("unknown")
    out = out.withColumns({"how": how, "key": F.when(F.col("lo") == F.col("hi"), F.coalesce(hand, "ki", "kn", "lo")).otherwise(F.coalesce(hand, "ki", "kn"))})
    squeezed = lambda c: F.nullif(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""), F.lit(""))
    codes = master.select("key", F.concat(F.upper(squeezed("nse")), F.lit(".NS")).alias("ns"), F.concat(squeezed("bse"), F.lit(".BO")).alias("bo"))
    out = out.withColumn("__k", apart(F.col("key").cast("string"), *rows.columns)).join(codes.withColumn("__k", F.col("key").cast("string")).drop("key"), "__k", "left")
    return out.select(*held.columns, "key", "how", F.coalesce("ns", "bo", F.lit("")).alias("primary"), F.when(F.col("ns").isNotNull(), F.coalesce("bo", F.lit(""))).otherwise("").alias("fallback"))


#: Entries with a word that one task compares with a name of that word; more are dealt out.
WORD_ROWS = 20_000


def resolve(rows: DataFrame, master: DataFrame, key: str = "key", isin: str = "isin", name: str = "name", aliases: str | None = None, private: str | None = None, named: bool = False) -> DataFrame:
    """``rows`` with (resolved, how): by ISIN; by a name with the word for private, where an entry has it; by normalised
    name or alias; then by the only entry with a name whose telling words are all among the row's, or the other way
    round, or which begins as the row's does (six letters or more, either way). Else null, how ``ambiguous`` or
    ``unresolved``. A single word that six entries or more have does not tell names apart. If ``named``, with the
    normalised name and its ``owner`` too, the entry that it is a name of.

    Candidates of the last step come from equi-joins: on the rarer side's rarest word, and on whole beginnings; all are
    functions of distinct names, never of all rows. Every name is normalised once, and dealt out before that, as rows
    of names are small in files and long in work.
    """
    dealt = master.repartition(F.col(key))
    names = written(entries(dealt, key, name, aliases, private).withColumn("t", tokens(F.col("norm"))), "names")
    by_isin = master.filter(F.col(isin).isNotNull()).groupBy(F.col(isin).alias("__i")).agg(F.max(key).alias("ki"))
    slots = written(alias_slots(names), "slots")
    said = written(rows.repartition(F.xxhash64(*rows.columns)).withColumns({"__q": norm_name(F.col(name)), "__d": norm_private(F.col(name))}), "said")
    asked = said.select(F.col("__q").alias("q"), F.when(F.col("__d") != F.col("__q"), F.col("__d")).alias("d")).distinct()
    both = asked.join(slots.select(F.col("norm").alias("q"), F.col("k").alias("kq")), "q", "left")
    kept = both.filter("d is not null").join(slots.select(F.col("norm").alias("d"), F.col("k").alias("kd")), "d", "left").select("q", "d", "kq", F.coalesce("kd", "kq").alias("kn"))
    exact = written(both.filter("d is null").select("q", "d", "kq", F.col("kq").alias("kn")).unionAll(kept), "exact")
    open_ = written(exact.filter(F.col("kn").isNull()).select("q").distinct().select("q", tokens(F.col("q")).alias("qt")).filter(F.size("qt") > 0), "asked")
    # Words of six entries or more with their number; of the others any is rare enough.
    size = written(names.select("k", F.explode("t").alias("token")).distinct().groupBy("token").agg(F.count(F.lit(1)).alias("size")).filter("size >= 6"), "words")

    def sized(df: DataFrame, own: list[str], words: str) -> DataFrame:
        return df.select(*own, words, F.explode(words).alias("token")).join(size, "token", "left").withColumn("size", F.coalesce("size", F.lit(0)))

    def rarest(df: DataFrame, own: list[str], words: str) -> DataFrame:
        least = sized(df, own, words).groupBy(*own, words).agg(F.min(F.struct("size", "token")).alias("r"))
        return least.filter(~((F.size(words) == 1) & (F.col("r.size") >= 6))).select(*own, words, "r.token", "r.size")

    # A frequent word's entries are dealt over parts, each of which has all names that ask by the word.
    last = F.floor(F.col("size") / WORD_ROWS)
    asking = rarest(open_, ["q"], "qt").select("q", "qt", "token", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part"))
    having = sized(names, ["k"], "t").select("k", "t", "token", F.pmod(F.xxhash64("k"), last + 1).alias("part"))
    held = asking.join(having, ["token", "part"]).filter(F.size(F.array_except("qt", "t")) == 0)
    holding = rarest(names, ["k"], "t").drop("size").join(open_.select("q", "qt", F.explode("qt").alias("token")), "token").filter(F.size(F.array_except("t", "qt")) == 0)
    begun = beginnings(open_.select("q"), names.select("k", "norm"))
    fuzzy = functools.reduce(DataFrame.unionAll, (x.select("q", "k") for x in (held, holding, begun))).groupBy("q").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    found = exact.join(fuzzy, "q", "left").select(F.col("q").alias("__q"), F.coalesce("d", "q").alias("__d"), "kq", "kn", "lo", "hi")
    out = said.withColumn("__i", apart(F.col(isin), *said.columns)).join(by_isin, "__i", "left").join(found, ["__q", "__d"], "left")
    how = F.when(F.col("ki").isNotNull(), "isin").when(F.col("kn").isNotNull(), "name").when(F.col("lo") < F.col("hi"), "ambiguous").when(F.col("lo") == F.col("hi"), "fuzzy").otherwise("unresolved")
    resolved = F.when(how == "isin", F.col("ki")).when(how == "name", F.col("kn")).when(how == "fuzzy", F.col("lo"))
    more = (F.col("__q").alias("norm"), F.col("kq").alias("owner")) if named else ()
    return out.select(*rows.columns, resolved.alias("resolved"), how.alias("how"), *more)
