"""Merges of derived and hand-kept tables: appends, upserts by identity, status that survives, rewinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.values import norm_name


def append_aligned(target: DataFrame, records: DataFrame) -> DataFrame:
    """``records`` below ``target`` in the target's column order: columns that a record lacks are null, and columns
    that the target lacks are added at its end."""
    return target.unionByName(records, allowMissingColumns=True)


def identity_of(isin: str, name: str) -> Column:
    """ISIN in upper case, else the name as it is compared."""
    return F.coalesce(F.nullif(F.upper(F.trim(isin)), F.lit("")), norm_name(F.col(name)))


def upsert(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(key, columns): a key's new values where they are not null, else the old ones. One row a key on either side."""
    o = old.select(*key, *(F.col(c).alias(f"__o_{c}") for c in columns))
    n = new.select(*key, *(F.col(c).alias(f"__n_{c}") for c in columns))
    return o.join(n, key, "full").select(*key, *(F.coalesce(f"__n_{c}", f"__o_{c}").alias(c) for c in columns))


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__r = 1").drop("__r")


def alert_upsert(old: DataFrame, found: DataFrame) -> DataFrame:
    """Alerts (isin, ex_date, kind, source, status) after a scan found (isin, ex_date, kind, source, rank): a new alert
    is ``new``; an old one keeps its status, and its kind unless an authoritative source (rank 0) says otherwise. Of
    several finds of an alert the most authoritative counts."""
    n = latest(found, ["isin", "ex_date"], [F.col("rank"), F.col("source"), F.col("kind")]).select("isin", "ex_date", F.col("kind").alias("nk"), F.col("source").alias("ns"), "rank")
    both = old.join(n, ["isin", "ex_date"], "full")
    takes = F.col("kind").isNull() | (F.col("rank") == 0)
    return both.select("isin", "ex_date", F.when(takes & F.col("nk").isNotNull(), F.col("nk")).otherwise(F.col("kind")).alias("kind"), F.when(takes & F.col("ns").isNotNull(), F.col("ns")).otherwise(F.col("source")).alias("source"), F.coalesce("status", F.lit("new")).alias("status"))


def rebuild_or_merge(old: DataFrame, fetched: DataFrame, wanted: DataFrame, key: list[str], session: str, value: str, least: float = 0.6) -> DataFrame:
    """The history after a full rebuild: ``fetched`` alone where it has ``least`` or more of the ``wanted`` keys, else
    merged into what is there (new values win), so that a failed fetch never empties the table."""
    share = wanted.select(*key).distinct().join(fetched.select(*key).distinct().withColumn("__got", F.lit(1)), key, "left").agg((F.count("__got") / F.count(F.lit(1)) >= least).alias("__full"))
    keep = old.join(fetched, [*key, session], "left_anti").join(F.broadcast(share), F.coalesce(~F.col("__full"), F.lit(True))).drop("__full")  # one row
    return fetched.select(*key, session, value).unionByName(keep.select(*key, session, value))


def append_new(master: DataFrame, incoming: DataFrame, isin: str = "isin", name: str = "name", order: str = "seq") -> DataFrame:
    """Rows of ``incoming`` whose ISIN and whose normalised name the master does not have, each ISIN and each name
    once: the first of a batch stays. Rows without a name are left out."""
    rows = incoming.withColumn("__n", norm_name(F.col(name))).withColumn("__i", F.nullif(F.upper(F.trim(isin)), F.lit(""))).filter("__n <> ''")
    m = master.select(norm_name(F.col(name)).alias("__n"), F.nullif(F.upper(F.trim(isin)), F.lit("")).alias("__i"))
    rows = rows.join(m.select("__n").distinct(), "__n", "left_anti").join(m.select("__i").filter("__i is not null").distinct(), "__i", "left_anti")
    nth = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(order))
    rows = rows.withColumn("__a", nth("__n")).filter("__a = 1").withColumn("__b", F.when(F.col("__i").isNotNull(), nth("__i")).otherwise(1))
    return rows.filter("__b = 1").select(*incoming.columns)


def rewound(ledger: DataFrame, import_id: str, imports: DataFrame) -> DataFrame:
    """The ledger without the rows of the imports that are taken back; rows without an import stay."""
    return ledger.join(imports.select(import_id).distinct(), import_id, "left_anti")


def set_status(alerts: DataFrame, acts: DataFrame, key: list[str]) -> DataFrame:
    """``alerts`` with the last status that ``acts`` (key, status, seq) gives them."""
    last = acts.groupBy(*key).agg(F.max_by("status", "seq").alias("__s"))
    return alerts.join(last, key, "left").withColumn("status", F.coalesce("__s", "status")).drop("__s")


def class_append(register: DataFrame, listed: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming`` (seq, name, isin) with ``outcome``: ``blank`` without a name, ``present`` if the register has its
    name or it came earlier in the batch, ``listed`` if a listed security has its ISIN or name, else ``added``."""
    rows = incoming.withColumn("__n", norm_name(F.col("name")))
    names = lambda df, flag: df.select(norm_name(F.col("name")).alias("__n")).distinct().withColumn(flag, F.lit(True))
    isins = listed.select(F.upper("isin").alias("__i")).filter("__i is not null").distinct().withColumn("__li", F.lit(True))
    out = rows.join(names(register, "__has"), "__n", "left").join(names(listed, "__ln"), "__n", "left").withColumn("__i", F.upper("isin")).join(isins, "__i", "left")
    nth = F.row_number().over(Window.partitionBy("__n").orderBy("seq"))
    status = F.when(F.col("__n") == "", "blank").when(F.col("__has") | (nth > 1), "present").when(F.col("__ln") | F.col("__li"), "listed").otherwise("added")
    return out.select(*incoming.columns, status.alias("outcome"))
