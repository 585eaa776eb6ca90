"""Securities of classes that are not listed: their tab by its headers, and how its rows join the master."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.formats import singular
from lotwise.functions.values import norm_name, norm_private, parse_date, parse_number
from lotwise.operators.identity import alias_slots, entries

#: What headers of the tab are called, in the singular; the first field that a header has words of takes
#: it, a word in parentheses only if it is the whole header. Of several columns of a field the last counts.
FIELDS: dict[str, tuple[str, ...]] = {
    "listed_from": ("listed", "listing", "ipo"),
    "valuation_date": ("valuation date", "value date", "val date", "as on", "as at", "as of"),
    "link": ("drive", "folder", "link", "url", "doc"),
    "isin": ("isin",),
    "pan": ("pan",),
    "face_value": ("face value", "face val", "(fv)"),
    "company_type": ("type of company", "type of entity", "company type", "entity type", "constitution", "(type)"),
    "valuation": ("valuation", "fair value", "value per", "price per", "per share", "cmp", "market price", "current price", "mkt"),
    "notes": ("note", "remark", "comment"),
    "company": ("company", "name", "scrip", "security", "entity"),
}
FIRST_COUNTS = ("company", "link")
#: Fixed value: the industry of what is not listed and has none.
UNLISTED = "Private Equity"


def class_columns(headers: list[str]) -> dict[str, str]:
    """field -> header. Without a name-like header the first column that is no other field has the companies."""
    found: dict[str, str] = {}
    for header in headers:
        words = " ".join(singular(w) for w in re.findall("[a-z]+", header.lower()))
        fits = lambda w: words == w[1:-1] if w.startswith("(") else f" {w} " in f" {words} "
        field = next((f for f, known in FIELDS.items() if any(map(fits, known))), None)  # noqa: B023
        if field and not (field in FIRST_COUNTS and field in found):
            found[field] = header
    if "company" not in found and headers:
        found["company"] = next((h for h in headers if h not in found.values()), headers[0])
    return found


def class_rows(tab: DataFrame, asset_class: str, order: str) -> DataFrame:
    """(row, asset_class, company, isin, valuation, valuation_date, pan, face_value, company_type, listed_from, bad_date,
    notes) of a tab whose columns are text under their headers, in the order of the column ``order``: the first row of
    each company. A listing date that cannot be read is no date and is reported as it stands. Rows without a company
    are left out; columns that a tab lacks are null."""
    at = class_columns([c for c in tab.columns if c != order])
    said = lambda f: F.nullif(F.trim(F.col(f"`{at[f]}`").cast("string")), F.lit("")) if f in at else F.lit(None).cast("string")
    above = lambda f: F.when(parse_number(said(f)) > 0, parse_number(said(f)))
    rows = tab.select(F.col(f"`{order}`").alias("row"), F.lit(asset_class).alias("asset_class"), said("company").alias("company"), F.upper(said("isin")).alias("isin"), above("valuation").alias("valuation"), parse_date(said("valuation_date")).alias("valuation_date"), F.upper(said("pan")).alias("pan"), above("face_value").alias("face_value"), said("company_type").alias("company_type"), parse_date(said("listed_from")).alias("listed_from"), F.when(parse_date(said("listed_from")).isNull(), said("listed_from")).alias("bad_date"), said("notes").alias("notes"))
    first = F.row_number().over(Window.partitionBy(F.lower("company")).orderBy("row"))
    return rows.filter("company is not null").withColumn("__r", first).filter("__r = 1").drop("__r")


def placed(master: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (row, company, isin, listed_from, ...) with (key, how): the entry that each belongs to.

    A row with an ISIN belongs to the entry that has it, ticker or not, or else to a new one of its own. A row without is
    known by its name: the entry that goes by it, if that has no ticker or the row says since when it is listed; beside
    one with a ticker it is a ``twin`` under the name that keeps the word for private, where no entry goes by that, and
    ``skipped`` where nothing tells the two apart. Names that no entry has belong to a new entry with an ISIN of the same
    name, or to one of their own. Rows are placed against the master as it was, so their order decides nothing."""
    key = F.col("key").cast("string")
    slots = alias_slots(entries(master.withColumn("key", key), "key", "name", "aliases"))
    ticker = F.coalesce(F.trim("nse") != "", F.lit(False)) | F.coalesce(F.trim("bse") != "", F.lit(False))
    traded = master.select(key.alias("kn"), ticker.alias("ticker"))
    by_isin = master.filter("isin is not null").groupBy(F.upper(F.trim("isin")).alias("i")).agg(F.max(key).alias("ki"))
    r = rows.withColumns({"i": F.nullif(F.upper(F.trim("isin")), F.lit("")), "nk": norm_name(F.col("company")), "dk": norm_private(F.col("company"))}).filter("nk <> ''")
    r = r.join(by_isin, "i", "left").join(slots.select(F.col("norm").alias("nk"), F.col("k").alias("kn")), "nk", "left").join(slots.select(F.col("norm").alias("dk"), F.col("k").alias("kd")), "dk", "left").join(traded, "kn", "left")
    fresh = r.filter("i is not null and ki is null").groupBy("nk").agg(F.min_by("i", "row").alias("new_isin"))
    r = r.join(fresh, "nk", "left")
    named = F.col("i").isNull() & F.col("kn").isNotNull()
    clash = named & F.col("ticker") & F.col("listed_from").isNull()
    apart = (F.col("dk") != F.col("nk")) & F.col("kd").isNull()
    how = F.when(F.col("ki").isNotNull(), "isin").when(clash & apart, "twin").when(clash, "skipped").when(named, "name").otherwise("new")
    target = F.when(how == "isin", F.col("ki")).when(how == "twin", F.col("dk")).when(how == "name", F.col("kn")).when(how == "new", F.coalesce("i", "new_isin", "nk"))
    guarded = (how == "new") & F.coalesce(F.col("ticker"), F.lit(False))
    return r.select(*rows.columns, how.alias("how"), target.alias("key"), guarded.alias("guarded"), F.col("kn").alias("name_owner"))


def fold_classes(master: DataFrame, rows: DataFrame, today: datetime.date) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The master (key, name, isin, nse, bse, aliases, asset_class, industry, price_except) with the rows of class tabs.

    entries: (key, name, isin, nse, bse, asset_class, listed_from, price_except, valuation, valuation_date, pan,
    face_value, company_type, notes, industry, how): the master's, how ``kept`` or ``folded``, and ``new`` ones and
    ``twin`` s. The class is the entry's own or the first row's; of the facts the last row's that has them count. What is
    not listed today has no exchange price, and an industry of its own where none is set. names: (norm, key) that new
    entries go by: the plain name unless a listed entry has it, else the one with the word for private. skipped: (row,
    company, key of the entry in the way)."""
    at = placed(master, rows)
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("row"))).alias(c)
    facts = ("listed_from", "valuation", "valuation_date", "pan", "face_value", "company_type", "notes")
    folded = at.filter("how <> 'skipped'").groupBy("key").agg(F.min_by("asset_class", "row").alias("row_class"), F.min_by("company", "row").alias("company"), F.min_by(F.upper(F.trim("isin")), "row").alias("row_isin"), F.min_by("how", F.struct(F.col("how") == "new", "row")).alias("as"), *map(last, facts))
    m = master.select(F.col("key").cast("string").alias("key"), "name", "isin", "nse", "bse", "asset_class", "industry", F.coalesce("price_except", F.lit(False)).alias("price_except"))
    all_ = m.withColumn("__m", F.lit(True)).join(folded, "key", "full")
    mine, listed = F.col("__m").isNotNull(), F.coalesce(F.col("listed_from") <= F.lit(today), F.lit(False))
    touched = F.col("as").isNotNull()
    off = touched & ~listed
    out = all_.select("key", F.coalesce("name", "company").alias("name"), F.coalesce("isin", "row_isin").alias("isin"), "nse", "bse", F.coalesce("asset_class", "row_class").alias("asset_class"), "listed_from", (F.coalesce("price_except", F.lit(False)) | off).alias("price_except"), *facts[1:], F.coalesce(F.nullif("industry", F.lit("")), F.when(off, UNLISTED)).alias("industry"), F.when(mine & touched, "folded").when(mine, "kept").otherwise(F.col("as")).alias("how"))
    new = at.filter("how in ('new', 'twin')")
    private = norm_private(F.col("company"))
    names = new.select(F.when((F.col("how") == "twin") | F.col("guarded"), private).otherwise(norm_name(F.col("company"))).alias("norm"), "key", "how", "guarded", norm_name(F.col("company")).alias("plain"))
    names = names.filter(~F.col("guarded") | (F.col("norm") != F.col("plain"))).select("norm", "key").distinct()
    skipped = at.filter("how = 'skipped'").select("row", "company", F.col("name_owner").alias("key"))
    return out, names, skipped

