"""Schedules and statements: what was bought for what was sold, filed layouts, ratios, valuations, text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.values import half_up


#: The words of announcements: a bonus, a split (begun so, or as two words), what its face values stand
#: behind, and the currency.
BONUS, SPLITS, SUBDIVISION, FACES, CURRENCY = "bonus", ("split", "subdivision"), ("sub", "division"), ("from", "to"), ("rs", "re")


def clip(x: Column, top: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(x, top))


def purchases_used(purchases: DataFrame, matched: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``purchases`` with the part ``f`` that ``matched`` (by, cost) draws on: their turnover is used up in order.
    Cost, not shares, is compared, as a split leaves it alone. What exceeds all purchases was carried in."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = purchases.filter("qty > 0 and turnover > 0").withColumn("__before", F.coalesce(F.sum("turnover").over(w), F.lit(0.0)))
    used = clip(F.col("cost") - F.col("__before"), F.col("turnover"))
    return rows.join(matched.select(*by, "cost"), by).withColumn("f", used / F.col("turnover")).filter("f > 1e-9").drop("__before", "cost")


def unlisted_schedule(acquired: DataFrame, company: DataFrame, by: list[str]) -> DataFrame:
    """One row for each acquisition (by, day, qty, turnover) of a company (by, open_qty, open_cost, sold_qty,
    consideration, closing_cost), at least one: sales go to the oldest first, an excess to row 1; consideration by
    quantity, its rest to the last row that sells; closing cost at a row's own rate, the rest on row 1."""
    rate = F.col("turnover") / F.col("qty")
    acq = acquired.filter("qty > 0").groupBy(*by, "day", half_up(rate, 6).alias("rate6")).agg(F.sum("qty").alias("qty"), F.sum("turnover").alias("turnover"))
    g = Window.partitionBy(*by)
    line = g.orderBy("day", "rate6")
    rows = company.join(acq, by, "left").withColumn("row", F.row_number().over(line))
    first = F.col("row") == 1
    rows = rows.withColumn("avail", F.coalesce(F.col("qty"), F.lit(0.0)) + F.when(first, F.col("open_qty")).otherwise(0.0))
    before = F.coalesce(F.sum("avail").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("__take", clip(F.col("sold_qty") - before, F.col("avail")))
    excess = F.col("sold_qty") - F.sum("__take").over(g)
    rows = rows.withColumn("sold", F.col("__take") + F.when(first, excess).otherwise(0.0))
    rows = rows.withColumns({"closing_qty": F.col("avail") - F.col("sold"), "__last": F.max(F.when(F.col("sold") > 1e-9, F.col("row"))).over(g)})
    share = F.when(F.col("sold") > 1e-9, half_up(F.col("consideration") * F.col("sold") / F.col("sold_qty"))).otherwise(0.0)
    rows = rows.withColumn("__share", F.when(F.col("row") == F.col("__last"), 0.0).otherwise(share))
    rest = half_up(F.col("consideration") - F.sum("__share").over(g))
    own = half_up(F.greatest(F.lit(0.0), F.col("closing_qty")) * F.coalesce(F.col("turnover") / F.col("qty"), F.lit(0.0)))
    rows = rows.withColumn("__own", F.when(first, 0.0).otherwise(own))
    left = half_up(F.greatest(F.lit(0.0), F.col("closing_cost") - F.sum("__own").over(g)))
    return rows.select(
        *by,
        "row",
        "day",
        F.col("qty").alias("acquired_qty"),
        F.col("sold").alias("transferred_qty"),
        F.when(F.col("row") == F.col("__last"), rest).otherwise(F.col("__share")).alias("consideration_share"),
        "closing_qty",
        F.when(first, left).otherwise(F.col("__own")).alias("closing_cost_share"),
    )


def statement_net(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by, net): the last printed balance where a key has any, else signed quantities times all later ratios.
    Columns: kind, qty, balance, factor (null or what a BONUS, RIGHT or SPLIT multiplies holdings by)."""
    later = Window.partitionBy(*by).orderBy(*map(F.desc, order)).rowsBetween(Window.unboundedPreceding, -1)
    signed = F.when(F.col("kind") == "BUY", F.col("qty")).when(F.col("kind") == "SELL", -F.abs("qty")).otherwise(0)
    out = rows.withColumn("__part", signed * F.coalesce(F.product(F.coalesce("factor", F.lit(1.0))).over(later), F.lit(1.0)))
    net = F.when(F.max(F.col("balance") != 0), F.max_by("balance", F.struct(*order)).cast("double")).otherwise(F.sum("__part"))
    return out.groupBy(*by).agg(net.alias("net"))


def gcd(a: Column, b: Column) -> Column:
    """Of two whole numbers of at most 63 bits: Euclid's steps are at most 92."""
    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])


def pending_ratios(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows of kind BONUS, RIGHT or SPLIT with the ratio num:den that the jump of the balance suggests, in lowest
    terms: new to old for a split, added to held for the others, 1:1 (a growing split's default is 2:1) without one."""
    before = F.coalesce(F.lag("balance").over(Window.partitionBy(*by).orderBy(*order)), F.lit(0))
    out = rows.withColumn("held", before).filter("kind in ('BONUS', 'RIGHT', 'SPLIT')")
    top = F.when(F.col("kind") == "SPLIT", F.col("balance")).otherwise(F.col("balance") - F.col("held"))
    ok = (F.col("held") > 0) & (F.col("balance") > F.col("held"))
    out = out.withColumns({"__top": F.when(ok, top).otherwise(1), "__low": F.when(ok, F.col("held")).otherwise(1)}).withColumn("__g", gcd(F.col("__top"), F.col("__low")))
    return out.withColumns({"num": (F.col("__top") / F.col("__g")).cast("bigint"), "den": (F.col("__low") / F.col("__g")).cast("bigint")}).drop("__top", "__low", "__g")


def announced_ratio(subject: Column) -> Column:
    """struct(kind, factor) of an announcement: a bonus a:b multiplies by 1 + a/b, a split by old over new face value;
    null where either is missing, not positive or no increase.

    The text is taken apart into words, numbers and colons. A bonus is two numbers with a colon between them behind its
    word (with ``issue`` or a colon in between), a split's face values are the first numbers behind ``from`` and ``to``
    and the currency."""
    words = F.regexp_extract_all(F.lower(subject), F.lit(r"([a-z]+|[0-9]+(?:\.[0-9]+)?|:)"), F.lit(1))
    number = lambda at: F.get(words, at).try_cast("double")
    places = F.sequence(F.lit(0), F.size(words) - 1)

    def pair(i: Column) -> Column:
        at = i + 1 + (F.get(words, i + 1) == "issue").cast("int")
        at = at + (F.get(words, at) == ":").cast("int")
        return F.when((F.get(words, i) == BONUS) & (F.get(words, at + 1) == ":") & number(at + 2).isNotNull(), F.struct(number(at).alias("given"), number(at + 2).alias("held")))

    def face(word: str) -> Column:
        found = F.transform(places, lambda i: F.when((F.get(words, i) == word) & F.get(words, i + 1).isin(*CURRENCY), number(i + 2)))
        return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))

    bonus = F.get(F.filter(F.transform(places, pair), lambda x: x["given"].isNotNull()), F.lit(0))
    given, held = bonus["given"], bonus["held"]
    old, new = (face(w) for w in FACES)
    made = lambda kind, factor: F.struct(F.lit(kind).alias("kind"), factor.alias("factor"))
    begins = F.exists(words, lambda w: w.startswith(SPLITS[0]) | w.startswith(SPLITS[1]))
    says_split = begins | F.exists(places, lambda i: (F.get(words, i) == SUBDIVISION[0]) & F.get(words, i + 1).startswith(SUBDIVISION[1]))
    first = F.when((given > 0) & (held > 0), made("BONUS", 1 + given / F.nullif(held, F.lit(0.0))))
    ratio = F.when(given.isNotNull(), first).when(says_split & (new > 0) & (old > new), made("SPLIT", old / F.nullif(new, F.lit(0.0))))
    return F.when(F.size(words) > 0, ratio)


def valuation_update(register: DataFrame, updates: DataFrame, by: list[str], force: bool = False) -> DataFrame:
    """``updates`` (by, price, day) on a register (by, valuation, stamped): (by, price, day, status). A price that
    someone entered without a date stays, as does one that is not older than the update, unless ``force``."""
    rows = updates.join(register.withColumn("__row", F.lit(True)), by, "left")
    has = F.lit(not force) & (F.col("valuation") > 0)
    bad = F.coalesce(F.col("price") <= 0, F.lit(True)) | F.col("day").isNull()
    status = F.when(bad, "bad-price").when(F.col("__row").isNull(), "no-row").when(has & F.col("stamped").isNull(), "hand-entered").when(has & (F.col("day") <= F.col("stamped")), "not-newer").otherwise("written")
    return rows.select(*by, half_up(F.col("price"), 4).alias("price"), "day", status.alias("status"))


def text_lines(glyphs: DataFrame, page: list[str], tolerance: float = 5.0) -> DataFrame:
    """(page, line, text) from glyph runs (page, x, y, seq, text): going down a page, a run more than ``tolerance``
    below the line's first height begins a new line; a line reads from left to right. A page's distinct heights are
    folded to the lines' first heights, so a group is never more than one page."""
    heights = glyphs.filter("y is not null").groupBy(*page).agg(F.sort_array(F.collect_set(F.col("y").cast("double")), asc=False).alias("ys"))
    none = F.array().cast("array<double>")
    step = lambda tops, y: F.when(F.size(tops) == 0, F.array(y)).when(F.element_at(tops, -1) - y > tolerance, F.concat(tops, F.array(y))).otherwise(tops)
    tops = heights.select(*page, F.aggregate("ys", none, step).alias("tops"))
    rows = glyphs.join(tops, page).withColumn("line", F.size(F.filter("tops", lambda t: t >= F.col("y"))))
    parts = F.array_sort(F.collect_list(F.struct("x", "seq", "text")))
    return rows.groupBy(*page, "line").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))
