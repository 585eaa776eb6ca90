"""How reports write numbers, dates and names, and what a column of a sheet holds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions.values import half_up, parse_date, parse_number


def grouped(number: Column, least: int, most: int | None = None) -> Column:
    """A number with Indian grouping (three digits, then pairs) and ``least`` to ``most`` places; zeros beyond ``least``
    are left out."""
    most = least if most is None else most
    size = F.abs(half_up(number, most))
    whole = F.floor(size).cast("bigint").cast("string")
    tail = F.right(whole, F.lit(3))
    head = F.left(whole, F.greatest(F.length(whole) - 3, F.lit(0)))
    pairs = F.regexp_replace(head, r"\B(?=(\d{2})+$)", ",")
    text = F.when(head == "", tail).otherwise(F.concat(pairs, F.lit(","), tail))
    digits = F.lpad(F.round((size - F.floor(size)) * 10**most).cast("bigint").cast("string"), most, "0") if most else F.lit("")
    digits = F.concat(F.left(digits, F.lit(least)), F.regexp_replace(F.substring(digits, least + 1, 20), "0+$", "")) if most > least else digits
    out = F.concat(text, F.lit("."), digits) if most else text
    return F.when(half_up(number, most) < 0, F.concat(F.lit("-"), out)).otherwise(out)


def money(number: Column) -> Column:
    """Two places, negatives in parentheses."""
    return F.when(number < 0, F.concat(F.lit("("), grouped(-number, 2), F.lit(")"))).otherwise(grouped(number, 2))


def rate(number: Column) -> Column:
    """Two places, up to six where they say something, negatives in parentheses."""
    return F.when(number < 0, F.concat(F.lit("("), grouped(-number, 2, 6), F.lit(")"))).otherwise(grouped(number, 2, 6))


def quantity(number: Column) -> Column:
    """Whole, with a sign: a negative holding is a discrepancy."""
    return grouped(number, 0)


def crores(number: Column) -> Column:
    """In crores from ten million on."""
    return F.when(F.abs(number) >= 1e7, F.concat(F.lit("₹"), grouped(number / 1e7, 2), F.lit(" Cr"))).otherwise(F.concat(F.lit("₹"), grouped(number, 0)))


def day(text: Column) -> Column:
    """dd-Mmm-yyyy of a date in any known form; what is none stays as it is."""
    return F.coalesce(F.date_format(parse_date(F.trim(text)), "dd-MMM-yyyy"), F.trim(text), F.lit(""))


def natural_key(name: Column) -> Column:
    """Sorts names without regard to case, and numbers in them by value: digits are filled up with zeros."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1)), lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=[0-9])", ""), 20, "0")).otherwise(p)), "")


#: Words of headers, in the singular and in order; the first kind that a header has a word of counts. A
#: blank joins words that have to stand side by side. Identifiers are text, whatever their digits.
KINDS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("date", ("date",)),
    ("text", ("isin", "code", "pan", "folio", "dp id", "client", "ucc", "contract", "note no", "voucher", "order id", "order no", "trade id", "id", "symbol", "sery", "phone", "pin")),
    ("int", ("qty", "quantity", "number of share", "share", "unit", "day", "count")),
    ("rate", ("price", "rate", "avg cost", "average cost", "avg buy cost", "average buy cost", "cost per", "per share")),
    ("pct", ("%", "percent")),
    ("money", ("amount", "value", "turnover", "brokerage", "stt", "gst", "igst", "charge", "chg", "duty", "fee", "p l", "p & l", "profit", "loss", "gain", "net", "total", "invested", "expense", "stamp", "ipf", "demat", "sebi", "debit", "credit", "balance")),
    ("text", ("name", "company", "scrip", "asset", "narration", "remark", "note", "broker", "exchange", "status", "type", "segment", "category", "description", "action", "ratio", "source")),
)


def singular(word: str) -> str:
    """A header's word without its plural: companies, series, charges, shares."""
    return word[:-3] + "y" if word.endswith("ies") else word[:-1] if len(word) > 2 and word.endswith("s") and not word.endswith("ss") else word


def header_kind(header: str) -> str | None:
    """What a header says of its column, if anything; ``per share`` is a price although shares are counted."""
    words = f" {' '.join(singular(w) for w in re.findall('[a-z]+|[%&]', header.lower()))} "
    said = [kind for kind, known in KINDS if any(f" {w} " in words for w in known)]
    return "rate" if said[:1] == ["int"] and " per share " in words else next(iter(said), None)


def column_kinds(rows: DataFrame, sample: int = 200) -> dict[str, str]:
    """What each column of text holds: by its header, else by a sample of rows: numbers only if every value is one."""
    seen = rows.limit(sample)
    asked = {c: header_kind(c) if c.strip() else "text" for c in rows.columns}
    open_ = [c for c, k in asked.items() if k is None]
    if open_:
        said = lambda c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
        number = lambda c: parse_number(said(c))
        checks = [F.struct(F.count(said(c)).alias("n"), F.count(number(c)).alias("k"), F.max(number(c) != F.floor(number(c))).alias("broken")).alias(f"c{i}") for i, c in enumerate(open_)]
        found = seen.agg(*checks).first()
        for i, c in enumerate(open_):
            x = found[f"c{i}"]
            asked[c] = "text" if not x["n"] or x["k"] < x["n"] else "money" if x["broken"] else "int"
    return asked
