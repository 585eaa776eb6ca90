"""Scalar rules of the ledger: rounding, names, ISINs, numbers, dates, sides. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int = 2) -> Column:
    """Rounding with halves towards plus infinity."""
    f = float(10**places)
    return F.floor(x * f + 0.5) / f


def fiscal_year(day: Column) -> Column:
    """The first calendar year of the fiscal year (1 April to 31 March) of a date."""
    return F.year(day) - (F.month(day) < 4).cast("int")


#: The signs of names that count as blanks, and the words of company forms that a name does without.
NAME_SIGNS, FORMS = r"-.,()'\"", "limited|ltd|private|pvt|the|co"
#: Runs of signs and blanks, and single ones that are no plain blank: what is a plain blank already is left in place.
_GAPS = rf"[{NAME_SIGNS}\s]{{2,}}|[{NAME_SIGNS}\t\n\x0B\f\r]"


def _squeezed(name: Column, forms: str) -> Column:
    """Words end at a sign as at a blank, so that forms are taken out before both become one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, rf"\b({forms})\b", " "), _GAPS, " "))


def _lower(name: Column) -> Column:
    return F.lower(F.coalesce(name, F.lit("")))


def norm_name(name: Column) -> Column:
    """Lower case, some signs and the words of company forms gone, single blanks; a null name is empty."""
    return _squeezed(_lower(name), FORMS)


def norm_private(name: Column) -> Column:
    """norm_name() that keeps the word for a private company, in one spelling."""
    return _squeezed(F.regexp_replace(_lower(name), r"\b(private|pvt)\b", "pvt"), "limited|ltd|the|co")


def tokens(norm: Column) -> Column:
    """The distinct words of a normalised name that tell names apart: none of one character, no numbers."""
    return F.array_sort(F.array_distinct(F.filter(F.split(norm, " "), lambda t: (F.length(t) > 1) & ~t.rlike("^[0-9]+$"))))


def isin_ok(isin: Column) -> Column:
    """Form and check digit: letters become 10..35, then Luhn over all digits."""
    digits = F.array_join(F.transform(F.split(isin, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    return F.coalesce(isin.rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$") & F.call_function("luhn_check", digits), F.lit(False))


def parse_number(text: Column) -> Column:
    """A number with grouping commas, a Unicode minus or parentheses for negatives; null if it is none. Exponents, words
    such as NaN and letters behind the figures make it none."""
    bare = F.translate(F.trim(text), "−,₹$ ", "-")
    form = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$"
    inner = F.regexp_extract(bare, r"^\((.*)\)$", 1)
    return F.when(bare.rlike(form), bare.try_cast("double")).when(bare.startswith("(") & inner.rlike(form), -inner.try_cast("double"))


def parse_date(text: Column) -> Column:
    """d-m-y with -, / or ., or y-m-d, or a serial day since 1899-12-30."""
    written = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$"
    serial = F.date_add(F.lit("1899-12-30").cast("date"), text.try_cast("int"))
    turned = F.when(text.rlike(written), F.regexp_replace(text, written, "$3-$2-$1").try_cast("date"))
    return turned.when(text.rlike(r"^\d{4}-\d{2}-\d{2}\z"), text.try_cast("date")).when(text.rlike(r"^\d{4,6}$"), serial)


#: Labels of transfers, then the words of sales, then those of purchases; in upper case, in this order.
TRANSFER_OUT, TRANSFER_IN = r"\bTRANSFER\s*(?:OUT|DEBIT)\b|\bXFER\s*OUT\b", r"\bTRANSFER\s*(?:IN|CREDIT)\b|\bXFER\s*IN\b"
SELL_WORDS, BUY_WORDS = r"SELL|SALE|BUY\s*-?\s*BACK|REDEEM|REDEM", "BUY|BONUS|SPLIT|IPO|RIGHT|PURCHASE|ALLOT|SUBSCRIB|PAID"
#: The vocabulary of statements, the first class that fits.
STATEMENT_WORDS = {
    "RIGHT": "RIGHT",
    "BONUS": "BONUS",
    "SPLIT": r"SPLIT|SUB-?DIV|FACE\s*VALUE|CONSOLIDAT",
    "SELL": r"SELL|SALE|BUY\s*-?\s*BACK|REDEM|REDEEM|SOLD",
    "BUY": "BUY|IPO|PURCHASE|ALLOT|SUBSCRIB|BOUGHT|CREDIT",
}
#: How notes of the transfer tool begin, and names of temporary rights.
TRANSFER_NOTE, RIGHTS_NAME = r"(?i)^\s*(?:transferred\s+(?:to|from)|bought\s+from|sold\s+to)\b", r"(?i)rights?\s*(issue|entitlement)|\(res?\)"


def _upper(text: Column) -> Column:
    return F.upper(F.coalesce(text, F.lit("")))


def is_transfer(tx_type: Column) -> Column:
    """Whether a label moves shares between portfolios; exactly the labels that ledger_side() takes for transfers."""
    return _upper(tx_type).rlike(f"{TRANSFER_OUT}|{TRANSFER_IN}")


def is_transfer_out(tx_type: Column) -> Column:
    return _upper(tx_type).rlike(TRANSFER_OUT)


def is_transfer_leg(tx_type: Column, note: Column) -> Column:
    """A transfer by its label, or a sale or purchase whose note says that a transfer wrote it; for display."""
    return is_transfer(tx_type) | F.coalesce(note, F.lit("")).rlike(TRANSFER_NOTE)


def is_free_share(tx_type: Column) -> Column:
    return _upper(tx_type).rlike("BONUS|SPLIT")


def is_split(tx_type: Column) -> Column:
    return _upper(tx_type).rlike("SPLIT")


def is_rights_name(name: Column) -> Column:
    """Placeholders of rights, which are no holdings."""
    return F.coalesce(name, F.lit("")).rlike(RIGHTS_NAME)


def ledger_side(tx_type: Column) -> Column:
    """BUY, SELL or null; transfers first, then the words of sales (a buyback is one), then those of purchases."""
    t = _upper(tx_type)
    return F.when(t.rlike(TRANSFER_OUT), "SELL").when(t.rlike(TRANSFER_IN), "BUY").when(t.rlike(SELL_WORDS), "SELL").when(t.rlike(BUY_WORDS), "BUY")


def nav_side(tx_type: Column) -> Column:
    """BUY, SELL or null as the NAV timeline takes labels: fewer words, and a buyback is a purchase there."""
    t = _upper(tx_type)
    return F.when(t.contains("SELL") | t.rlike(TRANSFER_OUT), "SELL").when(t.rlike(f"BUY|BONUS|SPLIT|IPO|RIGHT|{TRANSFER_IN}"), "BUY")


def statement_class(text: Column) -> Column:
    """RIGHT, BONUS, SPLIT, SELL, BUY or OTHER, first match wins: the vocabulary of statements."""
    t = _upper(text)
    return F.coalesce(*(F.when(t.rlike(words), name) for name, words in STATEMENT_WORDS.items()), F.lit("OTHER"))


def parse_ratio(text: Column) -> Column:
    """struct(num, den) of ``N:M``, ``N/M`` or ``N-M``; null unless both are above zero."""
    part = lambda i: F.regexp_extract(F.trim(text), r"^(\d+(?:\.\d+)?)\s*[:/-]\s*(\d+(?:\.\d+)?)$", i).try_cast("double")
    return F.when((part(1) > 0) & (part(2) > 0), F.struct(part(1).alias("num"), part(2).alias("den")))


def free_shares(tx_type: Column, ratio: Column, held: Column) -> Column:
    """Shares that a bonus N:M or a split new:old adds to what is held; nothing for nothing."""
    factor = ratio["num"] / ratio["den"] - is_split(tx_type).cast("int")
    return F.when((held > 1e-9) & (held * factor > 1e-9), held * factor).otherwise(0.0)


def buy_price(total: Column, turnover: Column, price: Column, qty: Column) -> Column:
    """What a share cost: charges and tax included, else without them, else the printed average."""
    return F.when((qty > 0) & (total > 0), total / qty).when((qty > 0) & (turnover > 0), turnover / qty).otherwise(price)


def gain_price(turnover: Column, price: Column, qty: Column) -> Column:
    """The price that gains are computed from, free of charges."""
    return F.when((qty > 0) & (turnover > 0), turnover / qty).otherwise(price)


def solved(edited: str, qty: Column, price: Column, amount: Column) -> dict[str, Column]:
    """Quantity, price and amount after one of them was edited: of the other two the first that is there stays (quantity
    before price before amount) and the last follows. Quantities and prices have six places, amounts two."""
    have = {"qty": qty, "price": price, "amount": amount}
    rule = {"amount": half_up(qty * price, 2), "price": half_up(amount / F.nullif(qty, F.lit(0.0)), 6), "qty": half_up(amount / F.nullif(price, F.lit(0.0)), 6)}
    others = [c for c in have if c != edited]
    first, last = others
    usable = have[edited] > 0
    out = dict(have)
    out[last] = F.when(usable & (have[first] > 0), rule[last]).otherwise(have[last])
    out[first] = F.when(usable & ~F.coalesce(have[first] > 0, F.lit(False)) & (have[last] > 0), rule[first]).otherwise(have[first])
    return out


def long_term_days(asset_class: Column) -> Column:
    """Days from which a gain is long term: 365 listed, 730 PE and AIF, none (null) for MF and BOND."""
    return F.when(asset_class.isin("PE", "AIF"), 730).when(asset_class.isin("MF", "BOND"), F.lit(None).cast("int")).otherwise(365)
