"""Contract notes and transaction reports as text, one row a document: who sent it, and what rows it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions.values import half_up, parse_date, parse_number

#: What a sender's documents contain, tried in this order. Each inner list must all be present, any of
#: the lists suffices. The report's words are looked for without white space, all others in lower-case text.
REPORT = [["transactionreport", "transtype", "balqty"], ["transtype", "assetname", "balqty", "brokerage"]]
SENDERS = [
    ("zerodha", [["zerodha"]]),
    ("shareindia", [["share india"], ["shareindia"], ["share_india"]]),
    ("axis", [["axisdirect"], ["axis securities limited"], ["inz000161633"]]),
    ("integrated", [["segment name"], ["capital market segment of national clearing"], ["security/contract", "buy/sell"], ["integrated enterprises"], ["integrated e-mail"]]),
]
NUVAMA = [["inz000005231"], ["nuvama wealth"], ["edelweiss broking"]]
NUVAMA_V3 = [["wap mkt rate"], ["net obligation for"], ["contract note cum bill", "ucc/backoffice code"]]
#: Instrument codes are one of KINDS and one of UNDERLYINGS.
KINDS, UNDERLYINGS = ("OPT", "FUT"), ("IDX", "STK", "CUR", "IRD", "IVX")
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
RIGHTS = ("CE", "PE", "FUT")
DEFAULT_SENDER = "zerodha"

ROW_START = r"\d{2}-\d{2}-\d{4} (?:BUY|SELL|DIVIDEND) "
ROW = r"^(\d{2}-\d{2}-\d{4}) (BUY|SELL) (.+?) ([\d,]+) ([\d,.]+) ([\d,.]+) ([\d,.]+) ([\d,]+)(?: |$)"


def _has(text: Column, lists: list[list[str]]) -> Column:
    out = F.lit(False)
    for words in lists:
        every = F.lit(True)
        for w in words:
            every = every & text.contains(w)
        out = out | every
    return out


def sender(text: Column) -> Column:
    """The first sender whose words a document contains; one that nobody claims is DEFAULT_SENDER's."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.when(_has(F.regexp_replace(low, r"\s+", ""), REPORT), "transaction-report")
    for name, lists in SENDERS:
        found = found.when(_has(low, lists), name)
    branded = low.contains("nuvama wealth and investment")
    family = F.when(_has(low, NUVAMA_V3), "nuvama-v3").when(branded, "nuvama-v2").when(low.contains("edelweiss broking ltd"), "nuvama-v1")
    return F.coalesce(found.when(_has(low, NUVAMA), family), F.lit(DEFAULT_SENDER))


def contract(word: Column) -> Column:
    """struct(day, month, year, strike, right) of an exchange contract symbol, read from its right end: what it is
    (right, may be empty), a strike and a year in one run of figures (a year of four digits where there are so many), a
    month's name, two figures of the day, and an underlying that begins with a letter; null fields where it is none."""
    right = F.coalesce(*(F.when(word.endswith(r), r) for r in RIGHTS), F.lit(""))
    body = F.left(word, F.length(word) - F.length(right))

    def dated(month: Column) -> Column:
        figures = F.call_function("substring_index", body, month, F.lit(-1))
        before = F.left(body, F.length(body) - F.length(figures) - 3)
        whole = F.substring_index(figures, ".", 1)
        digits = F.when(F.length(whole) >= 4, 4).otherwise(2)
        name = F.left(before, F.length(before) - 2)
        fits = (F.instr(body, month) > 0) & (F.length(whole) >= 2) & (F.translate(whole, "0123456789", "") == "") & (F.size(F.split(figures, "[.]")) <= 2) & figures.rlike("^[0-9.]+$")
        fits &= F.right(before, F.lit(2)).rlike("^[0-9][0-9]$") & F.left(name, F.lit(1)).rlike("^[A-Z]$") & (F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789&-", "") == "")
        strike = F.nullif(F.substring(figures, digits + 1, F.length(figures)), F.lit(""))
        return F.when(fits, F.struct(F.right(before, F.lit(2)).try_cast("int").alias("day"), month.alias("month"), F.left(figures, digits).alias("year"), strike.alias("strike"), right.alias("right")))

    return F.get(F.filter(F.transform(F.array(*map(F.lit, MONTHS)), dated), lambda x: x.isNotNull()), F.lit(0))


def is_derivative(name: Column) -> Column:
    """Whether any word of a row's name is a contract symbol (its right may stand apart) or an instrument code."""
    words = F.split(F.upper(F.coalesce(name, F.lit(""))), r"[^A-Z0-9&.-]+")
    dated = F.exists(words, lambda w: contract(w)["day"].isNotNull())
    coded = F.exists(F.flatten(F.transform(words, lambda w: F.split(w, "[-&.]"))), lambda w: w.isin(*(a + b for a in KINDS for b in UNDERLYINGS)))
    return dated | coded


def trade_date(text: Column) -> Column:
    """The first date on a line that says trade date, as written; empty without one."""
    return F.regexp_extract(text, r"(?im)^.*trade date.*?(\d{2}[-/]\d{2}[-/]\d{4}|\d{4}[-/]\d{2}[-/]\d{2})", 1)


def report_rows(notes: DataFrame, note: str = "note", text: str = "text") -> DataFrame:
    """(note, pos, trade_date, side, name, qty, price, brokerage, amount, balance) of transaction reports: text is cut
    where a dated row begins; dividends and rows that lack a figure are left out. A null text has no rows."""
    flat = F.trim(F.regexp_replace(F.col(text), r"\s+", " "))
    piece = notes.select(F.col(note).alias("note"), F.posexplode(F.split(flat, rf"(?={ROW_START})")).alias("pos", "piece"))
    # A flat text has no line ends, so they can part what one match of a row found.
    found = F.split(F.regexp_replace("piece", ROW + ".*", "\n".join(f"${i}" for i in range(1, 9))), "\n")
    rows = piece.filter(F.col("piece").rlike(ROW)).select("note", "pos", found.alias("found"))
    at = lambda i: F.get("found", F.lit(i - 1))
    numbers = {"qty": 4, "price": 5, "brokerage": 6, "amount": 7, "balance": 8}
    return rows.select("note", "pos", parse_date(at(1)).alias("trade_date"), at(2).alias("side"), at(3).alias("name"), *(parse_number(at(i)).alias(n) for n, i in numbers.items()))


def derivative_tax(text: Column) -> Column:
    """The sum of the last figures of a tax annexure's derivative rows: numbered lines whose security has an instrument
    code in parentheses. A row that ends in something else adds nothing."""
    fields = lambda line: F.split(F.trim(line), r"\s+")
    codes = [f"({a}{b}-" for a in KINDS for b in UNDERLYINGS if b != "IVX"]
    numbered = lambda f: F.get(f, F.lit(0)).rlike("^[0-9]+$") & (F.size(f) > 2)
    coded = lambda f: F.exists(F.array(*map(F.lit, codes)), lambda c: F.instr(F.upper(F.get(f, F.lit(1))), c) > 0)
    rows = F.filter(F.transform(F.split(text, "\n"), fields), lambda f: numbered(f) & coded(f))
    return half_up(F.aggregate(F.transform(rows, lambda f: F.abs(parse_number(F.element_at(f, -1)))), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))))
