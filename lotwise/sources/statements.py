"""Statements as CSV files, read by what the header of each file says: any order of columns, further columns, lines
above the header, and folders of files whose headers differ."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.functions.values import is_rights_name, isin_ok, norm_name, parse_date, parse_number
from lotwise.session import written

#: What columns are called, in upper case and letters only; the first cell of a header that has one of the
#: names counts, and a name that ends in * may go on.
NAMES = ("NAME", "SECURITY", "SCRIP", "STOCK", "COMPANY", "COMPANYNAME", "ASSETNAME", "SCRIPNAME", "SECURITYNAME")
HOLDING = {"name": ("NAME", "SECURITY", "SCRIP", "STOCK", "COMPANY", "ASSETNAME"), "sector": ("SECTOR", "INDUSTRY"), "qty": ("QTY", "QUANTITY", "SHARES", "BALQTY"), "invested": ("AMOUNTINVESTED*", "INVESTED", "INVESTEDVALUE", "INVESTEDAMOUNT", "COST")}
TRANSACTION = {
    "date": ("DATE", "TRADEDATE", "TRANSDATE"),
    "type": ("TRANSTYPE", "TYPE", "TRANSACTIONTYPE", "TXNTYPE"),
    "name": ("ASSETNAME", "NAME", "SECURITY", "SCRIP", "STOCK"),
    "qty": ("QTY", "QUANTITY", "SHARES"),
    "price": ("PRICE", "RATE"),
    "amount": ("AMOUNT", "VALUE", "NETAMOUNT"),
    "balance": ("BALQTY", "BALANCE", "BALANCEQTY", "CLOSINGQTY"),
}
PERIOD = {
    "name": ("COMPANYNAME", "COMPANY", "SECURITY", "SCRIP", "STOCK", "SCRIPNAME", "ASSETNAME"),
    "date": ("DATE", "PURCHASEDATE", "BUYDATE", "ACQDATE", "ACQUISITIONDATE"),
    "qty": ("QTY", "QUANTITY", "SHARES"),
    "price": ("PURCHASEPRICE", "BUYPRICE", "RATE", "AVGPRICE"),
    "amount": ("PURCHASEAMOUNT", "PURCHASEVALUE", "BUYAMOUNT", "COST", "COSTBASIS", "INVESTEDVALUE"),
}
TRADES = {
    "type": ("TYPE", "TRANSTYPE", "TRANSACTIONTYPE", "TXNTYPE", "TRADETYPE"),
    "date": ("DATE", "TRADEDATE", "TRANSDATE", "TRANSACTIONDATE"),
    "qty": ("QUANTITY", "QTY", "SHARES", "UNITS"),
    "price": ("PRICE", "RATE", "PRICEPERSHARE"),
    "balance": ("TOTALQUANTITY", "BALQTY", "BALANCE", "CLOSINGQTY"),
    "name": NAMES,
    "isin": ("ISIN", "ISINCODE", "BSENSECODEISIN", "BSENSECODE", "CODE"),
    "turnover": ("TOTALAMOUNTTURNOVER", "TURNOVER", "TOTALTURNOVER"),
}
SCREENER = {"isin": ("ISINCODE", "ISIN"), "name": NAMES, "price": ("CURRENTPRICE*", "PRICE", "LTP", "CMP*"), "bse": ("BSECODE", "BSE"), "nse": ("NSECODE", "NSE", "NSESYMBOL", "SYMBOL"), "industry": ("INDUSTRY*", "SECTOR*")}
END_OF_DAY = {"code": ("SCCODE", "SYMBOL", "TCKRSYMB", "FININSTRMID"), "isin": ("ISIN", "ISINCODE"), "series": ("SERIES", "SCTYSRS"), "close": ("CLOSE", "CLSPRIC", "CLOSEPRICE")}
#: Lines with anything on them among which a header is looked for.
HEAD_LINES = 8


def letters(cell: str | None) -> str:
    return "".join(c for c in (cell or "").upper() if "A" <= c <= "Z")


def placed(cells: list[str], columns: dict[str, tuple[str, ...]], required: tuple[str | tuple[str, ...], ...]) -> dict[str, int] | None:
    """Where a header line has each column, the first cell that any of its names fits; None if it lacks one of
    ``required``, of which a tuple asks for one of several."""
    fits = lambda cell, name: cell.startswith(name[:-1]) if name.endswith("*") else cell == name
    first = {column: next((i for i, c in enumerate(cells) if any(fits(c, n) for n in names)), None) for column, names in columns.items()}
    found = {column: i for column, i in first.items() if i is not None}
    return found if all(any(x in found for x in ((c,) if isinstance(c, str) else c)) for c in required) else None


def headers(lines: DataFrame, columns: dict[str, tuple[str, ...]], required: tuple[str | tuple[str, ...], ...]) -> DataFrame:
    """(file, at: column -> cell, width, header, above: the lines over it) for each file of ``lines`` (file, block,
    line); at is null where none of the first HEAD_LINES lines is a header."""
    w = Window.partitionBy("file").orderBy("id")
    heads = lines.filter("block = 0").withColumn("id", F.monotonically_increasing_id()).withColumn("no", F.row_number().over(w)).filter(F.col("no") <= HEAD_LINES)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("at", pa.map_(pa.string(), pa.int32())), ("width", pa.int32()), ("header", pa.string()), ("above", pa.list_(pa.string()))])
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                out = {"file": row["file"], "at": None, "width": 0, "header": None, "above": []}
                for i, line in enumerate(own := [x["line"] for x in row["lines"]]):
                    cells = next(csv.reader([line]), [])
                    if (at := placed([letters(c) for c in cells], columns, required)) is not None:
                        out |= {"at": list(at.items()), "width": len(cells), "header": line, "above": own[:i]}
                        break
                rows.append(out)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    few = heads.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("no", "line"))).alias("lines"))
    return few.mapInArrow(find, "file string, at map<string,int>, width int, header string, above array<string>")


def read_columns(spark: SparkSession, path: str, columns: dict[str, tuple[str, ...]], required: tuple[str | tuple[str, ...], ...]) -> DataFrame:
    """The columns of a statement file, or of a folder of them, as text, null where a file has none. Each file is read by
    its own header; the header and the lines above it give no rows, nor do blank lines. A file with lines of which none is
    a header with all that is required is an error; an empty file has no rows. A row is one line."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    lines = text.filter(F.trim("line") != "")
    known = written(headers(lines, columns, required), "headers")
    if lost := [r["file"] for r in known.filter("at is null").select("file").limit(5).collect()]:
        raise ValueError(f"no header with {required} in the first {HEAD_LINES} lines of {', '.join(lost)}")
    width = known.agg(F.max("width")).first()[0] or 1
    options = {"escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "maxColumns": str(max(20480, 4 * width))}
    rows = lines.join(known.select("file", "at", "header", "above"), "file")
    top = (F.col("block") == 0) & F.array_contains("above", F.col("line"))
    rows = rows.filter((F.col("line") != F.col("header")) & ~top)
    rows = rows.select("at", F.from_csv("line", ", ".join(f"c{i} string" for i in range(width)), options).alias("c"))
    cells = F.array(*(F.col(f"c.c{i}") for i in range(width)))
    rows = rows.select("at", cells.alias("cells"))
    return once(rows, {c: F.get("cells", F.try_element_at("at", F.lit(c))) for c in columns})


def once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``columns`` of ``rows``, each worked out once a row: as a generator makes them, Spark does not copy their
    expressions into the filters and columns that use them."""
    return rows.select(F.inline(F.array(F.struct(*(x.alias(c) for c, x in columns.items())))))


def number(text: Column) -> Column:
    """A number; null for blanks, words and infinities."""
    return F.when(~F.lower(text).contains("inf"), parse_number(text))


def read_holding_statement(spark: SparkSession, path: str) -> DataFrame:
    """(name, sector, qty, invested): holdings above zero; what cost nothing that can be read cost nothing."""
    r = read_columns(spark, path, HOLDING, ("name", "qty", "invested"))
    rows = r.select(F.trim("name").alias("name"), F.coalesce(F.trim("sector"), F.lit("")).alias("sector"), number(F.col("qty")).alias("qty"), F.coalesce(number(F.col("invested")), F.lit(0.0)).alias("invested"))
    return rows.filter((F.col("name") != "") & (F.col("qty") > 0) & ~is_rights_name(F.col("name")))


def read_transaction_statement(spark: SparkSession, path: str) -> DataFrame:
    """(day, type, name, qty, price, amount, balance); rows without a name or a type, and rights, are left out."""
    r = read_columns(spark, path, TRANSACTION, ("date", "type", "name"))
    rows = r.select(parse_date(F.trim("date")).alias("day"), F.trim("type").alias("type"), F.trim("name").alias("name"), *(F.coalesce(number(F.col(c)), F.lit(0.0)).alias(c) for c in ("qty", "price", "amount", "balance")))
    return rows.filter((F.col("name") != "") & (F.col("type") != "") & ~is_rights_name(F.col("name")))


def read_holding_period(spark: SparkSession, path: str) -> DataFrame:
    """(name, day, qty, cost_per_share, invested) of lots: the amount paid counts before price times quantity; lots with
    neither are left out."""
    r = read_columns(spark, path, PERIOD, ("name", "date", "qty", ("price", "amount")))
    rows = once(r, {"name": F.trim("name"), "day": F.trim("date"), **{c: number(F.col(c)) for c in ("qty", "amount", "price")}}).withColumn("day", parse_date(F.col("day")))
    rows = rows.filter((F.col("name") != "") & (F.col("qty") > 0) & ~is_rights_name(F.col("name")) & F.coalesce("amount", "price").isNotNull())
    return rows.select("name", "day", "qty", F.coalesce(F.col("amount") / F.col("qty"), F.col("price")).alias("cost_per_share"), F.coalesce(F.col("amount"), F.col("price") * F.col("qty")).alias("invested"))


def is_foreign(row_name: Column, row_isin: Column, name: str, isin: str) -> Column:
    """Whether a row names another security: by ISIN where both are valid, else by name where both are there."""
    given = F.lit(isin.upper())
    both = isin_ok(F.upper(row_isin)) & isin_ok(given)
    named = F.coalesce(row_name, F.lit("")) != ""
    return F.when(both, F.upper(row_isin) != given).when(named & F.lit(bool(name)), norm_name(row_name) != norm_name(F.lit(name))).otherwise(False)


def read_stock_trades(spark: SparkSession, path: str, name: str, isin: str = "", cutoff: str = "2025-03-31") -> tuple[DataFrame, DataFrame]:
    """The trades of one security up to a day, (day, type, qty, price, amount, balance), and one row of counts: kept,
    dropped (later or undated), foreign, amount_rows (turnover given), amount_diverged (off quantity times price)."""
    r = read_columns(spark, path, TRADES, ("type", "date", "qty", "price")).filter(F.trim("type") != "")
    n = {c: F.coalesce(number(F.col(c)), F.lit(0.0)) for c in ("qty", "price", "balance", "turnover")}
    rows = r.select(parse_date(F.trim("date")).alias("day"), F.upper(F.trim("type")).alias("type"), *(x.alias(c) for c, x in n.items()), is_foreign(F.trim("name"), F.trim("isin"), name, isin).alias("foreign"))
    late = F.coalesce(F.col("day") > F.lit(cutoff).cast("date"), F.lit(True))
    state = F.when(F.col("foreign"), "foreign").when(late, "dropped").otherwise("kept")
    rows = rows.withColumn("state", state).withColumn("amount", F.when((F.col("turnover") > 0) & (F.col("qty") > 0), F.col("turnover")).otherwise(0.0))
    kept, given = F.col("state") == "kept", F.col("amount") > 0
    counts = rows.agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("kept", "dropped", "foreign")), F.count_if(kept & given).alias("amount_rows"), F.count_if(kept & given & (F.abs(F.col("amount") - F.col("qty") * F.col("price")) > 0.01)).alias("amount_diverged"))
    return rows.filter(kept).select("day", "type", "qty", "price", "amount", "balance"), counts


def read_screener(spark: SparkSession, path: str) -> DataFrame:
    """(isin, name, price, bse, nse, industry): one row for each valid ISIN, the first of its file."""
    r = read_columns(spark, path, SCREENER, ("isin", "name", "price")).withColumn("__at", F.monotonically_increasing_id())
    rows = r.withColumn("isin", F.upper(F.trim("isin"))).filter(F.col("isin").rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$"))
    first = rows.withColumn("__r", F.row_number().over(Window.partitionBy("isin").orderBy("__at"))).filter("__r = 1")
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return first.select("isin", blank("name").alias("name"), F.coalesce(number(F.col("price")), F.lit(0.0)).alias("price"), blank("bse").alias("bse"), F.upper(blank("nse")).alias("nse"), blank("industry").alias("industry"))


def read_end_of_day(spark: SparkSession, path: str, wanted: DataFrame, series: tuple[str, ...] = ("EQ", "BE", "BZ", "SM", "ST", "A", "B", "T", "X", "XT", "Z", "M", "MT")) -> DataFrame:
    """(key, close) of an exchange's day file for the ``wanted`` codes (key, code); closes above zero, and series of
    shares where the file has any."""
    r = read_columns(spark, path, END_OF_DAY, ("code", "close"))
    share = F.col("series").isNull() | F.upper(F.trim("series")).isin(*series)
    rows = r.filter(share).select(F.upper(F.trim("code")).alias("code"), number(F.col("close")).alias("close")).filter("close > 0")
    return rows.join(wanted.select("key", F.upper("code").alias("code")), "code").groupBy("key").agg(F.max("close").alias("close"))


def unmapped(header: list[str], columns: dict[str, tuple[str, ...]]) -> list[str]:
    """Cells of a header that no column takes, as written."""
    at = placed([letters(c) for c in header], columns, ()) or {}
    return [c for i, c in enumerate(header) if c.strip() and i not in at.values()]
