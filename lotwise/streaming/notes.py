"""Contract notes that import themselves: a stream over a folder of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lotwise.operators import note_charges
from lotwise.operators.merges import bag_difference
from lotwise.sources import note_layouts
from lotwise.sources.notes import is_derivative, sender
from lotwise.session import written

#: Senders whose files have the text layout and the HTML layout.
TEXT_SENDERS, HTML_SENDERS = ("axis",), ("integrated",)
TRADE = ["trade_date", "name", "isin", "side", "qty", "price", "turnover", "stt", "charges", "total"]
#: What makes two trades the same, whichever file they come from.
SAME = ["client", "trade_date", "name", "isin", "side", "qty", "price"]


def client_of(path: Column) -> Column:
    """A client code in a file's name: a letter and three figures or more that stand alone between signs."""
    parts = F.split(F.element_at(F.split(path, "/"), -1), r"[_\-\s.]+")
    return F.upper(F.get(F.filter(parts, lambda p: p.rlike("^[A-Za-z][0-9]{3,}$")), F.lit(0)))


def read_notes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trades, log) of ``files`` (file, text). trades: (file, client, TRADE columns) without derivatives. log: (file,
    sender, note, trades, dropped, verdict), a row for each note; a file of a sender without a layout here, or without
    trades, has one row that says so. Notes with derivatives are audited again without them."""
    told = written(files.withColumn("sender", sender(F.col("text"))), "files")
    text = told.filter(F.col("sender").isin(*TEXT_SENDERS))
    rows, heads, scrips = note_layouts.text_notes(text)
    by = ["file", "note"]
    printed = written(note_charges.by_printed(rows, heads, by), "trades")
    kept = printed.filter(~is_derivative(F.col("name")))
    audit = note_charges.audited(kept, heads, scrips, by).select("file", F.col("number").alias("note"), "verdict", F.col("note").alias("n"))
    counts = printed.groupBy(*by).agg(F.count_if(~is_derivative(F.col("name"))).alias("trades"), F.count_if(is_derivative(F.col("name"))).alias("dropped")).withColumnRenamed("note", "n")
    text_log = counts.join(audit, ["file", "n"], "left").select("file", "note", "trades", "dropped", F.coalesce("verdict", F.lit("Derivatives only")).alias("verdict"))
    text_trades = kept.join(heads.select(*by, "client"), by).select("file", "client", *TRADE)

    html = told.filter(F.col("sender").isin(*HTML_SENDERS)).withColumnRenamed("file", "note")
    cells, sums = note_layouts.html_notes(html, "note", "text")
    rated = written(note_charges.by_rates(cells, sums, ["note"]), "trades")
    shares = rated.filter(~is_derivative(F.col("name"))).select(F.col("note").alias("file"), F.lit(None).cast("string").alias("client"), *TRADE)
    html_log = rated.groupBy(F.col("note").alias("file")).agg(F.count_if(~is_derivative(F.col("name"))).alias("trades"), F.count_if(is_derivative(F.col("name"))).alias("dropped"))
    html_log = html_log.select("file", F.lit(None).cast("string").alias("note"), "trades", "dropped", F.when(F.col("trades") > 0, "PASSED").otherwise("Derivatives only").alias("verdict"))
    log = text_log.unionByName(html_log)
    known = F.col("sender").isin(*TEXT_SENDERS, *HTML_SENDERS)
    log = told.select("file", "sender", known.alias("known")).join(log, "file", "left")
    log = log.select("file", "sender", "note", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("trades", "dropped")), F.coalesce("verdict", F.when(F.col("known"), "No trades").otherwise("No layout")).alias("verdict"))
    trades = text_trades.unionByName(shares)
    return trades.withColumn("client", F.coalesce("client", client_of(F.col("file")))), log


def note_stream(spark: SparkSession, folder: str, target: str, checkpoint: str, files: int | None = None) -> StreamingQuery:
    """Import the notes of ``folder`` that are new: trades go to ``target``/trades by date, in a folder for each batch, a
    log to ``target``/log. A run over files that were there before adds nothing; neither does a note that comes again
    under another name, as trades are held against those of the same dates only. A batch that runs twice leaves one
    set."""

    def write(rows: DataFrame, number: int) -> None:
        trades, log = read_notes(rows)
        trades = written(trades, "notes")
        here, session = f"{target}/trades", rows.sparkSession
        days = [r[0] for r in trades.select("trade_date").distinct().limit(1000).collect()]
        if number:
            schema = session.createDataFrame([], trades.schema).withColumn("batch", F.lit(0).cast("bigint")).schema
            have = session.read.schema(schema).parquet(here).filter(f"batch <> {number}")
            near = F.col("trade_date").isin(*days) if len(days) < 1000 else F.lit(True)  # the partitions that are read
            trades = bag_difference(trades, have.filter(near | F.col("trade_date").isNull()), SAME, ["file"])
        trades.write.mode("overwrite").partitionBy("trade_date").parquet(f"{here}/batch={number}")
        log.write.mode("overwrite").parquet(f"{target}/log/batch={number}")

    reader = spark.readStream.format("text").option("wholetext", True)
    texts = (reader.option("maxFilesPerTrigger", files) if files else reader).load(folder)
    rows = texts.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
