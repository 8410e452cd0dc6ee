"""Delimited records whose quoted fields hold line breaks, read by many tasks.

A line starts inside a quoted field when the quotes before it in its file are odd. Quotes are counted
per range of a file, as Spark deals it; a running sum over the ranges gives each range's parity at its
start. A range that starts outside and whose lines all hold an even number of quotes is read as it is.
In the others a running parity cuts records within the range, and a record that goes on in the next
range is put together from its lines there. So no file is one task, whatever its size.

Lines end at a line feed; a carriage return before it belongs to the line end, except inside quotes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE = '"'


def numbered_lines(spark: SparkSession, folder: str, pattern: str = "*", encoding: str = "UTF-8") -> DataFrame:
    """file, start (of the range in the file), at (rising within a range), line and odd (its quotes)."""
    raw = spark.read.option("lineSep", "\n").option("pathGlobFilter", pattern).text(folder)
    text = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    # a quote is one byte in every encoding whose line end is one, so the text need not be decoded for it
    quotes = F.octet_length("value") - F.octet_length(F.replace(F.col("value"), F.lit(QUOTE), F.lit("")))
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
        text.alias("line"),
        (quotes % 2 == 1).alias("odd"),
    )


def range_parity(lines: DataFrame) -> DataFrame:
    """file, start, inside (the range starts in a quoted field) and calm (its lines are its records)."""
    per_range = lines.groupBy("file", "start").agg(F.count_if("odd").alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    summed = per_range.withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1)
    return summed.select("file", "start", "inside", (~F.col("inside") & (F.col("n") == 0)).alias("calm"))


def read_records(spark: SparkSession, folder: str, pattern: str = "*", encoding: str = "UTF-8") -> DataFrame:
    """file, start, at (the place of the record's first line) and record; blank lines between records go."""
    lines = numbered_lines(spark, folder, pattern, encoding)
    # one row per range of a file, whatever its lines: without the hint Spark takes it for as large as
    # they are and moves them all
    marked = lines.join(F.broadcast(range_parity(lines)), ["file", "start"])
    calm = marked.where("calm").select("file", "start", "at", F.col("line").alias("record"))

    within = Window.partitionBy("file", "start").orderBy("at")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    mixed = marked.where("NOT calm").withColumn(
        "_in", (F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) + F.col("inside").cast("int")) % 2 == 1
    )
    # a line outside starts a record; one inside goes on with the last record of the range, or of an earlier range
    own = mixed.withColumn("_first", F.max(F.when(~F.col("_in"), F.col("at"))).over(within))
    starts = own.groupBy("file", "start").agg(F.max("_first").alias("_last"))
    carried = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    held = F.when(F.col("_last").isNotNull(), F.struct(F.col("start").alias("s"), F.col("_last").alias("a")))
    open_ = starts.withColumn("_open", F.last(held, ignorenulls=True).over(carried)).select("file", "start", "_open")
    placed = own.join(F.broadcast(open_), ["file", "start"]).withColumn(
        "_key",
        F.when(F.col("_first").isNotNull(), F.struct(F.col("start").alias("s"), F.col("_first").alias("a"))).otherwise(F.col("_open")),
    )
    parts = F.array_sort(F.collect_list(F.struct("start", "at", "line")))
    joined = placed.groupBy("file", "_key").agg(parts.alias("_parts")).select(
        "file", F.col("_key.s").alias("start"), F.col("_key.a").alias("at"), F.array_join("_parts.line", "\n").alias("record")
    )
    ended = F.when(F.contains("record", F.lit("\r")), F.regexp_replace("record", r"\r$", "")).otherwise(F.col("record"))
    joined = joined.sortWithinPartitions("file", "start", "at")  # records put together come as hashes fall
    every = calm.unionByName(joined).withColumn("record", ended)
    return every.where(F.trim("record") != "")
