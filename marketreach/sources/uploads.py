"""Customer uploads: delimited text with an unknown separator, or Parquet."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketreach.functions.numeric import decimal_comma
from marketreach.sources.records import read_records
from marketreach.sources.register import list_files

ROW_ORDER = "_row"


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The separator that the header line holds most often outside quotes; a comma if none does."""
    header = spark.read.text(path).where(F.trim("value") != "").first()
    bare = re.sub(r'"[^"]*"', "", header["value"]) if header else ""
    return max(",;\t|", key=bare.count)


def holds_parquet(spark: SparkSession, path: str) -> bool:
    """Whether a file, or a file in a folder, is named as Parquet."""
    return not list_files(spark, path, "*.parquet").isEmpty()


def read_upload(
    spark: SparkSession,
    path: str,
    row_order: bool = False,
    fmt: str | None = None,
    line_breaks: bool = False,
) -> DataFrame:
    """Upload as text columns; `row_order` adds the reading order as column `_row`.

    `fmt` is `csv` or `parquet`, by default what the file names say. With `line_breaks`, quoted
    fields may hold line breaks; the files are split all the same (`sources.records`), and each has a header.
    """
    if (fmt or ("parquet" if holds_parquet(spark, path) else "csv")) == "parquet":
        df = spark.read.parquet(path)
    elif line_breaks:
        return _with_line_breaks(spark, path, row_order)
    else:
        df = spark.read.csv(path, header=True, sep=sniff_separator(spark, path), inferSchema=False, escape='"')
    return df.withColumn(ROW_ORDER, F.monotonically_increasing_id()) if row_order else df


def _with_line_breaks(spark: SparkSession, path: str, row_order: bool) -> DataFrame:
    """Upload whose quoted fields may hold line breaks; the header of the first file names the columns."""
    options = {"sep": sniff_separator(spark, path), "quote": '"', "escape": '"'}
    found = read_records(spark, path)
    heads = found.groupBy("file").agg(F.min(F.struct("start", "at")).alias("head"))
    first = found.orderBy("file", "start", "at").select("record").first()
    if first is None:
        return spark.read.csv(path, header=True)
    header = spark.createDataFrame([(first["record"],)], "record string")
    width = F.size(F.split("record", re.escape(options["sep"])))
    most = header.select(width).first()[0]
    cells = F.from_csv("record", ", ".join(f"c{i} string" for i in range(most)), options)
    names = [n for n in header.select(cells.alias("r")).select("r.*").first() if n is not None]
    rows = found.join(F.broadcast(heads), "file").where(F.struct("start", "at") != F.col("head"))
    schema = ", ".join(f"`{n}` string" for n in names)
    row = rows.select("file", "start", "at", F.from_csv("record", schema, options).alias("row"))
    # the place of a record in its file orders it; files follow each other by name
    files = Window.orderBy("file")
    number = heads.select("file", (F.row_number().over(files) - 1).cast("long").alias("_f"))  # one row per file
    if not row_order:
        return row.select("row.*")
    order = (F.col("_f") * (1 << 50) + F.col("at")).alias(ROW_ORDER)
    return row.join(F.broadcast(number), "file").select("row.*", order)


def guess_key_column(columns: list[str]) -> str:
    """First column whose name holds `cnpj`, else the first column."""
    return next((c for c in columns if re.search("cnpj", c, re.IGNORECASE)), columns[0])


def numeric_shares(df: DataFrame) -> DataFrame:
    """`column, share`: share of rows of each column that read as a number, in one pass."""
    shares = df.agg(
        *[
            F.avg(F.when(decimal_comma(F.col(f"`{c}`")).isNotNull(), 1.0).otherwise(0.0)).alias(c)
            for c in df.columns
        ]
    )
    return shares.unpivot([], df.columns, "column", "share")


def guess_value_column(df: DataFrame, key: str) -> str:
    """First non-key column with more than half numeric values, else the first non-key column."""
    shares = {r["column"]: r["share"] for r in numeric_shares(df).collect()}
    others = [c for c in df.columns if c != key]
    numeric = [c for c in others if (shares[c] or 0.0) > 0.5]
    return (numeric or others or df.columns)[0]
