"""Sinks: Parquet tables and spreadsheet-friendly CSV."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(
    df: DataFrame, path: str, mode: str = "overwrite", partition_by: str | None = None
) -> str:
    """Snappy Parquet. `mode="ignore"` keeps an existing stage.

    With `partition_by`, rows are rebalanced on the column first: a value that holds a large
    share of the rows is split over several tasks, small ones share a file.
    """
    out = df
    if partition_by:
        out = df.hint("rebalance", F.col(partition_by))
    writer = out.write.mode(mode).option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return path


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a folder exists, so that `write_table` with `mode="ignore"` would keep it."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def _plain_decimal(c: Column) -> Column:
    """Text of a double without exponent in the range where readers expect plain digits."""
    wide = F.regexp_replace(c.cast("decimal(38,18)").cast("string"), r"0+$", "")
    wide = F.when(F.endswith(wide, F.lit(".")), F.concat(wide, F.lit("0"))).otherwise(wide)
    size = F.abs(c)
    plain = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3))
    return F.when(plain, wide).otherwise(c.cast("string"))


def export_columns(df: DataFrame) -> list[Column]:
    """Columns as spreadsheet text: decimal comma, `True`/`False`, ISO dates."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.replace(_plain_decimal(c.cast("double")), F.lit("."), F.lit(","))
        elif isinstance(f.dataType, T.BooleanType):
            c = F.when(c, "True").when(~c, "False")
        elif isinstance(f.dataType, T.TimestampType):
            day = F.date_format(c, "yyyy-MM-dd")
            c = F.when(c == F.date_trunc("day", c), day).otherwise(
                F.date_format(c, "yyyy-MM-dd HH:mm:ss")
            )
        out.append(c.alias(f.name))
    return out


def write_csv(df: DataFrame, path: str, sep: str = ";", mode: str = "overwrite") -> str:
    """CSV with header, `;` separator and decimal comma, one part file per task."""
    (
        df.select(*export_columns(df))
        .write.mode(mode)
        .csv(path, sep=sep, header=True, escape='"', emptyValue="", encoding="UTF-8")
    )
    return path


def preview(df: DataFrame, rows: int = 500) -> DataFrame:
    """First rows of a table."""
    return df.limit(rows)


def table_size(df: DataFrame) -> DataFrame:
    """Row and column count as one row."""
    return df.agg(F.count(F.lit(1)).alias("linhas")).withColumn("colunas", F.lit(len(df.columns)))


def keep_existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])
