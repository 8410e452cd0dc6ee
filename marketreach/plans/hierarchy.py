"""Activity hierarchy: from saved JSON, or from outline text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketreach.operators.outline import merge_editions, parse_outline
from marketreach.session import tune
from marketreach.sources.exports import write_table
from marketreach.sources.hierarchy_json import flatten_hierarchy, read_hierarchy


def run_hierarchy(spark: SparkSession, json_path: str, output: str) -> dict[str, str]:
    """Flat hierarchy as Parquet and as CSV."""
    tune(spark)
    table = write_table(flatten_hierarchy(read_hierarchy(spark, json_path)), f"{output}/hierarquia")
    csv = f"{output}/hierarquia_csv"
    spark.read.parquet(table).write.mode("overwrite").csv(csv, header=True, escape='"', emptyValue="")
    return {"tabela": table, "csv": csv}


def outline_database(lines: DataFrame) -> DataFrame:
    """Records of several editions (`doc, line_no, line, edition`), the last edition winning."""
    editions = lines.select("doc", "edition").distinct()
    records = parse_outline(lines).join(editions, "doc")
    return merge_editions(records, "edition").drop("line_no", "doc", "edition")


def run_outline(spark: SparkSession, lines: DataFrame, output: str) -> str:
    tune(spark)
    return write_table(outline_database(lines.withColumn("edition", F.col("edition").cast("int"))), output)
