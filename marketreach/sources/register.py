"""Register extracts: headerless `;` CSV in ISO-8859-1, and the landing folder."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, Observation, SparkSession
from pyspark.sql import functions as F

from marketreach import layouts as L
from marketreach.sources.records import read_records

DROPPED = "_dropped"
ENCODING = "ISO-8859-1"
FORMAT = {"sep": ";", "quote": '"', "escape": '"'}


def _csv(spark: SparkSession, pattern: str) -> DataFrameReader:
    """Reader of register files. Column pruning is off: a pruned parse cannot see a malformed row."""
    return (
        spark.read.options(**FORMAT)
        .option("encoding", ENCODING)
        .option("columnPruning", "false")
        .option("pathGlobFilter", pattern)
    )


def _parsed(spark: SparkSession, folder: str, columns: list[str], pattern: str) -> DataFrame:
    """file, record and row: records that may hold line breaks, with `DROPPED` set in malformed ones."""
    schema = ", ".join(f"`{c}` string" for c in [*columns, DROPPED])
    options = {**FORMAT, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": DROPPED, "columnPruning": "false"}
    found = read_records(spark, folder, pattern, ENCODING)
    # as a generator a record is parsed once: a filter on its fields does not parse it again below
    row = F.explode(F.array(F.from_csv("record", schema, options)))
    return found.select(F.substring_index("file", "/", -1).alias("file"), "record", row.alias("row"))


def read_register(
    spark: SparkSession,
    folder: str,
    columns: list[str],
    pattern: str = "*.csv",
    line_breaks: bool = False,
    dropped: Observation | None = None,
) -> DataFrame:
    """All files of a folder as text columns; rows with too few or too many fields are dropped.

    `malformed` gives the dropped rows. With `line_breaks`, quoted fields may hold line breaks; the
    files are split all the same (`sources.records`), and `dropped` counts the dropped rows as `n`
    while the first action runs.
    """
    if line_breaks:
        rows = _parsed(spark, folder, columns, pattern)
        if dropped is not None:
            rows = rows.observe(dropped, F.count_if(F.col(f"row.{DROPPED}").isNotNull()).alias("n"))
        rows = rows.where(F.col(f"row.{DROPPED}").isNull())
        return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in columns])
    reader = _csv(spark, pattern).schema(L.text_schema(columns))
    return reader.option("mode", "DROPMALFORMED").csv(folder)


def landed_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """`path, arquivo, bytes, alterado` of the files in a folder; the contents are not read."""
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(
        "path", name.alias("arquivo"), F.col("length").alias("bytes"), F.unix_micros("modificationTime").alias("alterado")
    )


def read_files(
    spark: SparkSession, paths: list[str], columns: list[str], line_breaks: bool = False
) -> DataFrame:
    """`read_register` of some files, with the name of each row's file as `arquivo`."""
    if line_breaks:
        rows = _parsed(spark, paths, columns, "*").where(F.col(f"row.{DROPPED}").isNull())
        return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], F.col("file").alias("arquivo"))
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    return read_register(spark, paths, columns, "*").select(*columns, name.alias("arquivo"))


def malformed(
    spark: SparkSession,
    folder: str,
    columns: list[str],
    pattern: str = "*.csv",
    line_breaks: bool = False,
) -> DataFrame:
    """`file, record`: what `read_register` drops from the same files."""
    if line_breaks:
        bad = _parsed(spark, folder, columns, pattern).where(F.col(f"row.{DROPPED}").isNotNull())
        return bad.select("file", "record")
    schema = L.text_schema([*columns, DROPPED])
    reader = _csv(spark, pattern).schema(schema)
    rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", DROPPED).csv(folder)
    # Spark refuses a query that needs nothing but the record, so a field takes part: none is longer
    held = F.length(DROPPED) >= F.length(F.coalesce(columns[0], F.lit("")))
    return rows.where(F.col(DROPPED).isNotNull() & held).select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col(DROPPED).alias("record")
    )


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """`path, name, length` of the files in a folder; the contents are not read."""
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    )
    return listing


def first_file(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """Name of the alphabetically first matching file, or None."""
    try:
        row = list_files(spark, folder, pattern).agg(F.min("name").alias("name")).first()
    except AnalysisException:
        return None
    return row["name"]


def read_lookup(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Two-column code table, both columns trimmed."""
    raw = read_register(spark, folder, L.LOOKUP, pattern)
    return raw.select(*[F.trim(c).alias(c) for c in L.LOOKUP])


def load_lookups(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The code tables present in a folder; an absent one is left out."""
    found = {name: first_file(spark, folder, glob) for name, glob in L.LOOKUP_FILES.items()}
    return {name: read_lookup(spark, folder, f) for name, f in found.items() if f}


def read_simples(spark: SparkSession, folder: str, line_breaks: bool = False) -> DataFrame | None:
    """Small-business regime extract, or None when the folder has none."""
    name = first_file(spark, folder, L.SIMPLES_FILES)
    return read_register(spark, folder, L.SIMPLES, name, line_breaks) if name else None


def inventory(files: DataFrame) -> DataFrame:
    """Landed files (`name`, `length`) by kind: count and bytes."""
    name = F.lower("name")
    kind = reduce(
        lambda rest, g: F.when(F.startswith(name, F.lit(g)), g).otherwise(rest),
        reversed(L.NUMBERED_GROUPS),
        F.lit(L.OTHER_GROUP),
    )
    return files.groupBy(kind.alias("grupo")).agg(
        F.count(F.lit(1)).alias("arquivos"), F.sum("length").alias("bytes")
    )
