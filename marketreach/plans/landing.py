"""Incremental landing: a refresh parses new extract files and rebuilds the roots near theirs only.

Every refresh writes folders of its own (a batch, `lote`) and then one commit record with the files it
took and the root ranges it rebuilt. Readers take, per file and per range, the batch that the records
name last, so nothing written is changed later, a refresh that fails is invisible, and readers see a
refresh as a whole or not at all. A root range is the first three digits of a company root: roots are
given out in order, so that a month's new companies lie in few ranges. Other roots share one range.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketreach import layouts as L
from marketreach.functions.text import pad_code
from marketreach.plans.register import companies, establishments, simples_regime, wide_table
from marketreach.session import OPEN_FILES, tune
from marketreach.sources.register import landed_files, load_lookups, read_files, read_simples
from marketreach.sources.snapshots import create_once

RANGE, FILE, BATCH = "faixa", "arquivo", "lote"
OTHER_ROOTS = "outros"
FIRMS, PLACES, TABLES = "empresas", "estabelecimentos", "tabelas"
COLUMNS = {FIRMS: L.COMPANIES, PLACES: L.ESTABLISHMENTS}
TAKEN = T.StructType(
    [
        T.StructField("tabela", T.StringType()),
        T.StructField(FILE, T.StringType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("alterado", T.LongType()),
    ]
)
RECORD = T.StructType(
    [
        T.StructField("rodada", T.IntegerType()),
        T.StructField(BATCH, T.StringType()),
        T.StructField("arquivos", T.ArrayType(TAKEN)),
        T.StructField("faixas", T.ArrayType(T.StringType())),
        T.StructField("schema", T.StringType()),
    ]
)


def root_range(root: Column) -> Column:
    """Range of a padded company root; a null or odd root is in the range of the others."""
    return F.when(root.rlike("^[0-9]{8}$"), F.left(root, F.lit(3))).otherwise(OTHER_ROOTS)


def refreshes(spark: SparkSession, output: str) -> DataFrame:
    """Commit records: rodada, lote, the files taken, the ranges rebuilt and the schema of the result."""
    try:
        return spark.read.schema(RECORD).json(f"{output}/log")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RECORD)


def ledger(spark: SparkSession, output: str) -> DataFrame:
    """Newest state of each file taken: tabela, arquivo, bytes, alterado, lote."""
    rows = refreshes(spark, output).select("rodada", BATCH, F.explode("arquivos").alias("a"))
    kept = rows.groupBy("a.tabela", f"a.{FILE}").agg(F.max_by(F.struct("a.bytes", "a.alterado", BATCH), "rodada").alias("_s"))
    return kept.select("tabela", FILE, "_s.*")


def pending_files(spark: SparkSession, output: str, folders: dict[str, str]) -> DataFrame:
    """tabela, path and state of files that are new, or whose size or time is not the one taken.

    A folder that does not exist holds no files.
    """
    here = spark.createDataFrame([], TAKEN).withColumn("path", F.lit(""))
    for table, folder in folders.items():
        try:
            found = landed_files(spark, folder)
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        here = here.unionByName(found.withColumn("tabela", F.lit(table)))
    return here.join(ledger(spark, output).drop(BATCH), TAKEN.names, "left_anti")


def _stage(spark: SparkSession, output: str, table: str, batches: dict[str, str]) -> DataFrame:
    """Raw rows of the files of a table, each from its batch."""
    schema = L.text_schema(COLUMNS[table])
    if not batches:
        return spark.createDataFrame([], schema)
    places = T.StructType([*schema.fields, T.StructField(BATCH, T.StringType()), T.StructField(FILE, T.StringType())])
    rows = spark.read.schema(places).parquet(f"{output}/bruto/{table}")
    wanted = [f"{batch}/{name}" for name, batch in batches.items()]
    return rows.where(F.concat_ws("/", BATCH, FILE).isin(wanted)).select(*COLUMNS[table])


def _raw_range() -> Column:
    return root_range(pad_code(F.col("cnpj_basico"), 8))


def _placed(wide: DataFrame, n_ranges: int) -> DataFrame:
    """Rows with their range, as they are written: of few ranges a task writes few files, so they need not move."""
    rows = wide.withColumn(RANGE, root_range(F.col("cnpj_basico")))
    return rows if n_ranges <= OPEN_FILES else rows.hint("rebalance", RANGE)


def refresh(
    spark: SparkSession,
    companies_dir: str,
    establishments_dir: str,
    lookups_dir: str,
    output: str,
    only_active: bool = True,
    dedupe: bool = False,
    line_breaks: bool = False,
) -> int | None:
    """Take the files that landed or changed since the last refresh; returns its number, None without any.

    The result equals the wide table of the register job over all files taken. A file that is replaced
    takes its old rows along; one that vanishes keeps its rows. A changed code table rebuilds every
    range, from the rows parsed earlier. Of two refreshes at once one fails and leaves no trace.
    """
    tune(spark)
    found = pending_files(spark, output, {FIRMS: companies_dir, PLACES: establishments_dir, TABLES: lookups_dir}).collect()
    if not found:
        return None
    taken = ledger(spark, output).collect()
    number = len(refreshes(spark, output).select("rodada").collect())
    batch = uuid.uuid4().hex

    touched, current = [], {}
    for table, columns in COLUMNS.items():
        before = {r[FILE]: r[BATCH] for r in taken if r["tabela"] == table}
        news = {r[FILE]: r["path"] for r in found if r["tabela"] == table}
        current[table] = before | dict.fromkeys(news, batch)
        if news:
            rows = read_files(spark, sorted(news.values()), columns, line_breaks)
            rows.write.partitionBy(FILE).option("compression", "snappy").parquet(f"{output}/bruto/{table}/{BATCH}={batch}")
            replaced = {name: before[name] for name in news if name in before}
            touched += [_stage(spark, output, table, part) for part in ({n: batch for n in news}, replaced) if part]
    every = any(r["tabela"] == TABLES for r in found)
    stages = {table: _stage(spark, output, table, batches) for table, batches in current.items()}
    if every:
        touched = list(stages.values())
    ranges: set[str] = set()  # a thousand and one at most
    for rows in touched:
        ranges |= {r[RANGE] for r in rows.select(_raw_range().alias(RANGE)).distinct().collect()}

    lookups = load_lookups(spark, lookups_dir)
    simples = read_simples(spark, lookups_dir, line_breaks)
    regime = simples_regime(simples) if simples is not None else None
    own = {table: rows.where(_raw_range().isin(sorted(ranges))) for table, rows in stages.items()}
    if regime is not None and not every:
        regime = regime.where(root_range(F.col("cnpj_basico")).isin(sorted(ranges)))
    wide = wide_table(
        establishments(own[PLACES], only_active), companies(own[FIRMS], lookups), lookups, regime, dedupe=dedupe
    )
    _placed(wide, len(ranges)).write.partitionBy(RANGE).option("compression", "snappy").parquet(f"{output}/base/{BATCH}={batch}")

    record = {
        "rodada": number,
        BATCH: batch,
        "arquivos": [{name: r[name] for name in TAKEN.names} for r in found],
        "faixas": sorted(ranges),
        "schema": wide.schema.json(),
    }
    if not create_once(spark, f"{output}/log/{number:010d}.json", json.dumps(record)):
        raise RuntimeError(f"another refresh took number {number}: run again")
    return number


def read_wide(spark: SparkSession, output: str) -> DataFrame:
    """The wide table as of the last refresh, with `faixa`; each range from the batch that rebuilt it last."""
    records = refreshes(spark, output).orderBy("rodada").collect()
    if not records:
        raise LookupError(f"nothing landed in {output}")
    latest = {name: r[BATCH] for r in records for name in r["faixas"]}
    schema = T.StructType.fromJson(json.loads(records[-1]["schema"]))
    schema = schema.add(BATCH, T.StringType()).add(RANGE, T.StringType())
    rows = spark.read.schema(schema).parquet(f"{output}/base")
    wanted = [f"{batch}/{name}" for name, batch in latest.items()]
    return rows.where(F.concat_ws("/", BATCH, RANGE).isin(wanted)).drop(BATCH)
