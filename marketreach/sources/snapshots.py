"""Versioned snapshots of a labelled table: immutable Parquet folders and a log of commit records.

A version exists once its record does. The record is one JSON file whose name is the number; it is
created whole and only if the name is free, so of two savers that want a number one gets it and the
other takes the next, and a save that fails leaves data that no record names.

Rows lie in parts by a hash of the row id. A record keeps, per part, the rows, the distinct ids and a
64-bit digest of (id, label), so that the comparison of two versions reads only parts that differ.
"""

from __future__ import annotations

import json
import os
import uuid
from datetime import UTC, datetime
from urllib.parse import quote

from py4j.java_gateway import Py4JJavaError

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABEL = "segmentacao"
PARTS = 64
PART = "_version_part"
META = T.StructType(
    [
        T.StructField("project", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("label", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("rows_changed", T.LongType()),
        T.StructField("col_map", T.MapType(T.StringType(), T.StringType())),
        T.StructField("changes", T.ArrayType(T.StringType())),
    ]
)
DIGEST = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("rows", T.LongType()),
        T.StructField("ids", T.LongType()),
        T.StructField("digest", T.LongType()),
    ]
)
RECORD = T.StructType(
    [
        *META.fields,
        T.StructField("path", T.StringType()),
        T.StructField("schema", T.StringType()),
        T.StructField("row_id", T.StringType()),
        T.StructField("label_column", T.StringType()),
        T.StructField("n_parts", T.IntegerType()),
        T.StructField("parts", T.ArrayType(DIGEST)),
    ]
)


def log_path(root: str, project: str | None = None) -> str:
    """Folder of the commit records, of one project or of all; any project name is safe in it."""
    return f"{root}/log" if project is None else f"{root}/log/p-{quote(project, safe='')}"


def _records(spark: SparkSession, root: str, project: str | None = None) -> DataFrame:
    """Commit records; empty when nothing was saved yet."""
    try:
        reader = spark.read.schema(RECORD).option("recursiveFileLookup", "true")
        return reader.json(log_path(root, project))
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RECORD)


def _record(spark: SparkSession, root: str, project: str, version: int) -> Row:
    found = _records(spark, root, project).where(F.col("version") == version).first()
    if found is None:
        raise LookupError(f"project {project!r} has no version {version}")
    return found


def _read(spark: SparkSession, record: Row) -> DataFrame:
    """Rows of a record with their part."""
    schema = T.StructType.fromJson(json.loads(record["schema"])).add(PART, T.IntegerType())
    return spark.read.schema(schema).parquet(record["path"])


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole text unless the name is taken; tells which of the two it was.

    A draft is written first and then given the name: by a hard link on a local file system, else
    by a rename that refuses to replace, which the file system must do as one step (HDFS does).
    """
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(conf)
    target = system.makeQualified(target)
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    stream = system.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        if system.getScheme() == "file":
            os.link(draft.toUri().getPath(), target.toUri().getPath())
        else:
            kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
            context.rename(draft, target, spark._sc._gateway.new_array(kind, 0))
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as problem:
        if "FileAlreadyExistsException" not in problem.java_exception.getClass().getName():
            raise
        return False
    finally:
        system.delete(draft, False)


def metadata(spark: SparkSession, root: str) -> DataFrame:
    """Metadata of every version; empty when nothing was saved yet."""
    return _records(spark, root).select(*META.names)


def load_version(spark: SparkSession, root: str, project: str, version: int) -> DataFrame:
    """Rows of a committed version."""
    return _read(spark, _record(spark, root, project, version)).drop(PART)


def list_versions(spark: SparkSession, root: str, project: str) -> DataFrame:
    """Versions of a project, newest first."""
    return _records(spark, root, project).select(*META.names).orderBy(F.desc("version"))


def next_version(spark: SparkSession, root: str, project: str) -> int:
    """Last version + 1, or 0."""
    return _records(spark, root, project).agg(F.coalesce(F.max("version") + 1, F.lit(0)).alias("n")).first()["n"]


def list_projects(meta: DataFrame) -> DataFrame:
    """One row per project with its first and last version, newest project first."""
    return (
        meta.groupBy("project")
        .agg(
            F.min_by("source_file", "version").alias("source_file"),
            F.count(F.lit(1)).alias("n_versions"),
            F.max("version").alias("latest_version"),
            F.max_by("label", "version").alias("latest_label"),
            F.max_by("created_at", "version").alias("latest_at"),
            F.min_by("created_at", "version").alias("created_at"),
        )
        .orderBy(F.desc("created_at"), "project")
    )


def changed_rows(new: DataFrame, old: DataFrame, row_id: str, label: str = LABEL) -> DataFrame:
    """One row: how many ids carry another label than before (NULL-safe)."""
    before = old.select(row_id, F.col(label).alias("_before"))
    pairs = new.select(row_id, F.col(label).alias("_after")).join(before, row_id)
    differs = ~F.col("_after").eqNullSafe(F.col("_before"))
    return pairs.agg(F.count_if(differs).alias("rows_changed"))


def with_label_column(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Adds an empty label column when there is none."""
    return df if label in df.columns else df.withColumn(label, F.lit(None).cast("string"))


def label_last(df: DataFrame, label: str = LABEL) -> DataFrame:
    """The label column, if any, moved to the end."""
    rest = [c for c in df.columns if c != label]
    return df.select(*rest, *([label] if label in df.columns else []))


def _digests(saved: DataFrame, row_id: str, label: str) -> list[dict]:
    """Rows, distinct ids and digest of each part; as many rows as there are parts."""
    value = F.col(label) if label in saved.columns else F.lit(None).cast("string")
    own = saved.groupBy(PART, F.col(row_id).alias("_id")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.bit_xor(F.xxhash64(F.col(row_id), value, value.isNull())).alias("_digest"),
    )
    parts = own.groupBy(PART).agg(
        F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("ids"), F.bit_xor("_digest").alias("digest")
    )
    return [r.asDict() for r in parts.withColumnRenamed(PART, "part").collect()]


def _compared(new: Row, old: Row, row_id: str, label: str) -> list[int] | None:
    """Parts that can hold an id whose label changed; None when all rows have to be read.

    Equal digests only tell that nothing changed where no id repeats: rows of a repeated id pair up.
    """

    def layout(record: Row) -> tuple:
        fields = {f.name: f.dataType for f in T.StructType.fromJson(json.loads(record["schema"]))}
        return record["n_parts"], record["row_id"], record["label_column"], fields.get(row_id)

    if layout(new) != layout(old) or (new["row_id"], new["label_column"]) != (row_id, label):
        return None
    before = {p["part"]: p for p in old["parts"]}
    pairs = [(p, before[p["part"]]) for p in new["parts"] if p["part"] in before]

    def equal(a: Row, b: Row) -> bool:
        return a["digest"] == b["digest"] and a["rows"] == a["ids"] == b["rows"] == b["ids"]

    return [a["part"] for a, b in pairs if not equal(a, b)]


def _changed(spark: SparkSession, new: Row, old: Row, row_id: str, label: str) -> DataFrame:
    after, before = _read(spark, new), _read(spark, old)
    wanted = _compared(new, old, row_id, label)
    if wanted is not None:
        after, before = (side.where(F.col(PART).isin(wanted)) for side in (after, before))
    return changed_rows(after, before, row_id, label)


def changed_between(
    spark: SparkSession, root: str, project: str, new: int, old: int, row_id: str, label: str = LABEL
) -> DataFrame:
    """`changed_rows` of two saved versions, read only where their digests differ."""
    records = [_record(spark, root, project, version) for version in (new, old)]
    return _changed(spark, *records, row_id, label)


def save_version(
    df: DataFrame,
    root: str,
    project: str,
    description: str,
    row_id: str,
    source_file: str = "",
    col_map: dict[str, str] | None = None,
    changes: list[str] | None = None,
    previous: int | None = None,
    label: str = LABEL,
    parts: int = PARTS,
) -> int:
    """Write the rows, then commit them as the next version; returns its number.

    A version is never overwritten. Until the record exists nobody sees the rows; a save that fails
    uses up no number. Versions are compared part by part if they were saved with the same `parts`
    and row id, else as a whole.
    """
    if PART in df.columns:
        raise ValueError(f"column {PART} is taken")
    spark = df.sparkSession
    rows = label_last(df, label)
    path = f"{root}/data/{uuid.uuid4().hex}"
    placed = rows.withColumn(PART, F.pmod(F.xxhash64(row_id), F.lit(parts)).cast("int"))
    writer = placed.hint("rebalance", PART).write.partitionBy(PART).option("compression", "snappy")
    writer.parquet(path)

    layout = {"path": path, "schema": rows.schema.json(), "row_id": row_id, "label_column": label, "n_parts": parts}
    digests = _digests(_read(spark, Row(**layout)), row_id, label)
    record = layout | {
        "project": project,
        "label": description,
        "source_file": source_file,
        "rows": sum(part["rows"] for part in digests),
        "rows_changed": 0,
        "col_map": col_map or {},
        "changes": changes,
        "parts": digests,
    }
    if previous is not None and label in rows.columns:
        old = _record(spark, root, project, previous)
        if label in _read(spark, old).columns:
            found = _changed(spark, Row(**record), old, row_id, label)
            record["rows_changed"] = found.first()["rows_changed"]

    version = next_version(spark, root, project)
    while True:
        record |= {"version": version, "created_at": datetime.now(UTC).isoformat()}
        if create_once(spark, f"{log_path(root, project)}/{version:010d}.json", json.dumps(record)):
            return version
        version += 1
