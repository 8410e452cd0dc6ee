"""Session settings and the one place that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Files of a partitioned table that a task writes side by side; for more it sorts its rows first.
OPEN_FILES = 8
# Settings the library relies on. Partition counts and memory are left to whoever submits the job.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where a later operator would reuse the join's partitioning
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES),
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the library's runtime settings to a session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int = 8, app: str = "marketreach") -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`, or a temporary one in local mode."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="marketreach-"))
    return context.getCheckpointDir()


def stage(df: DataFrame, **options: str) -> DataFrame:
    """Write a table once to the shared folder and read it back; `options` are those of the writer.

    Cuts the lineage of a relation that is used several times, survives lost executors, and gives
    the optimizer its real size and its columns separately.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stages/{uuid.uuid4().hex}"
    df.write.options(compression="snappy", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
