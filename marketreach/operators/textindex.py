"""Text search through postings of three-letter pieces.

Names are normalised and indexed once per distinct name. A piece starts at every letter; two end marks
fill the last ones, so a keyword of one or two letters is the start of a piece. Postings are ordered by
piece, and a search reads only the row groups that hold pieces of its keywords: names with every piece of
a keyword are candidates, which are then compared with it on the text. All keywords take one pass. A
frequent piece is spread over files and tasks by the name's id.

Ids are 64-bit hashes. Names that share one are candidates together and told apart by their texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketreach.functions.text import norm_keyword, norm_text
from marketreach.operators.joins import own_exchange
from marketreach.session import shared_folder

WIDTH = 3
END = "$" * (WIDTH - 1)  # no letter of a normalised text


@dataclass(frozen=True)
class TextIndex:
    """Distinct normalised names (name_id, name) and their pieces (piece, name_id)."""

    names: DataFrame
    postings: DataFrame


def load_index(spark: SparkSession, folder: str) -> TextIndex:
    """Index that `build_index` wrote into a folder."""
    return TextIndex(spark.read.parquet(f"{folder}/names"), spark.read.parquet(f"{folder}/postings"))


def build_index(rows: DataFrame, text: Column, folder: str | None = None) -> TextIndex:
    """Index of the distinct texts of a column, written to a shared folder; NULL and blank ones match nothing."""
    spark = rows.sparkSession
    folder = folder or f"{shared_folder(spark)}/text-index/{uuid.uuid4().hex}"
    names = rows.select(norm_text(text).alias("name")).where(F.length("name") > 0).distinct()
    names.select(F.xxhash64("name").alias("name_id"), "name").write.parquet(f"{folder}/names")
    pieces = F.regexp_extract_all(F.concat("name", F.lit(END)), F.lit(f"(?=({'.' * WIDTH}))"), F.lit(1))
    postings = spark.read.parquet(f"{folder}/names").select(
        F.explode(F.array_distinct(pieces)).alias("piece"), "name_id"
    )
    ordered = postings.repartitionByRange("piece", "name_id").sortWithinPartitions("piece", "name_id")
    ordered.write.parquet(f"{folder}/postings")
    return load_index(spark, folder)


def search_index(index: TextIndex, keywords: Iterable[str]) -> DataFrame:
    """(keyword, name): normalised keywords and the names that hold them; empty keywords match nothing."""
    spark = index.names.sparkSession
    needles = sorted({k for k in map(norm_keyword, keywords) if k})
    long = [k for k in needles if len(k) >= WIDTH]
    found = spark.createDataFrame([], "keyword string, name_id bigint")
    if long:
        wanted = [(k, p) for k in long for p in sorted({k[i : i + WIDTH] for i in range(len(k) - WIDTH + 1)})]
        number = {k: sum(1 for other, _ in wanted if other == k) for k in long}
        asked = spark.createDataFrame([(k, p, number[k]) for k, p in wanted], "keyword string, piece string, n int")
        held = index.postings.where(F.col("piece").isin(sorted({p for _, p in wanted}))).join(asked, "piece")
        all_held = held.groupBy("keyword", "name_id", "n").agg(F.count(F.lit(1)).alias("held")).where("held >= n")
        found = all_held.select("keyword", "name_id")
    for short in (k for k in needles if len(k) < WIDTH):
        starts = index.postings.where(F.col("piece").startswith(short))
        found = found.unionByName(starts.select(F.lit(short).alias("keyword"), "name_id"))
    texts = found.distinct().join(index.names, "name_id").where(F.contains("name", "keyword"))
    return texts.select("keyword", "name").distinct()


def rows_with_keywords(rows: DataFrame, text: Column, index: TextIndex, keywords: Iterable[str]) -> DataFrame:
    """Rows whose text holds a keyword, once per keyword, which is added as `palavra`."""
    found = search_index(index, keywords).select(F.col("keyword").alias("palavra"), F.col("name").alias("_name"))
    return rows.withColumn("_name", norm_text(text)).join(own_exchange(found), "_name").drop("_name")


def drop_indexed_keywords(market: DataFrame, index: TextIndex, keywords: Iterable[str]) -> DataFrame:
    """Unserved rows whose trade name holds a keyword are removed; the names come from an index of them."""
    found = own_exchange(search_index(index, keywords).select(F.col("name").alias("_found")).distinct())
    unserved = ~F.coalesce(F.col("cliente_atendido"), F.lit(False))
    rows = market.withColumn("_name", norm_text(F.col("nome_fantasia")))
    return rows.join(found, (F.col("_name") == F.col("_found")) & unserved, "left_anti").drop("_name")
