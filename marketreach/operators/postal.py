"""Postal codes: statistics, representatives, prefix cache, coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketreach import layouts as L
from marketreach.functions.text import cep_prefix, clean_cep
from marketreach.operators.joins import keep_one, own_exchange, without_matching

_NEWEST = ["timestamp", "cep_usado"]


def cep_counts(rows: DataFrame, cep: str = "cep") -> DataFrame:
    """Rows per valid 8-digit code."""
    valid = rows.select(clean_cep(F.col(cep)).alias("cep8")).where(F.col("cep8").isNotNull())
    return valid.groupBy("cep8").agg(F.count(F.lit(1)).alias("n"))


def cep_stats(rows: DataFrame, cep: str = "cep") -> DataFrame:
    """Valid codes and distinct prefixes."""
    prefixes = (
        cep_counts(rows, cep)
        .groupBy(F.substring("cep8", 1, 5).alias("cep5"))
        .agg(F.sum("n").alias("n"))
    )
    return prefixes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("ceps_validos"),
        F.count(F.lit(1)).alias("prefixos"),
    )


def frequent_cep(rows: DataFrame, cep: str = "cep") -> DataFrame:
    """Most frequent code of each prefix, the smallest of equally frequent ones."""
    counts = cep_counts(rows, cep)
    return counts.groupBy(F.substring("cep8", 1, 5).alias("cep5")).agg(
        F.min_by("cep8", F.struct((-F.col("n")).alias("n"), "cep8")).alias("cep_usado"),
        F.sum("n").alias("n"),
    )


def any_cep(rows: DataFrame, cep: str = "cep") -> DataFrame:
    """One code per prefix."""
    code = clean_cep(F.col(cep))
    valid = rows.select(code.alias("cep8")).where(F.col("cep8").isNotNull())
    return valid.groupBy(F.substring("cep8", 1, 5).alias("cep5")).agg(
        F.min("cep8").alias("cep_usado")
    )


def resolved(cache: DataFrame) -> DataFrame:
    """Cache rows that need no new lookup; errors are tried again."""
    return cache.where(F.col("status").isin(L.RESOLVED))


def pending(representatives: DataFrame, cache: DataFrame) -> DataFrame:
    """Prefixes without a resolved cache row."""
    return without_matching(representatives, resolved(cache), "cep5")


def upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Newest row per prefix."""
    rows = cache.unionByName(fresh.select(*cache.columns))
    rest = [c for c in rows.columns if c not in ("cep5", *_NEWEST)]
    order = [F.struct(*_NEWEST, *rest)]
    picked = rows.groupBy("cep5").agg(F.max_by(F.struct(*rows.columns[1:]), *order).alias("_row"))
    return picked.select("cep5", "_row.*").select(*cache.columns)


def wanted_rows(cache: DataFrame, representatives: DataFrame) -> DataFrame:
    """Resolved cache rows of the wanted prefixes."""
    columns = ["cep5", "lat", "lon", "localidade", "uf", "status"]
    rows = resolved(cache).join(representatives.select("cep5"), "cep5", "left_semi")
    return keep_one(rows.select(*columns), ["cep5"], [F.col(c) for c in columns[1:]])


def lookup_stats(representatives: DataFrame, cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Wanted prefixes found in the cache, newly resolved, newly not found."""
    known = resolved(cache).select("cep5", F.lit(True).alias("_hit")).distinct()
    new = fresh.groupBy("cep5").agg(F.max(F.col("status") == "ok").alias("_ok"))
    joined = representatives.select("cep5").join(known, "cep5", "left").join(new, "cep5", "left")
    missing = F.col("_hit").isNull()
    return joined.agg(
        F.count_if(~missing).alias("cache_hits"),
        F.count_if(missing & F.coalesce("_ok", F.lit(False))).alias("novos_ok"),
        F.count_if(missing & F.col("_ok").isNotNull() & ~F.col("_ok")).alias("novos_nao_encontrados"),
    )


def attach_prefix_coordinates(rows: DataFrame, cache: DataFrame, cep: str = "cep") -> DataFrame:
    """`lat_microregiao`/`lon_microregiao` by prefix, and `lat`/`lon` with fallback to the place."""
    points = cache.where(F.col("lat").isNotNull()).groupBy("cep5").agg(
        F.min(F.struct("lat", "lon")).alias("_p")
    ).select(
        F.col("cep5").alias("_cep5"),
        F.col("_p.lat").alias("lat_microregiao"),
        F.col("_p.lon").alias("lon_microregiao"),
    )
    base = rows.drop("lat_microregiao", "lon_microregiao", "lat", "lon", "cep5")
    joined = base.withColumn("_cep5", cep_prefix(F.col(cep))).join(own_exchange(points), "_cep5", "left")
    joined = joined.drop("_cep5")
    for c in ("lat", "lon"):
        choices = [F.col(f"{c}_microregiao")]
        if f"{c}_municipio" in rows.columns:
            choices.append(F.col(f"{c}_municipio"))
        joined = joined.withColumn(c, F.coalesce(*choices))
    return joined
