"""Counts, distinct counts and grouped sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SERVED = "cliente_atendido"


def flagged_ids(
    df: DataFrame, keys: list[str], id_col: str = "cnpj", served: str = SERVED
) -> DataFrame:
    """Distinct ids per key: `n_total` served + unserved, `n_atendidos`, `n_nao_atendidos`.

    One shuffle on (key, id) instead of one expanded copy of the rows per distinct count; the
    second aggregation only sees one row per id, combined before it moves.
    """
    flag = F.coalesce(F.col(served), F.lit(False))
    per_id = (
        df.where(F.col(id_col).isNotNull())
        .groupBy(*keys, id_col)
        .agg(F.max(flag).alias("_yes"), F.max(~flag).alias("_no"))
    )
    return per_id.groupBy(*keys).agg(
        F.sum(F.col("_yes").cast("long") + F.col("_no").cast("long")).alias("n_total"),
        F.sum(F.col("_yes").cast("long")).alias("n_atendidos"),
        F.sum(F.col("_no").cast("long")).alias("n_nao_atendidos"),
    )


def distinct_ids(df: DataFrame, keys: list[str], id_col: str = "cnpj", alias: str = "n") -> DataFrame:
    """Distinct ids per key in two levels."""
    ids = df.where(F.col(id_col).isNotNull()).select(*keys, id_col).distinct()
    return ids.groupBy(*keys).agg(F.count(F.lit(1)).alias(alias))


def top(df: DataFrame, by: str | list[str], tie: str | list[str], k: int) -> DataFrame:
    """First k rows by a metric descending, ties by name; never sorts the whole table."""
    by = [by] if isinstance(by, str) else by
    tie = [tie] if isinstance(tie, str) else tie
    return df.orderBy(*[F.desc_nulls_last(b) for b in by], *[F.asc(t) for t in tie]).limit(k)


def value_counts(df: DataFrame, column: str | Column, alias: str, count: str = "qtd") -> DataFrame:
    """Rows per value."""
    c = F.col(column) if isinstance(column, str) else column
    return df.groupBy(c.alias(alias)).agg(F.count(F.lit(1)).alias(count))


def coverage(df: DataFrame, cnpj: str = "cnpj", root: str = "cnpj_basico") -> DataFrame:
    """One row of coverage indicators: establishments and companies, total, served, percent.

    The rows collapse once to (root, id); establishments are then counted by id and companies by root,
    so an id under several roots, or beside a row without root, counts once.
    """
    flag = F.coalesce(F.col(SERVED), F.lit(False))
    pairs = df.groupBy(root, cnpj).agg(F.max(flag).alias("_served"))
    sides = F.array(
        F.struct(F.lit(True).alias("_is_id"), F.col(cnpj).cast("string").alias("_key")),
        F.struct(F.lit(False).alias("_is_id"), F.col(root).cast("string").alias("_key")),
    )
    each = pairs.select(F.explode(sides).alias("_s"), "_served").select("_s.*", "_served")
    keys = each.where(F.col("_key").isNotNull()).groupBy("_is_id", "_key").agg(
        F.max("_served").alias("_served")
    )
    is_id = F.col("_is_id")
    totals = keys.agg(
        F.count_if(is_id).alias("cnpjs"),
        F.count_if(is_id & F.col("_served")).alias("cnpjs_atendidos"),
        F.count_if(~is_id).alias("empresas"),
        F.count_if(~is_id & F.col("_served")).alias("empresas_atendidas"),
    )

    def pct(part: str, whole: str) -> Column:
        return F.when(F.col(whole) == 0, 0.0).otherwise(F.col(part) / F.col(whole) * 100)

    return totals.select(
        "cnpjs",
        "cnpjs_atendidos",
        pct("cnpjs_atendidos", "cnpjs").alias("pct_cnpjs"),
        "empresas",
        "empresas_atendidas",
        pct("empresas_atendidas", "empresas").alias("pct_empresas"),
    )
