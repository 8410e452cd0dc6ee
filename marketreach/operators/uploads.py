"""Customer list against the register: enrichment, pivot, per-customer aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketreach import layouts as L
from marketreach.functions.numeric import decimal_comma
from marketreach.functions.text import split_codes
from marketreach.operators.joins import key_filter, own_exchange, with_id


def _listed(base: DataFrame, ids: DataFrame) -> DataFrame:
    """Register rows that may be on the customer list (`_id`); the others do not reach the join."""
    return base.where(key_filter(ids, "_id")(F.col("cnpj")))


def enrich(upload: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Upload LEFT register on the normalised id (`_id`); register columns win name conflicts."""
    rows = with_id(upload.drop(*[c for c in L.ENRICHMENT if c in upload.columns]), key)
    brought = [c for c in L.ENRICHMENT if c in base.columns]
    side = _listed(base, rows).select(F.col("cnpj").alias("_id"), *brought)
    return rows.join(side, "_id", "left")


def enrich_all(upload: DataFrame, base: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """Upload LEFT all register columns; user columns win, `VALOR_TOTAL` is the sum per id."""
    rows = with_id(upload, key)
    if value in rows.columns:
        rows = rows.withColumn(value, decimal_comma(F.col(f"`{value}`")))
    side = _listed(base, rows).withColumnRenamed("cnpj", "_id")
    side = side.drop(*[c for c in side.columns if c in rows.columns and c != "_id"])
    out = rows.join(side, "_id", "left")
    if value in rows.columns:
        totals = rows.groupBy("_id").agg(
            F.coalesce(F.sum(f"`{value}`"), F.lit(0.0)).alias("VALOR_TOTAL")
        )
        out = out.join(own_exchange(totals), "_id", "left")
    return out.drop("_id")


MOST_SEGMENTS = 1000  # columns per value; a longer list of segments is a table, not columns


def segment_values(upload: DataFrame, segment: str, most: int = MOST_SEGMENTS) -> list:
    """Sorted segment values, which become columns; more than `most` are refused (see `segment_totals`)."""
    values = upload.select(segment).where(F.col(segment).isNotNull()).distinct().orderBy(segment)
    found = values.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"column {segment} has more than {most} values: use segment_totals")
    return [r[0] for r in found]


def segment_totals(upload: DataFrame, key: str, segment: str, value: str) -> DataFrame:
    """`_id, segment, n, value`: the pivot as a long table, for any number of segments."""
    rows = with_id(upload, key).withColumn(value, decimal_comma(F.col(f"`{value}`")))
    rows = rows.where(F.col(segment).isNotNull() & F.col("_id").isNotNull())
    return rows.groupBy("_id", segment).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).alias(value)
    )


def enrich_pivot(
    upload: DataFrame,
    base: DataFrame,
    key: str,
    segment: str,
    value: str,
    row_order: str,
    segments: Sequence | None = None,
) -> DataFrame:
    """One row per id with `{column}_{segment}` columns, then all register columns.

    The value is summed, other columns take their first known value in row order; the segment
    column itself becomes `{segment}_{value}`. `VALOR_TOTAL` adds the pivoted values: with an explicit
    list of `segments`, rows of other segments are in no column and not in the total.
    """
    segments = segment_values(upload, segment) if segments is None else list(segments)
    rows = with_id(upload, key).withColumn(value, decimal_comma(F.col(f"`{value}`")))
    rows = rows.where(F.col(segment).isNotNull() & F.col("_id").isNotNull())
    others = [c for c in upload.columns if c not in (key, segment, row_order)]
    aggregates = []
    for seg in segments:
        here = F.col(segment) == seg
        for c in others:
            cell = F.when(here, F.col(f"`{c}`"))
            if c == value:
                total = F.coalesce(F.sum(cell), F.lit(0.0))
                agg = F.when(F.count_if(here) > 0, total)
            else:
                agg = F.min_by(cell, F.when(cell.isNotNull(), F.col(row_order)))
            aggregates.append(agg.alias(f"{c}_{seg}"))
        aggregates.append(F.max(F.when(here, F.col(segment))).alias(f"{segment}_{seg}"))
    wide = rows.groupBy("_id").agg(*aggregates)

    side = _listed(base, rows).withColumnRenamed("cnpj", "_id")
    side = side.drop(*[c for c in side.columns if c in wide.columns and c != "_id"])
    out = wide.join(side, "_id", "left")
    total = sum((F.coalesce(F.col(f"`{value}_{s}`"), F.lit(0.0)) for s in segments), F.lit(0.0))
    return out.withColumn("VALOR_TOTAL", total).withColumnRenamed("_id", key)


def per_customer(
    upload: DataFrame, key: str, value: str, classes: Sequence[str], row_order: str
) -> DataFrame:
    """Summed value and first known class values per id, marked as served; no id, no customer."""
    rows = with_id(upload, key).where(F.col("_id").isNotNull())
    amount = decimal_comma(F.col(f"`{value}`"))
    firsts = [
        F.min_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col(row_order))).alias(c)
        for c in classes
    ]
    return rows.groupBy(F.col("_id").alias("cnpj")).agg(
        F.coalesce(F.sum(amount), F.lit(0.0)).alias("relevancia_valor"),
        *firsts,
        F.lit(True).alias("cliente_atendido"),
    )


def match_rate(enriched: DataFrame, column: str = "cnae_principal") -> DataFrame:
    """Matched rows, all rows and percent matched."""
    found = F.count_if(F.col(column).isNotNull())
    rows = F.count(F.lit(1))
    return enriched.agg(
        found.alias("encontrados"),
        rows.alias("linhas"),
        F.when(rows == 0, 0.0).otherwise(F.bround(found / rows * 100, 1)).alias("pct"),
    )


def duplicates(upload: DataFrame, key: str) -> DataFrame:
    """Rows with an id against distinct ids."""
    ids = with_id(upload, key).where(F.col("_id").isNotNull())
    per_id = ids.groupBy("_id").agg(F.count(F.lit(1)).alias("_n"))
    return per_id.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("linhas"),
        F.count(F.lit(1)).alias("distintos"),
        (F.coalesce(F.sum("_n"), F.lit(0)) > F.count(F.lit(1))).alias("tem_repetidos"),
    )


def code_frequency(rows: DataFrame, codes: str = "cnaes_secundarios") -> DataFrame:
    """Occurrences of every code of a delimited list column."""
    each = rows.select(F.explode(split_codes(F.col(codes))).alias("cnae"))
    return each.groupBy("cnae").agg(F.count(F.lit(1)).alias("ocorrencias"))


def code_totals(rows: DataFrame, code: str, value: str) -> DataFrame:
    """Rows and summed value per code, in one aggregation."""
    return rows.where(F.col(code).isNotNull()).groupBy(code).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("valor")
    )
