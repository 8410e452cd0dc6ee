"""Customer list to focus table, and focus table with postal coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketreach.operators.focus import filter_classes, mark_company, mark_served, matched_rows
from marketreach.operators.joins import attach_place
from marketreach.operators.postal import (
    any_cep,
    attach_prefix_coordinates,
    pending,
    upsert,
    wanted_rows,
)
from marketreach.operators.ranking import class_cutoff
from marketreach.operators.uploads import enrich, per_customer
from marketreach.session import tune
from marketreach.sources.exports import write_table


def selected_classes(upload: DataFrame, base: DataFrame, key: str, value: str) -> DataFrame:
    """Classes that hold 95 % of the customers or of the value."""
    rows = matched_rows(enrich(upload, base, key), value)
    return class_cutoff(rows, value).where("selecionada").select("classe")


def focus_table(
    base: DataFrame,
    customers: DataFrame,
    classes: Sequence[str] | DataFrame,
    centroids: DataFrame | None = None,
) -> DataFrame:
    """Class filter, served marks and coordinates as one plan."""
    foco = mark_company(mark_served(filter_classes(base, classes), customers))
    if centroids is None:
        return foco
    placed = attach_place(foco, centroids, "lat_municipio", "lon_municipio")
    return placed.withColumns({"lat": F.col("lat_municipio"), "lon": F.col("lon_municipio")})


def run_focus(
    spark: SparkSession,
    base: DataFrame,
    upload: DataFrame,
    key: str,
    value: str,
    class_columns: Sequence[str],
    row_order: str,
    output: str,
    classes: Sequence[str] | DataFrame | None = None,
    centroids: DataFrame | None = None,
) -> str:
    """Write the focus table once. Classes default to the 95 % cut-off of the upload."""
    tune(spark)
    chosen = selected_classes(upload, base, key, value) if classes is None else classes
    customers = per_customer(upload, key, value, class_columns, row_order)
    return write_table(focus_table(base, customers, chosen, centroids), output)


def run_pending(spark: SparkSession, foco: DataFrame, cache: DataFrame, output: str, cep: str = "cep") -> str:
    """Write the prefixes that still need coordinates, with a code to look each up by."""
    tune(spark)
    return write_table(pending(any_cep(foco, cep), cache), output)


def run_coordinates(
    spark: SparkSession,
    foco: DataFrame,
    cache: DataFrame,
    fresh: DataFrame,
    output: str,
    cache_output: str,
    cep: str = "cep",
) -> dict[str, str]:
    """Merge newly resolved prefixes into the cache and apply it; both go to sibling paths."""
    tune(spark)
    write_table(upsert(cache, fresh), cache_output)
    merged = spark.read.parquet(cache_output)
    points = wanted_rows(merged, any_cep(foco, cep))
    return {
        "cache": cache_output,
        "foco": write_table(attach_prefix_coordinates(foco, points, cep), output),
    }
