"""Overlap rule: two company segments and one activity, regions, labels, next version."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketreach.functions.numeric import decimal_comma
from marketreach.operators import segments
from marketreach.operators.joins import own_exchange, with_id
from marketreach.session import tune
from marketreach.sources.snapshots import LABEL, save_version, with_label_column


def candidate_codes(
    rows: DataFrame,
    key: str,
    company: str,
    segment: str,
    first: tuple[str, Sequence],
    second: tuple[str, Sequence] | None = None,
    base: DataFrame | None = None,
) -> DataFrame:
    """Top five activities of one or two company segments.

    The activity comes from the table itself, or from the register when it has none.
    """

    def codes(name: str, chosen: Sequence) -> DataFrame:
        part = rows.where(segments.segment_rows(company, name, segment, chosen))
        if "cnae_principal" in rows.columns:
            return segments.top_codes(part, key)
        ids = with_id(part, key, "cnpj").select("cnpj")
        return segments.top_codes_of_ids(ids, base, "cnpj", 5)

    top = codes(*first)
    return segments.merge_tops(top, codes(*second)) if second else top


def overlap(
    rows: DataFrame,
    key: str,
    company: str,
    segment: str,
    first: tuple[str, Sequence],
    second: tuple[str, Sequence] | None,
    code: str,
    value: str | None = None,
    base: DataFrame | None = None,
) -> DataFrame:
    """Memberships of every id in the three sets."""
    in_a = segments.segment_rows(company, first[0], segment, first[1])
    in_b = segments.segment_rows(company, second[0], segment, second[1]) if second else F.lit(False)
    work = rows
    if "cnae_principal" in rows.columns:
        in_c = F.col("cnae_principal") == code
    else:
        work = with_id(rows, key)
        ids = segments.ids_with_code(work.select(F.col("_id").alias("cnpj")), base, code)
        hits = ids.select(F.col("cnpj").alias("_id"), F.lit(True).alias("_c"))
        work = work.join(own_exchange(hits), "_id", "left")
        in_c = F.col("_c")
    amount = decimal_comma(F.col(value)) if value else None
    return segments.membership(work, key, in_a, in_b, in_c, amount)


def run_segmentation(
    spark: SparkSession,
    rows: DataFrame,
    members: DataFrame,
    key: str,
    labels: Mapping[int, str],
    root: str,
    project: str,
    description: str,
    row_id: str,
    overwrite: bool = False,
    previous: int | None = None,
) -> int:
    """Label the regions in one pass and save the result as the next version."""
    tune(spark)
    text = F.lit(None).cast("string")
    for region, label in labels.items():
        text = F.when(F.col("regiao") == region, label.strip()).otherwise(text)
    wanted = members.select(key, text.alias("rotulo")).where(F.col("rotulo").isNotNull())
    labelled = segments.apply_labels(with_label_column(rows), wanted, key, overwrite, LABEL)
    return save_version(labelled, root, project, description, row_id, previous=previous)
