"""Three customer sets: exclusive regions, labels, bulk labelling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketreach.functions.numeric import decimal_comma, percent
from marketreach.operators.counts import distinct_ids, top
from marketreach.operators.joins import only_matching, own_exchange
from marketreach.operators.ranking import top_per_key
from marketreach.sources.snapshots import LABEL


def segment_rows(company: str, name: str, segment: str, segments: Sequence) -> Column:
    """Membership of one company's segments."""
    hit = (F.col(company) == name) & F.col(segment).isin(list(segments))
    return F.coalesce(hit, F.lit(False))


def ids_with_code(ids: DataFrame, base: DataFrame, code: str, key: str = "cnpj") -> DataFrame:
    """The given ids whose register activity is `code`."""
    rows = only_matching(base.where(F.col("cnae_principal") == code), ids, key)
    return rows.select(key).distinct()


def membership(
    rows: DataFrame, key: str, in_a: Column, in_b: Column, in_c: Column, value: Column | None = None
) -> DataFrame:
    """One row per id: three memberships, summed value over all its rows, region 0..7.

    Region bits: 1 = A, 2 = B, 4 = C.
    """
    amount = F.lit(0.0) if value is None else F.coalesce(value.cast("double"), F.lit(0.0))
    flags = rows.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max(F.coalesce(in_a, F.lit(False))).alias("a"),
        F.max(F.coalesce(in_b, F.lit(False))).alias("b"),
        F.max(F.coalesce(in_c, F.lit(False))).alias("c"),
        F.sum(amount).alias("valor"),
    )
    region = sum(
        (F.when(F.col(n), bit).otherwise(0) for n, bit in (("a", 1), ("b", 2), ("c", 4))), F.lit(0)
    )
    return flags.withColumn("regiao", region)


def region_counts(members: DataFrame) -> DataFrame:
    """Ids and value of the seven exclusive regions, empty ones included."""
    spark = members.sparkSession
    every = spark.range(1, 8).select(F.col("id").cast("int").alias("regiao"))
    found = members.where(F.col("regiao") > 0).groupBy("regiao").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("valor").alias("_v")
    )
    return every.join(F.broadcast(found), "regiao", "left").select(
        "regiao",
        F.coalesce("_n", F.lit(0)).alias("n"),
        F.coalesce("_v", F.lit(0.0)).alias("valor"),
    )


def set_sizes(members: DataFrame) -> DataFrame:
    """Ids in each of the three sets."""
    return members.agg(*[F.count_if(F.col(c)).alias(f"tamanho_{c}") for c in "abc"])


def region_label(region: Column, names: Sequence[str], limit: int = 25) -> Column:
    """`A ∩ B` of the sets that hold the region."""
    return F.concat_ws(
        " ∩ ",
        *[F.when(region.bitwiseAND(1 << i) != 0, n[:limit]) for i, n in enumerate(names)],
    )


def excluded_label(region: Column, names: Sequence[str], limit: int = 25) -> Column:
    """`¬C` of the sets that do not."""
    return F.concat_ws(
        ", ",
        *[F.when(region.bitwiseAND(1 << i) == 0, "¬" + n[:limit]) for i, n in enumerate(names)],
    )


def region_listing(members: DataFrame, names: Sequence[str]) -> DataFrame:
    """Non-empty regions with their labels, largest first."""
    counts = region_counts(members).where(F.col("n") > 0)
    return counts.select(
        "regiao",
        region_label(F.col("regiao"), names).alias("nome"),
        excluded_label(F.col("regiao"), names).alias("exclui"),
        "n",
        "valor",
    ).orderBy(F.desc("n"), "regiao")


def region_rows(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Original rows with the region of their id."""
    inside = members.where(F.col("regiao") > 0).select(key, "regiao")
    return rows.join(own_exchange(inside), key)


def region_top(
    rows: DataFrame, members: DataFrame, key: str, value: Column, tie: list[str], k: int = 10
) -> DataFrame:
    """The k rows of highest value of every region; a value that is no number counts as 0."""
    valued = region_rows(rows, members, key).withColumn("_v", F.coalesce(value, F.lit(0.0)))
    order = [F.desc("_v"), *[F.asc(t) for t in tie]]
    return top_per_key(valued, ["regiao"], order, k).drop("_v")


def pick_list(rows: DataFrame, key: str, value: str, limit: int = 500) -> DataFrame:
    """Candidates for hand picking: the rows of highest value, at most `limit`."""
    amount = F.coalesce(decimal_comma(F.col(value)), F.lit(0.0))
    return rows.orderBy(F.desc(amount), key).limit(limit)


def top_codes(rows: DataFrame, key: str = "cnpj", k: int = 5) -> DataFrame:
    """Most frequent activity codes by distinct id."""
    known = rows.where(F.col("cnae_principal").isNotNull())
    per_id = known.where(F.col(key).isNotNull()).groupBy("cnae_principal", key).agg(
        F.min("cnae_principal_desc").alias("_d")
    )
    counts = per_id.groupBy("cnae_principal").agg(
        F.min("_d").alias("cnae_principal_desc"), F.count(F.lit(1)).alias("n_cnpjs")
    )
    return top(counts, "n_cnpjs", "cnae_principal", k)


def top_codes_of_ids(ids: DataFrame, base: DataFrame, key: str = "cnpj", k: int = 10) -> DataFrame:
    """Most frequent register activities of an id set."""
    rows = only_matching(base, ids, key)
    return top_codes(rows, key, k)


def merge_tops(first: DataFrame, second: DataFrame, k: int = 5) -> DataFrame:
    """Sum of two truncated top lists; an id present in both counts twice."""
    both = first.unionByName(second).groupBy("cnae_principal").agg(
        F.min("cnae_principal_desc").alias("cnae_principal_desc"), F.sum("n_cnpjs").alias("n_cnpjs")
    )
    return top(both, "n_cnpjs", "cnae_principal", k)


def apply_labels(
    rows: DataFrame, labels: DataFrame, key: str, overwrite: bool = False, label: str = LABEL
) -> DataFrame:
    """Set the label of the rows whose id is listed in `labels` (`key`, `rotulo`).

    Rows that already have a label keep it unless `overwrite`.
    """
    base = rows if label in rows.columns else rows.withColumn(label, F.lit(None).cast("string"))
    new = labels.groupBy(key).agg(F.min("rotulo").alias("_new"))
    joined = base.join(own_exchange(new), key, "left")
    free = F.lit(True) if overwrite else F.col(label).isNull()
    chosen = F.when(F.col("_new").isNotNull() & free, F.col("_new")).otherwise(F.col(label))
    return joined.withColumn(label, chosen).drop("_new").select(*base.columns)


def label_region(
    rows: DataFrame, members: DataFrame, key: str, region: int, text: str, overwrite: bool = False
) -> DataFrame:
    """Label every row of one region."""
    ids = members.where(F.col("regiao") == region).select(key, F.lit(text.strip()).alias("rotulo"))
    return apply_labels(rows, ids, key, overwrite)


def label_distribution(rows: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows per label, unlabelled included, with percent."""
    counts = rows.groupBy(F.col(label).alias("rotulo")).agg(F.count(F.lit(1)).alias("qtd"))
    every = Window.orderBy("rotulo").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = F.sum("qtd").over(every)
    return counts.withColumn("pct", percent(F.col("qtd"), whole)).orderBy(
        F.desc("qtd"), F.asc_nulls_last("rotulo")
    )


def segment_size(rows: DataFrame, mask: Column, key: str = "cnpj") -> DataFrame:
    """Distinct ids of a masked set."""
    return distinct_ids(rows.where(mask), [], key, "n_cnpjs")
