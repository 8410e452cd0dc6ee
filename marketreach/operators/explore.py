"""Exploration of the wide table and of the activity hierarchy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketreach import layouts as L
from marketreach.functions.predicates import matches_all, mentions, year_between_or_unknown
from marketreach.functions.text import code_label, described, digits
from marketreach.operators.counts import top, value_counts
from marketreach.operators.joins import keep_one, own_exchange
from marketreach.operators.quantiles import percentiles_by_key
from marketreach.session import stage

LEVELS = ["secao", "divisao", "grupo", "classe", "subclasse"]


def filtered(
    base: DataFrame,
    codes: Sequence[str] = (),
    ufs: Sequence[str] = (),
    sizes: Sequence[str] = (),
    years: tuple[int, int] | None = None,
) -> DataFrame:
    """Rows that meet every given filter; an empty list filters nothing."""
    rows = base.where(matches_all({"cnae_principal": codes, "uf": ufs, "porte_desc": sizes}))
    if years:
        rows = rows.where(year_between_or_unknown(F.col("data_inicio_atividade"), *years))
    return rows


def indicators(rows: DataFrame) -> DataFrame:
    """Rows, states, codes and municipalities.

    The distinct counts run on the distinct combinations, which are few, not on the rows.
    """
    combos = rows.groupBy("uf", "cnae_principal", "municipio_nome").agg(
        F.count(F.lit(1)).alias("_n")
    )
    return combos.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("estabelecimentos"),
        F.count_distinct("uf").alias("ufs"),
        F.count_distinct("cnae_principal").alias("cnaes"),
        F.count_distinct("municipio_nome").alias("municipios"),
    )


def by_uf(rows: DataFrame) -> DataFrame:
    """Rows of every state, the most frequent first."""
    known = rows.where(F.col("uf").isNotNull())
    return value_counts(known, "uf", "uf").orderBy(F.desc("qtd"), "uf")


def by_size(rows: DataFrame) -> DataFrame:
    size = F.coalesce(F.col("porte_desc"), F.lit(L.SIZE_UNKNOWN))
    return value_counts(rows, size, "porte").orderBy(F.desc("qtd"), "porte")


def top_codes(rows: DataFrame, hierarchy: DataFrame | None = None, k: int = 15) -> DataFrame:
    """Most frequent codes with description (hierarchy, else the rows' own, else a dash)."""
    known = rows.where(F.col("cnae_principal").isNotNull())
    own = F.min("cnae_principal_desc") if "cnae_principal_desc" in rows.columns else F.min(F.lit(None))
    counts = known.groupBy(F.col("cnae_principal").alias("cnae")).agg(
        F.count(F.lit(1)).alias("qtd"), own.cast("string").alias("_own")
    )
    best = top(counts, "qtd", "cnae", k)
    known_desc = F.col("_own")
    if hierarchy is not None:
        names = hierarchy.select(F.col("subclasse").alias("cnae"), F.col("subclasse_desc").alias("_h"))
        best = best.join(names, "cnae", "left")
        known_desc = F.coalesce(F.col("_h"), F.col("_own"))
    out = best.withColumn("descricao", described(known_desc, F.lit("—")))
    return out.select(
        "cnae", "descricao", code_label(F.col("cnae"), F.col("descricao")).alias("rotulo"), "qtd"
    ).orderBy(F.desc("qtd"), "cnae")


def openings_by_year(rows: DataFrame, first: int = 1970) -> DataFrame:
    year = F.year("data_inicio_atividade")
    dated = rows.where(F.col("data_inicio_atividade").isNotNull() & (year >= first))
    return value_counts(dated, year, "ano").orderBy("ano")


def capital_rows(rows: DataFrame) -> DataFrame:
    """One row per company with positive capital, trimmed to the inner 90 % of all capitals.

    The company rows are staged, since the limits and every later statistic read them again.
    """
    firms = keep_one(
        rows.select("cnpj_basico", "cnpj", "cnae_principal", "capital_social"),
        ["cnpj_basico"],
        [F.col("cnpj")],
    )
    positive = firms.where(F.col("capital_social") > 0)
    positive = stage(positive)
    limits = percentiles_by_key(positive, [], "capital_social", {"p05": 0.05, "p95": 0.95})
    inner = limits.select(F.struct("p05", "p95")).scalar()
    return positive.where(
        F.col("capital_social").between(inner.getField("p05"), inner.getField("p95"))
    )


def capital_distribution(
    rows: DataFrame, hierarchy: DataFrame | None = None, k: int = 10
) -> DataFrame:
    """Box statistics and mean of capital for the k most frequent codes, and for all of them."""
    trimmed = capital_rows(rows)
    label = F.col("cnae_principal")
    if hierarchy is not None:
        names = hierarchy.select(
            F.col("subclasse").alias("cnae_principal"), F.col("subclasse_desc").alias("_h")
        )
        trimmed = trimmed.join(names, "cnae_principal", "left")
        label = F.substring(F.coalesce("_h", "cnae_principal"), 1, 50)
    labelled = trimmed.select(label.alias("rotulo"), F.col("capital_social").alias("capital"))
    labelled = labelled.where(F.col("rotulo").isNotNull())
    best = top(value_counts(labelled, "rotulo", "rotulo"), "qtd", "rotulo", k).select("rotulo")
    kept = labelled.join(F.broadcast(best), "rotulo", "left_semi")
    groups = kept.select(F.explode(F.array("rotulo", F.lit("TOTAL"))).alias("rotulo"), "capital")
    basic = groups.groupBy("rotulo").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("capital").alias("minimo"),
        F.max("capital").alias("maximo"),
        F.avg("capital").alias("media"),
    )
    quartiles = percentiles_by_key(groups, ["rotulo"], "capital", {"q1": 0.25, "mediana": 0.5, "q3": 0.75})
    return basic.join(quartiles, "rotulo").orderBy("media", "rotulo")


def hierarchy_filter(hierarchy: DataFrame, chosen: Mapping[str, Sequence[str]]) -> DataFrame:
    """Subclasses under the chosen sections, divisions, ...; none when nothing is chosen."""
    if not any(chosen.get(level) for level in LEVELS):
        return hierarchy.where(F.lit(False))
    return hierarchy.where(matches_all({level: chosen.get(level, ()) for level in LEVELS}))


def rows_of_codes(base: DataFrame, subclasses: DataFrame) -> DataFrame:
    """Register rows whose activity is among the subclasses of the code table."""
    codes = subclasses.select(F.col("subclasse").alias("cnae_principal")).distinct()
    return base.join(own_exchange(codes), "cnae_principal", "left_semi")


def search_codes(
    hierarchy: DataFrame, query: str, fields: Sequence[str] = ("subclasse", "subclasse_desc")
) -> DataFrame:
    """Hierarchy rows that mention the text in one of the fields."""
    present = [F.col(c) for c in fields if c in hierarchy.columns]
    return hierarchy.where(mentions(query, *present))


def code_details(hierarchy: DataFrame, code: str) -> DataFrame:
    """Hierarchy row of a code written with or without punctuation."""
    return hierarchy.where(F.col("subclasse") == digits(F.lit(code)))


def count_code(base: DataFrame, code: str) -> DataFrame:
    """Register rows with an activity code."""
    return base.where(F.col("cnae_principal") == digits(F.lit(code))).agg(
        F.count(F.lit(1)).alias("estabelecimentos")
    )


def level_counts(hierarchy: DataFrame) -> DataFrame:
    """Distinct codes of every level."""
    return hierarchy.agg(*[F.count_distinct(c).alias(c) for c in LEVELS])


def section_summary(hierarchy: DataFrame) -> DataFrame:
    """Distinct divisions, groups, classes and number of subclasses per section."""
    return (
        hierarchy.groupBy("secao", "secao_desc")
        .agg(
            F.count_distinct("divisao").alias("divisoes"),
            F.count_distinct("grupo").alias("grupos"),
            F.count_distinct("classe").alias("classes"),
            F.count("subclasse").alias("subclasses"),
        )
        .orderBy("secao")
    )
