"""Market of the chosen activities: context, cleaning, direct coverage, density."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketreach import layouts as L
from marketreach.functions.numeric import GRID_DEGREES, grid_cell
from marketreach.functions.predicates import has_text, in_context, matches_all, names_any
from marketreach.functions.text import code_label, is_word, word_array
from marketreach.operators.counts import distinct_ids, flagged_ids, top


def classification_columns(columns: Sequence[str]) -> list[str]:
    """Columns of a focus table that came from the customer list."""
    return sorted(set(columns) - set(L.KNOWN))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Known values of a column, sorted."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def market_rows(
    foco: DataFrame,
    codes: Sequence[str] | None = None,
    filters: Mapping[str, Sequence] | None = None,
    expand_company: bool = False,
) -> DataFrame:
    """Rows of the chosen activities: unserved ones, and served ones inside the context.

    `expand_company` counts an establishment as served when its company is.
    """
    rows = foco
    if codes is not None:
        rows = rows.where(F.substring("cnae_principal", 1, 7).isin(list(codes)))
    if filters:
        rows = rows.where(in_context(F.col("cliente_atendido"), matches_all(filters, foco.columns)))
    if expand_company and "empresa_base_atendida" in foco.columns:
        both = F.col("cliente_atendido") | F.col("empresa_base_atendida")
        rows = rows.withColumn("cliente_atendido", both)
    return rows


def drop_blank_names(market: DataFrame, keep_served: bool = False) -> DataFrame:
    """Rows with a trade name; `keep_served` keeps served rows without one."""
    named = has_text(F.col("nome_fantasia"))
    return market.where((F.col("cliente_atendido") | named) if keep_served else named)


def drop_keywords(market: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Unserved rows whose trade name holds a keyword are removed."""
    if not keywords:
        return market
    return market.where(F.col("cliente_atendido") | ~names_any(F.col("nome_fantasia"), keywords))


def subclass_totals(foco: DataFrame) -> DataFrame:
    """Distinct ids and served ids by activity code."""
    known = foco.where(F.col("cnae_principal").isNotNull())
    served = F.coalesce(F.col("cliente_atendido"), F.lit(False))
    per_id = known.where(F.col("cnpj").isNotNull()).groupBy(
        "cnae_principal", "cnae_principal_desc", "cnpj"
    ).agg(F.max(served).alias("_s"))
    return per_id.groupBy("cnae_principal", "cnae_principal_desc").agg(
        F.count(F.lit(1)).alias("n_total"), F.sum(F.col("_s").cast("long")).alias("n_atend")
    )


def subclass_choices(totals: DataFrame, portfolio: DataFrame, preselect: int = 10) -> DataFrame:
    """Codes in portfolio order, unknown ones last, with their share of the portfolio.

    `totals` and `portfolio` hold one row per activity code.
    """
    place = Window.orderBy(F.desc("n_cnpjs"), F.asc("cnae_principal"), F.asc("cnae_principal_desc"))
    whole = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = portfolio.withColumns(
        {"_pos": F.row_number().over(place), "_all": F.sum("n_cnpjs").over(whole)}
    )
    per_code = listed.groupBy("cnae_principal").agg(
        F.min("_pos").alias("posicao"), (F.sum("n_cnpjs") / F.max("_all") * 100).alias("_pct")
    )
    share = F.coalesce(F.col("_pct"), F.lit(0.0))
    return (
        totals.join(per_code, "cnae_principal", "left")
        .select(
            "cnae_principal", "cnae_principal_desc", "n_total", "n_atend", "posicao",
            share.alias("pct_carteira"),
            F.coalesce(F.col("posicao") <= preselect, F.lit(False)).alias("pre_selecionada"),
        )
        .orderBy(F.asc_nulls_last("posicao"), "cnae_principal")
    )


def served_by_code(market: DataFrame, k: int = 10) -> DataFrame:
    """Served and unserved ids of the k codes with most ids, most unserved first."""
    label = code_label(F.col("cnae_principal"), F.col("cnae_principal_desc"), 35, " – ")
    known = market.where(
        F.col("cnae_principal").isNotNull() & F.col("cnae_principal_desc").isNotNull()
    )
    counts = flagged_ids(known, ["cnae_principal", "cnae_principal_desc"])
    biggest = top(
        counts.groupBy("cnae_principal").agg(F.sum("n_total").alias("_t")),
        "_t", "cnae_principal", k,
    )
    kept = counts.join(F.broadcast(biggest.select("cnae_principal")), "cnae_principal", "left_semi")
    return (
        kept.withColumn("rotulo", label)
        .orderBy(F.desc("n_nao_atendidos"), "cnae_principal", "cnae_principal_desc")
    )


def served_by_key(
    market: DataFrame, keys: list[str], id_col: str = "cnpj", k: int | None = 25
) -> DataFrame:
    """Served and unserved distinct ids by any key, the k largest totals; NULL keys are left out."""
    rows = market
    for c in keys:
        rows = rows.where(F.col(c).isNotNull())
    counts = flagged_ids(rows, keys, id_col)
    return top(counts, "n_total", keys, k) if k else counts.orderBy(F.desc("n_total"), *keys)


def top_places(market: DataFrame, keys: list[str], k: int | None = 10) -> DataFrame:
    """Distinct ids per place, highest first."""
    rows = market
    for c in keys:
        rows = rows.where(F.col(c).isNotNull())
    counts = distinct_ids(rows, keys)
    return top(counts, "n", keys, k) if k else counts.orderBy(F.desc("n"), *keys)


def top_words(rows: DataFrame, text: str, k: int = 20, stopwords: Sequence[str] = L.STOPWORDS) -> DataFrame:
    """Most frequent normalised words of a text column."""
    word = rows.select(F.explode(word_array(F.col(text))).alias("palavra")).where(
        is_word(F.col("palavra"), stopwords)
    )
    counts = word.groupBy("palavra").agg(F.count(F.lit(1)).alias("freq"))
    return top(counts, "freq", "palavra", k)


def density(points: DataFrame, keys: Sequence[str] = (), step: float = GRID_DEGREES) -> DataFrame:
    """Located rows per grid cell; the cell is counted by index, its centre given back after."""
    cells = (
        points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .groupBy(*keys, grid_cell(F.col("lat"), step).alias("_i"), grid_cell(F.col("lon"), step).alias("_j"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return cells.select(
        *keys, (F.col("_i") * step).alias("lat"), (F.col("_j") * step).alias("lon"), "n"
    )


def density_cap(
    cells: DataFrame, keys: Sequence[str] = (), at_least_one: bool = True, prob: float = 0.9
) -> DataFrame:
    """Upper end of the colour scale: 90th percentile of the cell counts.

    `at_least_one` raises it to 1, otherwise only 0 becomes 1. Cell counts take few distinct
    values (their sum is the number of rows), which is what `percentile` keeps in memory.
    """
    caps = cells.groupBy(*keys).agg(F.percentile("n", F.lit(prob)).alias("_p"))
    low = (F.col("_p") < 1) if at_least_one else (F.col("_p") == 0)
    return caps.select(*keys, F.when(low, 1.0).otherwise(F.col("_p")).alias("limite"))


def unserved(market: DataFrame) -> DataFrame:
    return market.where(~F.coalesce(F.col("cliente_atendido"), F.lit(False)))


def unserved_by(market: DataFrame, key: str) -> DataFrame:
    """Distinct unserved ids per key."""
    rows = unserved(market).where(F.col(key).isNotNull())
    return distinct_ids(rows, [key], alias="n_nao_atendidos")


def geocoded(df: DataFrame, lat: str = "lat") -> DataFrame:
    """Rows with a coordinate and all rows."""
    return df.agg(
        F.count_if(F.col(lat).isNotNull()).alias("com_coordenada"), F.count(F.lit(1)).alias("linhas")
    )

