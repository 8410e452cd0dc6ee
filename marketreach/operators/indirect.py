"""Coverage through distributors: nearest distributor, radius, allocation policy, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketreach import layouts as L
from marketreach.functions.numeric import decimal_comma, share
from marketreach.functions.predicates import not_in
from marketreach.functions.text import company_label, partner_label
from marketreach.operators.counts import distinct_ids
from marketreach.operators.joins import own_exchange
from marketreach.operators.nearest import nearest_site
from marketreach.sources.exports import keep_existing

_CHOSEN = {
    "cnpj_distrib_proximo": "cnpj_distrib_sel",
    "cnpj_basico_distrib": "cnpj_basico_distrib_sel",
    "nome_distrib": "nome_distrib_sel",
    "razao_distrib": "razao_distrib_sel",
    "dist_km_min": "dist_km_sel",
}


def distributors(foco: DataFrame, field: str, values: Sequence) -> DataFrame:
    """Served rows whose field holds one of the values, whatever their activity."""
    return foco.where(F.col("cliente_atendido") & F.col(field).isin(list(values)))


def direct_customers(market: DataFrame, field: str, values: Sequence) -> DataFrame:
    """Served rows that are not distributors; an unknown field counts as not one."""
    return market.where(F.col("cliente_atendido") & not_in(F.col(field), values))


def distributor_points(rows: DataFrame) -> DataFrame:
    """One located row per distributor id with its descriptive columns."""
    names = [c for c in ("cnpj_basico", "nome_fantasia", "razao_social", "uf", "municipio_nome")]
    located = rows.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return (
        located.groupBy("cnpj")
        .agg(
            *[F.min(c).alias(c) for c in names if c in rows.columns],
            F.min(F.struct("lat", "lon")).alias("_at"),
        )
        .select("*", "_at.lat", "_at.lon")
        .drop("_at")
    )


def distributor_values(rows: DataFrame, points: DataFrame) -> DataFrame:
    """Distributor companies with their summed value, highest first, unknown value last.

    The value counts every distributor row of the company, located or not; a company whose rows
    all lack a value has 0.
    """
    amount = F.col("relevancia_valor") if "relevancia_valor" in rows.columns else F.lit(0.0)
    value = rows.groupBy("cnpj_basico").agg(F.coalesce(F.sum(amount), F.lit(0.0)).alias("soma_valor"))
    firms = points.groupBy("cnpj_basico").agg(
        F.min("razao_social").alias("razao_social"), F.min("nome_fantasia").alias("nome_fantasia")
    )
    return (
        firms.join(value, "cnpj_basico", "left")
        .withColumn("rotulo", company_label(F.col("razao_social"), F.col("cnpj_basico")))
        .orderBy(F.desc_nulls_last("soma_valor"), "cnpj_basico")
    )


def mark_selected(points: DataFrame, selected_roots: Sequence[str] | DataFrame) -> DataFrame:
    """Adds `selecionado`: the distributor's company is one of the selected ones.

    The companies come as a list, or as a table with column `cnpj_basico` of any size.
    """
    if not isinstance(selected_roots, DataFrame):
        hit = F.coalesce(F.col("cnpj_basico").isin(list(selected_roots)), F.lit(False))
        return points.withColumn("selecionado", hit)
    roots = selected_roots.select("cnpj_basico").distinct().withColumn("selecionado", F.lit(True))
    marked = points.join(own_exchange(roots), "cnpj_basico", "left")
    return marked.withColumn("selecionado", F.coalesce("selecionado", F.lit(False)))


def _named(hits: DataFrame, points: DataFrame, site: str, names: dict[str, str]) -> DataFrame:
    """Replaces a site id by the columns `names` of its distributor; null stays null."""
    info = points.select(F.col("cnpj").alias(site), *[F.col(c).alias(f"_{c}") for c in names if c in points.columns])
    named = hits.join(info, site, "left")
    return named.withColumns({new: F.col(f"_{c}") for c, new in names.items() if c in points.columns}).drop(
        *[f"_{c}" for c in names]
    )


def _category(radius: float, selected: bool, prioritise: bool) -> Column:
    near = F.coalesce(F.col("dist_km_min") <= radius, F.lit(False))
    if not selected:
        return F.when(near, L.INSIDE).otherwise(L.OUTSIDE)
    if prioritise:
        near_sel = F.coalesce(F.col("dist_km_sel") <= radius, F.lit(False))
        return F.when(near_sel, L.INSIDE).when(near, L.INSIDE_OTHER).otherwise(L.OUTSIDE)
    return F.when(~near, L.OUTSIDE).when(F.col("_ours"), L.INSIDE).otherwise(L.INSIDE_OTHER)


def allocate(
    finals: DataFrame,
    points: DataFrame,
    radius_km: float,
    selected_roots: Sequence[str] | DataFrame | None = None,
    prioritise: bool = False,
) -> DataFrame:
    """Nearest distributor, distance and coverage category of every final customer.

    Distances are worked out per distinct coordinate pair and joined back. With
    `selected_roots`, the nearest selected distributor is found too; `prioritise` lets it replace
    the overall nearest whenever it lies within the radius. Without coordinates, or without
    distributors, a customer is outside and has no distance.
    """
    names = {
        "cnpj_basico": "cnpj_basico_distrib",
        "nome_fantasia": "nome_distrib",
        "razao_social": "razao_distrib",
    }
    selected = isinstance(selected_roots, DataFrame) or bool(selected_roots)
    renamed = {"cnpj": "cnpj_distrib_proximo", "dist_km": "dist_km_min"}
    if not selected:
        sites = nearest_site(finals, points, "cnpj").withColumnsRenamed(renamed)
        hits = own_exchange(_named(sites, points, "cnpj_distrib_proximo", names))
        out = finals.join(hits, ["lat", "lon"], "left").withColumns(
            {c: F.lit(None).cast("double" if c == "dist_km_sel" else "string") for c in _CHOSEN.values()}
        )
        return out.withColumn("atendimento_via", _category(radius_km, False, False))

    marked = mark_selected(points, selected_roots)
    renamed |= {"cnpj_chosen": _CHOSEN["cnpj_distrib_proximo"], "dist_km_chosen": _CHOSEN["dist_km_min"]}
    sites = nearest_site(finals, marked, "cnpj", chosen="selecionado").withColumnsRenamed(renamed)
    hits = _named(sites, marked, "cnpj_distrib_proximo", {**names, "selecionado": "_ours"})
    hits = _named(hits, marked, "cnpj_distrib_sel", {c: _CHOSEN[new] for c, new in names.items()})
    out = finals.join(own_exchange(hits), ["lat", "lon"], "left")
    out = out.withColumn("atendimento_via", _category(radius_km, True, prioritise)).drop("_ours")
    if prioritise:
        taken = F.col("atendimento_via") == L.INSIDE
        out = out.withColumns(
            {c: F.when(taken, F.col(s)).otherwise(F.col(c)) for c, s in _CHOSEN.items()}
        )
    return out


def coverage_result(
    market: DataFrame,
    points: DataFrame,
    field: str,
    values: Sequence,
    radius_km: float,
    selected_roots: Sequence[str] | DataFrame | None = None,
    prioritise: bool = False,
) -> DataFrame:
    """Direct customers and allocated final customers of a market in one table."""
    direct = direct_customers(market, field, values).withColumn("atendimento_via", F.lit(L.DIRECT))
    finals = allocate(
        market.where(~F.col("cliente_atendido")), points, radius_km, selected_roots, prioritise
    )
    return direct.unionByName(finals, allowMissingColumns=True)


def category_shares(result: DataFrame) -> DataFrame:
    """Distinct ids of every category with their share of all distinct ids, in one pass."""
    categories = [L.DIRECT, *L.FINAL_CUSTOMERS]
    per_id = result.where(F.col("cnpj").isNotNull()).groupBy("cnpj").agg(
        *[F.max(F.col("atendimento_via") == c).alias(c) for c in categories]
    )
    totals = per_id.agg(
        *[F.count_if(F.col(f"`{c}`")).alias(c) for c in categories], F.count(F.lit(1)).alias("_all")
    )
    counts = totals.unpivot(["_all"], [f"`{c}`" for c in categories], "atendimento_via", "clientes")
    return counts.select(
        "atendimento_via", "clientes", share(F.col("clientes"), F.col("_all")).alias("pct")
    )


def clients_per_distributor(
    result: DataFrame, points: DataFrame, ufs: Sequence[str] = ()
) -> DataFrame:
    """Clients of each distributor by category, those with most clients inside first."""
    rows = result.where(
        F.col("atendimento_via").isin(L.FINAL_CUSTOMERS) & F.col("cnpj_basico_distrib").isNotNull()
    )
    if ufs:
        rows = rows.where(F.col("uf").isin(list(ufs)))
    counts = distinct_ids(rows, ["cnpj_basico_distrib", "atendimento_via"])

    def of(category: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("atendimento_via") == category, F.col("n"))), F.lit(0))

    wide = counts.groupBy("cnpj_basico_distrib").agg(
        of(L.INSIDE).alias("dentro"),
        of(L.INSIDE_OTHER).alias("dentro_outros"),
        of(L.OUTSIDE).alias("fora"),
    )
    firms = points.groupBy(F.col("cnpj_basico").alias("cnpj_basico_distrib")).agg(
        F.min("razao_social").alias("_name")
    )
    label = company_label(F.col("_name"), F.col("cnpj_basico_distrib"), 40, " ")
    return (
        wide.join(firms, "cnpj_basico_distrib", "left")
        .withColumn("distribuidor", label)
        .select("distribuidor", "cnpj_basico_distrib", "dentro", "dentro_outros", "fora")
        .orderBy(F.desc("dentro"), "cnpj_basico_distrib")
    )


def distributor_choices(result: DataFrame) -> DataFrame:
    """Distributors that have clients, labelled for picking an export."""
    firms = result.where(F.col("cnpj_basico_distrib").isNotNull()).groupBy("cnpj_basico_distrib").agg(
        F.min("razao_distrib").alias("_name"), F.min("nome_distrib").alias("_trade")
    )
    label = partner_label(F.col("_name"), F.col("_trade"), F.col("cnpj_basico_distrib"))
    return firms.select("cnpj_basico_distrib", label.alias("rotulo")).orderBy("cnpj_basico_distrib")


def by_capital(df: DataFrame, k: int | None = None) -> DataFrame:
    """Highest capital first; a capital that is no number counts as 0."""
    if "capital_social" not in df.columns:
        return df.limit(k) if k else df
    capital = F.coalesce(decimal_comma(F.col("capital_social")), F.lit(0.0))
    ordered = df.orderBy(F.desc(capital), "cnpj")
    return ordered.limit(k) if k else ordered


def export_rows(
    result: DataFrame,
    points: DataFrame,
    mode: str = "outside",
    distributor_roots: Sequence[str] = (),
) -> DataFrame:
    """Export table of the final customers: `outside`, `distributor` or `all`."""
    rows = result.where(F.col("atendimento_via").isin(L.FINAL_CUSTOMERS))
    if mode == "outside":
        rows = rows.where(F.col("atendimento_via") == L.OUTSIDE)
    elif mode == "distributor" and distributor_roots:
        rows = rows.where(F.col("cnpj_basico_distrib").isin(list(distributor_roots)))
    info = points.select(
        F.col("cnpj").alias("cnpj_distrib_proximo"),
        F.col("razao_social").alias("distrib_razao_social"),
        F.col("nome_fantasia").alias("distrib_nome_fantasia"),
    )
    firms = points.groupBy(F.col("cnpj_basico").alias("cnpj_basico_distrib")).agg(
        F.min("razao_social").alias("distrib_empresa_mae")
    )
    named = rows.join(own_exchange(info), "cnpj_distrib_proximo", "left").join(
        own_exchange(firms), "cnpj_basico_distrib", "left"
    )
    return by_capital(keep_existing(named, L.INDIRECT_EXPORT))
