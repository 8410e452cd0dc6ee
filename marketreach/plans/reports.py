"""Direct, indirect and segmentation reports over a focus table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketreach import layouts as L
from marketreach.functions.predicates import matches_all
from marketreach.operators import counts, indirect, market, ranking
from marketreach.session import stage, tune
from marketreach.sources.exports import write_csv


@dataclass(frozen=True)
class Cleaning:
    """Options of the market filter."""

    codes: Sequence[str] | None = None
    context: Mapping[str, Sequence] = field(default_factory=dict)
    expand_company: bool = True
    skip_blank_names: bool = True
    keywords: Sequence[str] = ()


def cleaned_market(foco: DataFrame, options: Cleaning, keep_served: bool) -> DataFrame:
    rows = market.market_rows(foco, options.codes, options.context, options.expand_company)
    if options.skip_blank_names:
        rows = market.drop_blank_names(rows, keep_served)
    return market.drop_keywords(rows, options.keywords)


def portfolio(foco: DataFrame, context: Mapping[str, Sequence], k: int = 10) -> dict[str, DataFrame]:
    """Served activities by customers and by value, and the choice list of activities."""
    codes = ranking.client_codes(foco, matches_all(context))
    return {
        "por_clientes": ranking.pareto_abc(codes, "n_cnpjs", "all", k),
        "por_valor": ranking.pareto_abc(codes, "soma_valor", "all", k),
        "subclasses": market.subclass_choices(market.subclass_totals(foco), codes),
    }


def direct_report(foco: DataFrame, options: Cleaning) -> dict[str, DataFrame]:
    """Tables of the direct-coverage report; nine tables stand on the market, so it is staged once."""
    rows = stage(cleaned_market(foco, options, keep_served=False))
    missing = market.unserved(rows)
    cells = market.density(missing)
    return {
        "indicadores": counts.coverage(rows),
        "cnpj_uf": market.served_by_key(rows, ["uf"], k=None),
        "empresa_uf": market.served_by_key(rows, ["uf"], "cnpj_basico", k=None),
        "cnpj_cidade": market.served_by_key(rows, ["municipio_nome"], k=20),
        "empresa_cidade": market.served_by_key(rows, ["municipio_nome"], "cnpj_basico", 20),
        "densidade": cells,
        "densidade_limite": market.density_cap(cells),
        "nao_atendidos_uf": market.unserved_by(rows, "uf"),
        "exportacao": indirect.by_capital(missing),
    }


def similar_market(foco: DataFrame, options: Cleaning) -> dict[str, DataFrame]:
    """Tables of the similar-market view."""
    rows = market.market_rows(foco, options.codes, options.context)
    return {
        "por_subclasse": market.served_by_code(rows),
        "por_uf": market.top_places(rows, ["uf"], None),
        "cidades": market.top_places(rows, ["municipio_nome", "uf"]),
        "palavras": market.top_words(market.unserved(rows), "nome_fantasia"),
    }


def indirect_report(
    foco: DataFrame,
    options: Cleaning,
    distributor_field: str,
    distributor_values: Sequence,
    radius_km: float = 150.0,
    selected_roots: Sequence[str] | DataFrame | None = None,
    prioritise: bool = False,
    export_mode: str = "outside",
    export_roots: Sequence[str] = (),
    ufs: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Tables of the indirect-coverage report. Distributors ignore the activity filter."""
    sellers = indirect.distributors(foco, distributor_field, distributor_values)
    points = stage(indirect.distributor_points(sellers))
    rows = cleaned_market(foco, options, keep_served=True)
    # eight tables stand on the result: the search runs once
    result = stage(
        indirect.coverage_result(
            rows, points, distributor_field, distributor_values, radius_km, selected_roots, prioritise
        )
    )
    finals = result.where(F.col("atendimento_via").isin(L.FINAL_CUSTOMERS))
    cells = market.density(finals, ["atendimento_via"])
    return {
        "resultado": result,
        "distribuidores": indirect.distributor_values(sellers, points),
        "indicadores": indirect.category_shares(result),
        "por_distribuidor": indirect.clients_per_distributor(result, points, ufs),
        "escolha_distribuidor": indirect.distributor_choices(result),
        "densidade": cells,
        "densidade_limite": market.density_cap(cells, ["atendimento_via"], at_least_one=False),
        "exportacao": indirect.export_rows(result, points, export_mode, export_roots),
    }


def run_report(spark: SparkSession, tables: Mapping[str, DataFrame], output: str) -> dict[str, str]:
    """Write every table of a report as CSV in a folder of its own."""
    tune(spark)
    return {name: write_csv(df, f"{output}/{name}") for name, df in tables.items()}
