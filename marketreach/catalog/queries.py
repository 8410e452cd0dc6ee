"""Registered queries: (session, folder of the driver tables) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketreach import layouts as L
from marketreach.catalog import views as V
from marketreach.functions.numeric import decimal_comma, percent
from marketreach.functions.predicates import matches_all
from marketreach.functions.text import class_of, code_label, norm_text
from marketreach.operators import (
    counts,
    explore,
    focus,
    indirect,
    joins,
    market,
    outline,
    postal,
    ranking,
    segments,
    textindex,
    uploads,
)
from marketreach.plans import landing, register, segmentation
from marketreach.plans.focus import run_coordinates, run_pending
from marketreach.plans.reports import Cleaning, cleaned_market
from marketreach.session import shared_folder, stage, tune
from marketreach.sources import snapshots
from marketreach.sources.register import inventory, malformed
from marketreach.sources.uploads import numeric_shares, read_upload

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

CONTEXT = {"canal": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}
KEYWORDS = ["Rïng", "bolt"]
SEARCHED = ["Ring", "red w", "ot", "g", "all bolt"]
RADIUS_KM = 150.0


def query(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(tune(spark), folder)

    REGISTRY[fn.__name__] = run
    return run


def money(c: str | Column, digits: int = 2) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# ---- direct coverage ---------------------------------------------------------------------------


@query
def coverage_kpis(spark, folder):
    """Flagship: share of establishments and companies served, company flag expanded."""
    rows = cleaned_market(V.foco(spark, folder), Cleaning(context=CONTEXT, keywords=KEYWORDS), False)
    out = counts.coverage(rows)
    return out.withColumns({c: F.round(c, 6) for c in ("pct_cnpjs", "pct_empresas")})


def _portfolio(spark, folder) -> DataFrame:
    return ranking.client_codes(V.foco(spark, folder), matches_all(CONTEXT))


def _pareto(spark, folder, metric: str, base: str, k: int | None) -> DataFrame:
    out = ranking.pareto_abc(_portfolio(spark, folder), metric, base, k)
    label = code_label(F.col("cnae_principal"), F.col("cnae_principal_desc"), 40, " – ")
    return out.select(
        "cnae_principal", label.alias("rotulo"), "n_cnpjs", money("soma_valor").alias("soma_valor"),
        F.round("pct", 6).alias("pct"), F.round("pct_acumulado", 6).alias("pct_acumulado"), "abc",
    )


@query
def pareto_abc_clients(spark, folder):
    return _pareto(spark, folder, "n_cnpjs", "all", None)


@query
def pareto_abc_value(spark, folder):
    return _pareto(spark, folder, "soma_valor", "all", None)


@query
def pareto_abc_shown(spark, folder):
    """Shares of the ten codes shown."""
    return _pareto(spark, folder, "n_cnpjs", "shown", 10)


@query
def subclass_totals(spark, folder):
    foco = V.foco(spark, folder)
    portfolio = ranking.client_codes(foco, matches_all(CONTEXT))
    out = market.subclass_choices(market.subclass_totals(foco), portfolio)
    return out.withColumns(
        {"pct_carteira": F.round("pct_carteira", 6), "posicao": F.coalesce("posicao", F.lit(0))}
    )


@query
def market_context(spark, folder):
    rows = market.market_rows(V.foco(spark, folder), None, CONTEXT, expand_company=True)
    return rows.select("cnpj", "cliente_atendido")


@query
def market_cleaned(spark, folder):
    """Blank names and keywords removed, both variants of the blank rule."""
    foco = V.foco(spark, folder)
    strict = market.drop_keywords(market.drop_blank_names(foco), KEYWORDS)
    lenient = market.drop_keywords(market.drop_blank_names(foco, keep_served=True), KEYWORDS)
    return strict.select("cnpj", F.lit("todos").alias("regra")).unionByName(
        lenient.select("cnpj", F.lit("nao_atendidos").alias("regra"))
    )


@query
def market_cleaned_by_index(spark, folder):
    """Both variants of the cleaned market, the keywords looked up in one index of the trade names."""
    foco = V.foco(spark, folder)
    names = textindex.build_index(foco, F.col("nome_fantasia"))
    strict = textindex.drop_indexed_keywords(market.drop_blank_names(foco), names, KEYWORDS)
    lenient = textindex.drop_indexed_keywords(market.drop_blank_names(foco, keep_served=True), names, KEYWORDS)
    return strict.select("cnpj", F.lit("todos").alias("regra")).unionByName(
        lenient.select("cnpj", F.lit("nao_atendidos").alias("regra"))
    )


@query
def keyword_search(spark, folder):
    """Focus rows per keyword and id, for long and short keywords in one pass over the postings."""
    foco = V.foco(spark, folder)
    names = textindex.build_index(foco, F.col("nome_fantasia"))
    rows = textindex.rows_with_keywords(foco, F.col("nome_fantasia"), names, SEARCHED)
    return rows.groupBy("palavra", "cnpj").agg(F.count(F.lit(1)).alias("linhas"))


@query
def served_by_subclass(spark, folder):
    out = market.served_by_code(V.foco(spark, folder))
    return out.select("rotulo", "n_total", "n_atendidos", "n_nao_atendidos")


@query
def served_by_key(spark, folder):
    rows = market.market_rows(V.foco(spark, folder), expand_company=True)
    by_id = market.served_by_key(rows, ["uf"]).select(
        F.lit("cnpj").alias("id"), F.col("uf").alias("chave"), "n_total", "n_atendidos", "n_nao_atendidos"
    )
    by_firm = market.served_by_key(rows, ["municipio_nome"], "cnpj_basico", 20).select(
        F.lit("empresa").alias("id"), F.col("municipio_nome").alias("chave"),
        "n_total", "n_atendidos", "n_nao_atendidos",
    )
    return by_id.unionByName(by_firm)


@query
def top_cities(spark, folder):
    return market.top_places(V.foco(spark, folder), ["municipio_nome", "uf"])


@query
def ids_by_uf(spark, folder):
    return market.top_places(V.foco(spark, folder), ["uf"], None)


@query
def top_words(spark, folder):
    return market.top_words(market.unserved(V.foco(spark, folder)), "nome_fantasia")


@query
def document_words(spark, folder):
    """Word counts of whole texts in several languages."""
    return market.top_words(V.table(spark, folder, "documents"), "text", k=50)


@query
def normalised_documents(spark, folder):
    """Every whole text in its normalised form."""
    docs = V.table(spark, folder, "documents")
    return docs.select("doc_id", F.md5(norm_text(F.col("text"))).alias("digest"))


@query
def density_grid(spark, folder):
    cells = market.density(market.unserved(V.foco(spark, folder)))
    return cells.select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "n")


@query
def density_cap(spark, folder):
    return market.density_cap(market.density(market.unserved(V.foco(spark, folder))))


@query
def unserved_by_uf(spark, folder):
    return market.unserved_by(V.foco(spark, folder), "uf")


@query
def context_values(spark, folder):
    """Values offered for each classification column."""
    foco = V.foco(spark, folder)
    columns = [c for c in market.classification_columns(foco.columns) if c != "k"]
    parts = [
        market.distinct_values(foco, c).select(F.lit(c).alias("coluna"), F.col(c).alias("valor"))
        for c in columns
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ---- customer list -----------------------------------------------------------------------------


def _matched(spark, folder) -> DataFrame:
    enriched = uploads.enrich(V.upload(spark, folder), V.est(spark, folder), "CNPJ")
    return focus.matched_rows(enriched, "valor")


@query
def class_cutoff_95(spark, folder):
    rows = _matched(spark, folder)
    out = focus.describe_classes(ranking.class_cutoff(rows, "valor"), V.hierarchy(spark, folder))
    return out.withColumn("valor_total", money("valor_total"))


@query
def class_top_subclasses(spark, folder):
    return focus.class_top_subclasses(_matched(spark, folder))


@query
def labelled_codes(spark, folder):
    """Customer rows and value per labelled code."""
    rows = focus.label_codes(_matched(spark, folder), V.hierarchy(spark, folder))
    out = uploads.code_totals(rows, "rotulo", "valor")
    return out.withColumn("valor", money("valor"))


@query
def upload_top_codes(spark, folder):
    """Ten labelled codes with most customer rows, and ten with most value."""
    rows = focus.label_codes(_matched(spark, folder), V.hierarchy(spark, folder))
    totals = uploads.code_totals(rows, "rotulo", "valor")
    by_n = counts.top(totals, "n", "rotulo", 10).withColumn("criterio", F.lit("clientes"))
    by_v = counts.top(totals, "valor", "rotulo", 10).withColumn("criterio", F.lit("valor"))
    return by_n.unionByName(by_v).withColumn("valor", money("valor"))


@query
def combined_score(spark, folder):
    totals = uploads.code_totals(_matched(spark, folder), "cnae_principal", "valor")
    out = ranking.combined_score(totals, "cnae_principal")
    return out.withColumns({"valor": money("valor"), "score": F.round("score", 6)})


@query
def focus_build(spark, folder):
    """Focus table of the selected classes, with served marks and municipality coordinates."""
    base, upload = V.est(spark, folder), V.upload(spark, folder)
    rows = focus.matched_rows(uploads.enrich(upload, base, "CNPJ"), "valor")
    classes = ranking.class_cutoff(rows, "valor").where("selecionada").select("classe")
    foco = focus.filter_classes(base.drop("lat", "lon"), classes)
    foco = focus.mark_company(focus.mark_served(foco, V.customers(spark, folder)))
    foco = joins.attach_place(foco, V.centroids(spark, folder), "lat_municipio", "lon_municipio")
    return foco.select(
        "cnpj", "cnae_principal", "cliente_atendido", "empresa_base_atendida",
        money("relevancia_valor").alias("relevancia_valor"), "canal",
        F.round("lat_municipio", 6).alias("lat"), F.round("lon_municipio", 6).alias("lon"), "CD_MUN",
    )


@query
def focus_classes(spark, folder):
    """Class filter given as a list, counted."""
    rows = focus.filter_classes(V.est(spark, folder), ["4701", "4713", "4725"])
    return rows.groupBy(class_of(F.col("cnae_principal")).alias("classe")).agg(
        F.count(F.lit(1)).alias("linhas")
    )


@query
def enrich_base_wins(spark, folder):
    upload = V.upload(spark, folder).withColumn("uf", F.lit("??"))
    out = uploads.enrich(upload, V.est(spark, folder), "CNPJ")
    return out.select(
        "linha", F.col("_id").alias("cnpj"), "uf", "municipio_nome", "cnae_principal", "razao_social"
    )


@query
def enrich_user_wins(spark, folder):
    upload = V.upload(spark, folder).withColumn("uf", F.lit("??"))
    out = uploads.enrich_all(upload, V.est(spark, folder), "CNPJ", "valor")
    return out.select(
        "linha", "uf", "municipio_nome", "valor", money("VALOR_TOTAL").alias("valor_total"), "porte_desc"
    )


@query
def enrich_pivot(spark, folder):
    out = uploads.enrich_pivot(
        V.upload(spark, folder), V.est(spark, folder), "CNPJ", "segmento", "valor", "linha"
    )
    cells = [money(f"valor_{s}").alias(f"valor_{s}") for s in ("F", "O", "P")]
    return out.select(
        "CNPJ", *cells, "canal_F", "canal_O", "canal_P", "segmento_F", "segmento_O", "segmento_P",
        money("VALOR_TOTAL").alias("valor_total"), "uf",
    )


@query
def match_rate(spark, folder):
    out = uploads.enrich(V.upload(spark, folder), V.est(spark, folder), "CNPJ")
    return uploads.match_rate(out)


@query
def secondary_codes(spark, folder):
    return uploads.code_frequency(V.est(spark, folder, secondary=True))


@query
def guess_value_column(spark, folder):
    """Numeric share of every upload column."""
    shares = numeric_shares(V.upload(spark, folder))
    return shares.select("column", F.round("share", 6).alias("share"))


@query
def upload_duplicates(spark, folder):
    return uploads.duplicates(V.upload(spark, folder), "CNPJ")


@query
def upload_filters(spark, folder):
    """Classification filters on the list; matched and unmatched rows."""
    rows = V.upload(spark, folder).where(matches_all({"canal": ["1-URGENT", "5-LOW"], "segmento": []}))
    out = uploads.enrich(rows, V.est(spark, folder), "CNPJ")
    return out.agg(
        F.count(F.lit(1)).alias("filtradas"),
        F.count_if(F.col("cnae_principal").isNotNull()).alias("com_cnae"),
        F.count_if(F.col("cnae_principal").isNull()).alias("sem_cnae"),
    )


# ---- indirect coverage -------------------------------------------------------------------------


def _indirect(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Focus table staged once, distributor rows and points."""
    foco = stage(V.foco(spark, folder))
    sellers = indirect.distributors(foco, "canal", V.SELLER)
    return foco, sellers, stage(indirect.distributor_points(sellers))


def _selected(points: DataFrame, prefix: str = "NATION_1") -> DataFrame:
    """Distributor companies of some states, the way a user picks some of the list."""
    return points.where(F.startswith(F.col("uf"), F.lit(prefix))).select("cnpj_basico")


@query
def nearest_distributor(spark, folder):
    foco, _, points = _indirect(spark, folder)
    out = indirect.allocate(market.unserved(foco), points, RADIUS_KM)
    return out.select(
        "cnpj", "cnpj_distrib_proximo", "cnpj_basico_distrib", "razao_distrib",
        F.round("dist_km_min", 6).alias("dist_km_min"),
    )


def _coverage(spark, folder, prioritise: bool, selected: bool) -> tuple[DataFrame, DataFrame]:
    foco, _, points = _indirect(spark, folder)
    roots = _selected(points) if selected else None
    rows = market.drop_blank_names(foco, keep_served=True)
    result = indirect.coverage_result(
        rows, points, "canal", V.SELLER, RADIUS_KM, roots, prioritise
    )
    return result, points


@query
def coverage_by_radius(spark, folder):
    out = indirect.category_shares(_coverage(spark, folder, False, False)[0])
    return out.withColumn("pct", F.round("pct", 6))


@query
def coverage_selected(spark, folder):
    out = indirect.category_shares(_coverage(spark, folder, False, True)[0])
    return out.withColumn("pct", F.round("pct", 6))


@query
def coverage_prioritised(spark, folder):
    result, _ = _coverage(spark, folder, True, True)
    return result.where(F.col("atendimento_via") != L.DIRECT).select(
        "cnpj", "atendimento_via", "cnpj_distrib_proximo", F.round("dist_km_min", 6).alias("dist_km_min")
    )


@query
def clients_per_distributor(spark, folder):
    return indirect.clients_per_distributor(*_coverage(spark, folder, False, True))


@query
def distributor_choices(spark, folder):
    return indirect.distributor_choices(_coverage(spark, folder, False, False)[0])


@query
def indirect_export(spark, folder):
    out = indirect.export_rows(*_coverage(spark, folder, False, False), mode="outside")
    return out.select(
        "cnpj", "razao_social", "capital_social", "atendimento_via", "cnpj_distrib_proximo",
        "distrib_empresa_mae", "distrib_razao_social", F.round("dist_km_min", 6).alias("dist_km_min"),
    )


@query
def indirect_density(spark, folder):
    result, _ = _coverage(spark, folder, False, True)
    finals = result.where(F.col("atendimento_via").isin(L.FINAL_CUSTOMERS))
    cells = market.density(finals, ["atendimento_via"])
    return market.density_cap(cells, ["atendimento_via"], at_least_one=False)


@query
def distributor_value_rank(spark, folder):
    foco = V.foco(spark, folder)
    sellers = indirect.distributors(foco, "canal", V.SELLER)
    out = indirect.distributor_values(sellers, indirect.distributor_points(sellers))
    return out.select("cnpj_basico", "rotulo", "nome_fantasia", money("soma_valor").alias("soma_valor"))


# ---- overlap of three sets ---------------------------------------------------------------------

REGISTER_CODE = "4705001"
SET_NAMES = ["F · 1-URGENT, 2-HIGH", "O · 2-HIGH a 4", "CNAE 4701"]


def _segment_rows(spark, folder) -> DataFrame:
    """Customer list with its activity, one row per order."""
    rows = uploads.enrich(V.upload(spark, folder), V.est(spark, folder), "CNPJ")
    return rows.drop("CNPJ").withColumnRenamed("_id", "cnpj")


def _masks() -> tuple[Column, Column, Column]:
    return (
        segments.segment_rows("segmento", "F", "canal", ["1-URGENT", "2-HIGH"]),
        segments.segment_rows("segmento", "O", "canal", ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]),
        class_of(F.col("cnae_principal")) == "4701",
    )


def _members(rows: DataFrame) -> DataFrame:
    return segments.membership(rows, "cnpj", *_masks(), decimal_comma(F.col("valor")))


@query
def venn3_regions(spark, folder):
    out = segments.region_listing(_members(_segment_rows(spark, folder)), SET_NAMES)
    return out.withColumn("valor", money("valor"))


@query
def venn3_set_sizes(spark, folder):
    return segments.set_sizes(_members(_segment_rows(spark, folder)))


@query
def venn3_region_top10(spark, folder):
    rows = _segment_rows(spark, folder)
    out = segments.region_top(
        rows, _members(rows), "cnpj", decimal_comma(F.col("valor")), ["linha"]
    )
    return out.select("regiao", "posicao", "linha", "cnpj", "uf", "valor")


@query
def segment_top_codes(spark, folder):
    rows = _segment_rows(spark, folder)
    in_a, in_b, _ = _masks()
    top_a = segments.top_codes(rows.where(in_a))
    ids_b = rows.where(in_b).select("cnpj")
    top_b = segments.top_codes_of_ids(ids_b, V.est(spark, folder), "cnpj", 5)
    return segments.merge_tops(top_a, top_b)


@query
def segment_sizes(spark, folder):
    """Distinct ids of the two company segments."""
    rows = _segment_rows(spark, folder)
    parts = [
        segments.segment_size(rows, mask).withColumn("conjunto", F.lit(name))
        for mask, name in zip(_masks()[:2], "AB")
    ]
    return parts[0].unionByName(parts[1])


@query
def segment_apply(spark, folder):
    rows = _segment_rows(spark, folder)
    first = segments.label_region(rows, _members(rows), "cnpj", 1, " Mercado A ")
    both = segments.label_region(first, _members(rows), "cnpj", 3, "Mercado AB")
    again = segments.membership(rows, "cnpj", _masks()[0], F.lit(False), F.lit(False))
    out = segments.label_region(both, again, "cnpj", 1, "Sobra", overwrite=False)
    return segments.label_distribution(out)


@query
def version_diff(spark, folder):
    """Rows whose label differs between two saved versions."""
    return snapshots.changed_between(spark, _saved_versions(spark, folder), "carteira", 1, 0, "linha")


# ---- register ----------------------------------------------------------------------------------


def _raw_companies(spark, folder) -> DataFrame:
    """Supplier companies as raw register text."""
    s = V.table(spark, folder, "supplier")
    return s.select(
        F.concat(F.lit(" "), F.col("s_suppkey").cast("string")).alias("cnpj_basico"),
        F.concat("s_name", F.lit("  ")).alias("razao_social"),
        F.col("s_nationkey").cast("string").alias("natureza_juridica"),
        F.lit("49").alias("qualificacao_responsavel"),
        F.replace(F.col("s_acctbal").cast("string"), F.lit("."), F.lit(",")).alias("capital_social"),
        F.lpad((F.col("s_suppkey") % 7).cast("string"), 2, "0").alias("porte"),
        F.lit("").alias("ente_federativo_responsavel"),
    )


def _raw_establishments(spark, folder) -> DataFrame:
    """One establishment per line item, with register-style text fields."""
    li = V.table(spark, folder, "lineitem")
    text = {c: F.lit("") for c in L.ESTABLISHMENTS}
    key = F.col("l_orderkey")
    text.update(
        cnpj_basico=F.col("l_suppkey").cast("string"),
        cnpj_ordem=F.concat(F.lit(" "), F.col("l_linenumber").cast("string")),
        cnpj_dv=(key % 100).cast("string"),
        matriz_filial=F.when(F.col("l_linenumber") == 1, "1").otherwise("2"),
        nome_fantasia=F.concat(F.lit("  Loja "), key.cast("string"), F.lit(" ")),
        situacao_cadastral=F.when(F.col("l_returnflag") == "R", "08").otherwise(" 02"),
        data_inicio_atividade=F.when(key % 5 == 0, "00000000").otherwise(F.date_format("l_shipdate", "yyyyMMdd")),
        cnae_principal=F.col("l_partkey").cast("string"),
        cep=(key % 100000).cast("string"),
        uf=F.col("l_linestatus"),
        municipio=(key % 25).cast("string"),
        motivo_situacao=F.col("l_returnflag"),
    )
    return li.select(*[text[c].cast("string").alias(c) for c in L.ESTABLISHMENTS])


def _lookups(spark, folder) -> dict[str, DataFrame]:
    nation = V.table(spark, folder, "nation")
    part = V.table(spark, folder, "part")
    names = nation.select(F.col("n_nationkey").cast("string").alias("codigo"), F.col("n_name").alias("descricao"))
    return {
        "naturezas": names,
        "municipios": names,
        "cnaes": part.select(F.col("p_partkey").cast("string").alias("codigo"), F.col("p_name").alias("descricao")),
    }


@query
def etl_unified(spark, folder):
    """Cleaned establishments joined with companies and code tables, over all line items."""
    lookups = _lookups(spark, folder)
    wide = register.wide_table(
        register.establishments(_raw_establishments(spark, folder)),
        register.companies(_raw_companies(spark, folder), lookups),
        lookups,
    )
    return wide.select(
        "cnpj", "cnpj_basico", "nome_fantasia", "situacao_cadastral",
        F.date_format("data_inicio_atividade", "yyyy-MM-dd").alias("inicio"), "cep", "razao_social",
        "capital_social", "porte", "porte_desc", "natureza_juridica_desc", "cnae_principal_desc",
        "municipio_nome", "opcao_mei",
    )


@query
def etl_hierarchy_join(spark, folder):
    """Wide rows per section and class of the hierarchy joined to them."""
    est = V.est(spark, folder).select("cnpj", "cnpj_basico", "cnae_principal")
    firms = register.companies(_raw_companies(spark, folder), {})
    rows = register.wide_table(est, firms, {}, hierarchy=V.hierarchy(spark, folder))
    return rows.groupBy("secao", "classe").agg(F.count(F.lit(1)).alias("linhas"))


@query
def etl_partners(spark, folder):
    """Partners with their qualification, over all orders."""
    o = V.table(spark, folder, "orders")
    text = {c: F.lit("") for c in L.PARTNERS}
    text.update(
        cnpj_basico=F.col("o_custkey").cast("string"),
        nome_socio=F.concat(F.lit(" Socio "), F.col("o_orderkey").cast("string")),
        qualificacao_socio=F.concat(F.lit(" "), F.substring("o_orderpriority", 1, 1)),
        data_entrada_sociedade=F.date_format("o_orderdate", "yyyyMMdd"),
        faixa_etaria=F.col("o_orderstatus"),
    )
    raw = o.select(*[text[c].cast("string").alias(c) for c in L.PARTNERS])
    codes = o.groupBy(F.substring("o_orderpriority", 1, 1).alias("codigo")).agg(
        F.min("o_orderpriority").alias("descricao")
    ).where(F.col("codigo") != "5")
    out = register.partners(raw, {"qualificacoes": codes})
    return out.select(
        "cnpj_basico", "nome_socio", "qualificacao_socio", "qualificacao_socio_desc",
        F.date_format("data_entrada_sociedade", "yyyy-MM-dd").alias("entrada"), "faixa_etaria",
    )


@query
def etl_simples(spark, folder):
    """Regime columns joined on the padded root; the customers without orders stay NULL."""
    o = V.table(spark, folder, "orders")
    raw = o.groupBy((F.col("o_custkey") * 2).cast("string").alias("cnpj_basico")).agg(
        F.concat(F.lit(" "), F.min("o_orderstatus")).alias("opcao_simples"),
        F.date_format(F.min("o_orderdate"), "yyyyMMdd").alias("data_opcao_simples"),
        F.lit("0").alias("data_exclusao_simples"),
        F.lit("N").alias("opcao_mei"),
        F.lit("").alias("data_opcao_mei"),
        F.lit("20240230").alias("data_exclusao_mei"),
    )
    est = V.est(spark, folder).select("cnpj", "cnpj_basico", "cnae_principal")
    firms = register.companies(_raw_companies(spark, folder), {})
    wide = register.wide_table(est, firms, {}, register.simples_regime(raw))
    return wide.select(
        "cnpj", "razao_social", "opcao_simples",
        F.date_format("data_opcao_simples", "yyyy-MM-dd").alias("desde"),
        F.date_format("data_exclusao_mei", "yyyy-MM-dd").alias("ate"), "opcao_mei",
    )


@query
def repeated_roots(spark, folder):
    """Company roots that occur more than once on the establishment side."""
    return register.repeated_keys(V.est(spark, folder), "cnpj_basico")


# ---- exploration -------------------------------------------------------------------------------


def _explored(spark, folder) -> DataFrame:
    return explore.filtered(
        V.est(spark, folder, opened=True),
        sizes=["Micro Empresa", "Demais", "Não Informado"],
        years=(1995, 1996),
    )


@query
def explore_filtered(spark, folder):
    return explore.indicators(_explored(spark, folder))


@query
def explore_distributions(spark, folder):
    """States, sizes, opening years and codes of the filtered rows in one long table."""
    rows = _explored(spark, folder)
    parts = [
        explore.by_uf(rows).select(F.lit("uf").alias("tipo"), F.col("uf").alias("valor"), "qtd"),
        explore.by_size(V.est(spark, folder)).select(F.lit("porte").alias("tipo"), F.col("porte").alias("valor"), "qtd"),
        explore.openings_by_year(rows).select(
            F.lit("ano").alias("tipo"), F.col("ano").cast("string").alias("valor"), "qtd"
        ),
        explore.top_codes(rows, V.hierarchy(spark, folder)).select(
            F.lit("cnae").alias("tipo"), F.col("rotulo").alias("valor"), "qtd"
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def capital_boxstats(spark, folder):
    out = explore.capital_distribution(V.est(spark, folder), V.hierarchy(spark, folder))
    stats = ["minimo", "q1", "mediana", "q3", "maximo", "media"]
    return out.select("rotulo", "n", *[F.round(c, 4).alias(c) for c in stats])


@query
def code_search(spark, folder):
    """Text search and cascading level filter on the hierarchy, with register row counts."""
    h = V.hierarchy(spark, folder)
    found = explore.search_codes(h, "ecoNOMY", ["subclasse", "subclasse_desc"])
    under = explore.hierarchy_filter(found, {"secao": ["A", "C"], "divisao": ["47"]})
    rows = explore.rows_of_codes(V.est(spark, folder), under)
    return rows.groupBy("cnae_principal").agg(F.count(F.lit(1)).alias("linhas"))


@query
def code_lookup(spark, folder):
    """Details of one punctuated code, with its register rows."""
    code = "4701-0/01"
    n = explore.count_code(V.est(spark, folder), code).select("estabelecimentos").scalar()
    h = explore.code_details(V.hierarchy(spark, folder), code)
    return h.select("subclasse", "subclasse_desc", "secao", n.alias("estabelecimentos"))


@query
def hierarchy_summary(spark, folder):
    return explore.section_summary(V.hierarchy(spark, folder))


@query
def hierarchy_levels(spark, folder):
    return explore.level_counts(V.hierarchy(spark, folder))


# ---- postal codes and places -------------------------------------------------------------------


@query
def cep_prefix_stats(spark, folder):
    return postal.cep_stats(V.est(spark, folder))


@query
def cep_representatives(spark, folder):
    return postal.frequent_cep(V.est(spark, folder))


@query
def cache_pending(spark, folder):
    reps = postal.frequent_cep(V.est(spark, folder)).select("cep5", "cep_usado")
    return postal.pending(reps, V.cache(spark, folder))


def _fresh(pending: DataFrame, columns: list[str]) -> DataFrame:
    """Answers for the pending prefixes: even ones found."""
    n = F.col("cep5").cast("int")
    ok = n % 2 == 0
    made = {c: F.lit("") for c in columns}
    made.update(
        cep5=F.col("cep5"),
        cep_usado=F.col("cep_usado"),
        lat=F.when(ok, F.lit(-10.0) - n * 0.001),
        lon=F.when(ok, F.lit(-50.0) - n * 0.001),
        status=F.when(ok, "ok").otherwise("not_found"),
        timestamp=F.lit("2024-06-01T00:00:00"),
    )
    return pending.select(*[made[c].alias(c) for c in columns])


@query
def cache_upsert(spark, folder):
    cache = V.cache(spark, folder)
    fresh = _fresh(cache_pending(spark, folder), cache.columns)
    out = postal.upsert(cache, fresh)
    return out.select("cep5", "status", "timestamp", F.round("lat", 6).alias("lat"))


@query
def cache_stats(spark, folder):
    cache = V.cache(spark, folder)
    reps = postal.any_cep(V.est(spark, folder))
    return postal.lookup_stats(reps, cache, _fresh(postal.pending(reps, cache), cache.columns))


@query
def geo_precedence(spark, folder):
    """Prefix point first, municipality point second."""
    rows = V.est(spark, folder).drop("lat", "lon")
    placed = joins.attach_place(rows, V.centroids(spark, folder), "lat_municipio", "lon_municipio")
    out = postal.attach_prefix_coordinates(placed, V.cache(spark, folder))
    return out.select("cnpj", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "CD_MUN")


@query
def geocoded_rows(spark, folder):
    rows = V.est(spark, folder).drop("lat", "lon")
    return market.geocoded(postal.attach_prefix_coordinates(rows, V.cache(spark, folder)), "lat")


# ---- outline and landing folder ----------------------------------------------------------------


def _outline_lines(spark, folder) -> DataFrame:
    """Outline text: one document per region, its nations as divisions, customers as subclasses."""
    nation = V.table(spark, folder, "nation")
    customer = V.table(spark, folder, "customer")
    region = V.table(spark, folder, "region")
    doc = F.concat(F.lit("doc"), F.col("n_regionkey").cast("string"))
    size = 1_000_000_000_000
    at = F.col("n_nationkey").cast("long") * size
    two = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    sections = region.select(
        F.concat(F.lit("doc"), F.col("r_regionkey").cast("string")).alias("doc"),
        F.lit(-1).cast("long").alias("line_no"),
        F.concat(F.lit("  Seção "), F.chr(F.col("r_regionkey") + 65), F.lit(" - "), F.col("r_name")).alias("line"),
    )
    divisions = nation.select(
        doc.alias("doc"), at.alias("line_no"),
        F.concat(F.lit("DIVISAO "), two, F.lit(" – "), F.col("n_name")).alias("line"),
    )
    groups = nation.where(F.col("n_nationkey") % 2 == 0).select(
        doc.alias("doc"), (at + 1).alias("line_no"),
        F.concat(F.lit("GRUPO "), two, F.lit(".1 - Grupo "), F.col("n_name")).alias("line"),
    )
    people = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    k = F.col("c_custkey")
    code = F.concat(
        F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("-1/"), F.lpad((k % 100).cast("string"), 2, "0")
    )
    subclasses = people.select(
        doc.alias("doc"), (at + 10 + k * 10).alias("line_no"),
        F.concat(code, F.lit(" - "), F.col("c_name")).alias("line"),
    )
    notes = people.select(
        doc.alias("doc"),
        F.explode(F.array(at + 11 + k * 10, at + 12 + k * 10)).alias("line_no"),
        F.concat(F.lit(" nota "), F.col("c_mktsegment"), F.lit(" ")).alias("line"),
    )
    return sections.unionByName(divisions).unionByName(groups).unionByName(subclasses).unionByName(notes)


@query
def outline_filldown(spark, folder):
    out = outline.parse_outline(_outline_lines(spark, folder))
    return out.select(
        "doc", "secao_cod", "secao_nome", "divisao_cod", "divisao_nome", "grupo_cod", "grupo_nome",
        "classe_cod", "subclasse_cod", "subclasse_nome", "notas_explicativas",
    )


@query
def outline_editions(spark, folder):
    """Editions merged: for a repeated code the later document wins."""
    records = outline.parse_outline(_outline_lines(spark, folder))
    records = records.withColumn("edition", F.expr("cast(substring(doc, 4) as int)"))
    best = outline.merge_editions(records, "edition")
    return best.select("subclasse_cod_num", "doc", "subclasse_nome")


@query
def served_share(spark, folder):
    """Share of served rows per state, rounded half to even."""
    rows = V.foco(spark, folder)
    out = rows.groupBy("uf").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("cliente_atendido").alias("atendidos")
    )
    return out.withColumn("pct", percent(F.col("atendidos"), F.col("n")))


# ---- jobs: what they write, read back ------------------------------------------------------------


def _folder(spark, kind: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"


def _write_extract(rows: DataFrame, path: str, header: bool = False) -> str:
    """Rows as quoted text in the register's format."""
    rows.write.csv(path, sep=";", quoteAll=True, escape='"', header=header, emptyValue="")
    return path


def _register_job(spark, folder) -> tuple[str, dict[str, str]]:
    """The register job over extracts whose company names hold line breaks."""
    root = _folder(spark, "landing")
    firms = _raw_companies(spark, folder).withColumn("razao_social", F.replace("razao_social", F.lit("#"), F.lit("\n")))
    companies = _write_extract(firms, f"{root}/empresas")
    places = _write_extract(_raw_establishments(spark, folder), f"{root}/estabelecimentos")
    out = f"{root}/saida"
    paths = register.run_register(
        spark, companies, places, f"{root}/socios", f"{root}/tabelas", out,
        include_partners=False, include_simples=False, line_breaks=True,
    )
    return root, paths


def _job_columns(wide: DataFrame) -> DataFrame:
    return wide.select(
        "cnpj", "cnpj_basico", "nome_fantasia", F.date_format("data_inicio_atividade", "yyyy-MM-dd").alias("inicio"), "cep",
        "razao_social", "capital_social", "porte", "porte_desc",
    )


@query
def register_job(spark, folder):
    """Wide table that the register job writes, from extracts read in ranges."""
    return _job_columns(spark.read.parquet(_register_job(spark, folder)[1]["unificada"]))


@query
def register_rebuild(spark, folder):
    """The wide table from the stages of an earlier job."""
    root, _ = _register_job(spark, folder)
    return _job_columns(register.rebuild_wide(spark, f"{root}/saida", f"{root}/tabelas"))


@query
def register_refresh(spark, folder):
    """The wide table after two landings: even roots first, then the files of the odd ones."""
    root = _folder(spark, "landing")
    firms = _raw_companies(spark, folder).withColumn("razao_social", F.replace("razao_social", F.lit("#"), F.lit("\n")))
    raw = {"empresas": firms, "estabelecimentos": _raw_establishments(spark, folder)}
    for odd in (0, 1):
        for name, rows in raw.items():
            half = rows.where(F.pmod(F.trim("cnpj_basico").cast("long"), F.lit(2)) == odd)
            half.write.mode("append").csv(f"{root}/{name}", sep=";", quoteAll=True, escape='"', emptyValue="")
        paths = [f"{root}/{name}" for name in (*raw, "tabelas", "saida")]
        landing.refresh(spark, *paths, line_breaks=True)
    return _job_columns(landing.read_wide(spark, f"{root}/saida"))


@query
def malformed_records(spark, folder):
    """Records with a field too few, every tenth of the companies."""
    s = V.table(spark, folder, "supplier")
    rest = F.when(F.col("s_suppkey") % 10 == 0, "").otherwise(';"x"')
    line = F.concat(F.lit('"'), F.col("s_suppkey").cast("string"), F.lit('";"'), "s_name", F.lit('"'), rest)
    where = _folder(spark, "landing")
    s.select(line).write.text(where)
    return malformed(spark, where, ["a", "b", "c"], "*.txt", line_breaks=True).select("record")


@query
def landing_inventory(spark, folder):
    """Files by kind, one file per document."""
    docs = V.table(spark, folder, "documents")
    kinds = F.array(*[F.lit(k) for k in ("Empresas", "ESTABELECIMENTOS", "socios", "F.K03200")])
    name = F.concat(F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int")), F.col("doc_id").cast("string"), F.lit(".csv"))
    return inventory(docs.select(name.alias("name"), F.length("text").cast("long").alias("length")))


@query
def upload_line_breaks(spark, folder):
    """Customer list with line breaks in a field, read in ranges."""
    rows = V.upload(spark, folder).select(
        "linha", "canal", F.concat("canal", F.lit("\n"), "segmento").alias("obs")
    )
    return read_upload(spark, _write_extract(rows, _folder(spark, "uploads"), header=True), line_breaks=True)


def _saved_versions(spark, folder) -> str:
    """Two versions of the customer list: unlabelled, then with one region labelled."""
    rows = _segment_rows(spark, folder).select("linha", "cnpj", "canal", "segmento", "cnae_principal", "valor")
    root = _folder(spark, "versions")
    first = snapshots.save_version(snapshots.with_label_column(rows), root, "carteira", "inicio", "linha")
    before = snapshots.load_version(spark, root, "carteira", first)
    after = segments.label_region(before, _members(rows), "cnpj", 1, "A")
    snapshots.save_version(after, root, "carteira", "regiao", "linha", previous=first)
    return root


@query
def version_list(spark, folder):
    """Metadata of two saved versions."""
    found = snapshots.list_versions(spark, _saved_versions(spark, folder), "carteira")
    return found.select("version", "label", "rows", "rows_changed")


@query
def version_load(spark, folder):
    """Labels of the newest saved version."""
    root = _saved_versions(spark, folder)
    saved = snapshots.load_version(spark, root, "carteira", snapshots.next_version(spark, root, "carteira") - 1)
    return saved.groupBy(snapshots.LABEL).agg(F.count(F.lit(1)).alias("qtd"))


@query
def segmentation_job(spark, folder):
    """Labels of the version that the segmentation job saves."""
    rows = _segment_rows(spark, folder).select("linha", "cnpj", "canal", "segmento", "cnae_principal", "valor")
    root = _folder(spark, "versions")
    saved = segmentation.run_segmentation(
        spark, rows, _members(rows), "cnpj", {1: "A", 3: "AB"}, root, "carteira", "regioes", "linha"
    )
    return snapshots.load_version(spark, root, "carteira", saved).groupBy(snapshots.LABEL).agg(F.count(F.lit(1)).alias("qtd"))


@query
def venn3_through_register(spark, folder):
    """Regions of a customer list without activities: the third set comes from the register."""
    found = segmentation.overlap(
        V.upload(spark, folder), "CNPJ", "segmento", "canal", ("F", ["1-URGENT", "2-HIGH"]),
        ("O", ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]), REGISTER_CODE, "valor", V.est(spark, folder),
    )
    return found.groupBy("regiao").agg(F.count(F.lit(1)).alias("n"), money(F.sum("valor")).alias("valor"))


@query
def coordinates_job(spark, folder):
    """Pending prefixes written, resolved, merged into the cache and put on the rows."""
    root = _folder(spark, "cache")
    rows, cache = V.est(spark, folder).drop("lat", "lon"), V.cache(spark, folder)
    waiting = spark.read.parquet(run_pending(spark, rows, cache, f"{root}/pendentes"))
    paths = run_coordinates(spark, rows, cache, _fresh(waiting, cache.columns), f"{root}/foco", f"{root}/cache")
    return spark.read.parquet(paths["foco"]).select("cnpj", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))
