"""Reports over the derived focus table: totals that must agree with each other."""

from pyspark.sql import functions as F

from marketreach import layouts as L
from marketreach.operators import market
from marketreach.plans import reports
from marketreach.plans.reports import Cleaning


def test_classification_columns(foco):
    assert market.classification_columns([c for c in foco.columns if c != "k"]) == ["canal", "segmento"]


def test_direct_report(spark, foco, tmp_path):
    out = reports.direct_report(foco, Cleaning(context={"canal": ["1-URGENT", "2-HIGH"]}, keywords=["ring"]))
    kpi = out["indicadores"].first()
    rows = reports.cleaned_market(
        foco, Cleaning(context={"canal": ["1-URGENT", "2-HIGH"]}, keywords=["ring"]), False
    )
    assert kpi.cnpjs == rows.select("cnpj").distinct().count()
    by_uf = out["cnpj_uf"].agg(F.sum("n_total")).first()[0]
    assert by_uf == kpi.cnpjs
    missing = rows.where(~F.col("cliente_atendido"))
    located = missing.where(F.col("lat").isNotNull()).count()
    assert out["densidade"].agg(F.sum("n")).first()[0] == located
    assert out["densidade_limite"].first().limite >= 1
    assert out["exportacao"].count() == missing.count()
    capital = [r.capital_social for r in out["exportacao"].collect()]
    assert capital == sorted(capital, reverse=True)
    paths = reports.run_report(spark, {"kpi": out["indicadores"]}, str(tmp_path))
    assert spark.read.csv(paths["kpi"], sep=";", header=True).count() == 1


def test_portfolio(foco):
    out = reports.portfolio(foco, {})
    rows = out["subclasses"].collect()
    assert abs(sum(r.pct_carteira for r in rows) - 100) < 1e-6
    assert sum(r.pre_selecionada for r in rows) == 10
    assert [r.posicao for r in rows[:3]] == [1, 2, 3]
    assert out["por_clientes"].count() == 10


def test_similar_market(foco):
    codes = [r[0] for r in foco.select("cnae_principal").distinct().limit(20).collect()]
    out = reports.similar_market(foco, Cleaning(codes=codes))
    total = foco.where(F.col("cnae_principal").isin(codes)).select("cnpj").distinct().count()
    assert out["por_uf"].agg(F.sum("n")).first()[0] == total
    order = [r.n_nao_atendidos for r in out["por_subclasse"].collect()]
    assert order == sorted(order, reverse=True) and len(order) <= 10
    assert out["palavras"].count() > 0 and out["cidades"].count() <= 10


def test_indirect_report(foco):
    out = reports.indirect_report(foco, Cleaning(expand_company=False), "canal", ["1-URGENT"])
    result = out["resultado"]
    kept = market.drop_blank_names(foco, keep_served=True)
    finals = kept.where(~F.col("cliente_atendido")).count()
    direct = kept.where("cliente_atendido and canal <> '1-URGENT'").count()
    assert result.count() == finals + direct
    shares = {r.atendimento_via: r for r in out["indicadores"].collect()}
    assert abs(sum(r.pct for r in shares.values()) - 100) < 1e-9
    assert shares[L.INSIDE_OTHER].clientes == 0 and shares[L.DIRECT].clientes == direct
    assert shares[L.INSIDE].clientes + shares[L.OUTSIDE].clientes == finals
    assert out["exportacao"].count() == shares[L.OUTSIDE].clientes
    bars = out["por_distribuidor"].agg(F.sum("dentro"), F.sum("fora")).first()
    assert bars[0] == shares[L.INSIDE].clientes
    assert [c for c in out["exportacao"].columns] == [c for c in L.INDIRECT_EXPORT if c in out["exportacao"].columns]
    assert out["densidade_limite"].count() == out["densidade"].select("atendimento_via").distinct().count()


def test_indirect_options(foco):
    some = [r[0] for r in foco.where("canal = '1-URGENT' and lat is not null").select("cnpj_basico").limit(3).collect()]
    plain = reports.indirect_report(foco, Cleaning(), "canal", ["1-URGENT"], 100.0, some, export_mode="all")
    first = reports.indirect_report(
        foco, Cleaning(), "canal", ["1-URGENT"], 100.0, some, prioritise=True,
        export_mode="distributor", export_roots=some,
    )
    count = lambda out: {r.atendimento_via: r.clientes for r in out["indicadores"].collect()}
    a, b = count(plain), count(first)
    assert a[L.OUTSIDE] == b[L.OUTSIDE] and b[L.INSIDE] >= a[L.INSIDE]
    assert plain["exportacao"].count() == a[L.INSIDE] + a[L.INSIDE_OTHER] + a[L.OUTSIDE]
    taken = first["resultado"].where(F.col("atendimento_via") == L.INSIDE)
    assert taken.where(~F.col("cnpj_basico_distrib").isin(some)).count() == 0
    assert first["exportacao"].count() <= plain["exportacao"].count()


def test_density_uses_half_even_cells(spark):
    df = spark.createDataFrame([(0.125, 0.0), (0.1, 0.0), (None, 1.0)], "lat double, lon double")
    assert [(round(r.lat, 6), r.n) for r in market.density(df).collect()] == [(0.1, 2)]
    cells = spark.createDataFrame([("a", 0), ("b", 4)], "k string, n int")
    low = {r.k: r.limite for r in market.density_cap(cells, ["k"], at_least_one=False).collect()}
    assert low == {"a": 1.0, "b": 4.0}


def test_scans_read_only_what_a_report_needs(foco):
    from marketreach.operators import counts, indirect

    def scan(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return [line for line in plan.splitlines() if "FileScan" in line]

    rows = scan(indirect.distributors(foco, "canal", ["1-URGENT"]).select("cnpj"))
    assert len(rows) == 1 and "EqualTo(cliente_atendido,true)" in rows[0] and "EqualTo(canal,1-U" in rows[0]
    assert "ReadSchema: struct<cnpj:string,canal:string,cliente_atendido:boolean>" in rows[0]
    kpi = scan(counts.coverage(foco))
    assert len(kpi) == 1
    assert "ReadSchema: struct<cnpj:string,cnpj_basico:string,cliente_atendido:boolean>" in kpi[0]
