"""Hot keys: the joins split them at run time, and results stay whole."""

import contextlib

import pytest
from pyspark.sql import functions as F

from marketreach.operators import focus, indirect, joins, postal, segments, uploads
from marketreach.plans import register
from marketreach.session import stage

TINY = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
}
ROWS, HOT = 30_000, 10_000


@contextlib.contextmanager
def settings(spark, values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    """A third of all establishments belong to one company root."""
    path = str(tmp_path_factory.mktemp("hot") / "rows")
    n = F.col("id")
    root = F.when(n < HOT, "00000007").otherwise(F.lpad((n % 5000 + 100).cast("string"), 8, "0"))
    spark.range(ROWS).select(
        F.concat(root, F.lpad(n.cast("string"), 6, "0")).alias("cnpj"),
        root.alias("cnpj_basico"),
        (n % 1000 == 3).alias("cliente_atendido"),
        F.md5(n.cast("string")).alias("nome_fantasia"),
    ).repartition(8).write.parquet(path)
    return spark.read.parquet(path)


def collect_plan(df):
    result = df.collect()
    return result, df._jdf.queryExecution().executedPlan().toString()


def test_company_mark_splits_a_hot_root(spark, rows):
    with settings(spark, TINY):
        out, plan = collect_plan(focus.mark_company(rows))
    assert "skew=true" in plan
    assert len(out) == ROWS
    served = {r.cnpj[:8] for r in rows.where("cliente_atendido").collect()}
    assert all(r.empresa_base_atendida == (r.cnpj[:8] in served) for r in out)
    assert sum(r.cnpj_basico == "00000007" for r in out) == HOT


def test_company_join_splits_a_hot_root(spark, rows):
    missing = ["capital_social", "porte", "porte_desc", "natureza_juridica", "qualificacao_responsavel"]
    firms = rows.select("cnpj_basico").distinct().withColumn("razao_social", F.md5("cnpj_basico"))
    dates = {c: F.lit(None).cast("timestamp") for c in register.SIMPLES_DATES}
    regime = rows.select("cnpj_basico").distinct().withColumns(
        {"opcao_simples": F.lit("S"), "opcao_mei": F.lit("N"), **dates}
    )
    regime = stage(regime)
    firms = stage(firms.withColumns({c: F.lit(None).cast("string") for c in missing}))
    with settings(spark, TINY):
        for dedupe in (False, True):
            out, plan = collect_plan(register.wide_table(rows, firms, {}, regime, dedupe=dedupe))
            assert plan.split("Initial Plan")[0].count("SortMergeJoin(skew=true)") == 2
            assert len(out) == ROWS and all(r.razao_social and r.opcao_mei == "N" for r in out)


def test_upload_totals_with_a_hot_customer(spark, rows):
    upload = rows.select(
        F.monotonically_increasing_id().alias("linha"),
        F.when(F.col("cnpj_basico") == "00000007", "1").otherwise(F.col("cnpj")).alias("id"),
        F.lit("1,5").alias("valor"),
        F.col("nome_fantasia").alias("obs"),
    )
    base = rows.select("cnpj", F.lit("SP").alias("uf"))
    with settings(spark, TINY):
        out, plan = collect_plan(uploads.enrich_all(upload, base, "id", "valor"))
    assert plan.split("Initial Plan")[0].count("SortMergeJoin(skew=true)") == 2 and len(out) == ROWS
    assert sum(r.VALOR_TOTAL == 1.5 * HOT for r in out) == HOT


def test_prefix_join_with_a_hot_prefix(spark, rows):
    cep = F.when(F.col("cnpj_basico") == "00000007", "01310100").otherwise(F.substring("cnpj", 3, 8))
    cache = spark.createDataFrame([("01310", -23.0, -46.0)], "cep5 string, lat double, lon double")
    out = postal.attach_prefix_coordinates(rows.withColumn("cep", cep), cache)
    assert out.count() == ROWS and out.where("lat = -23.0").count() == HOT


def test_labels_regions_and_places_with_hot_keys(spark, rows):
    hot = F.when(F.col("cnpj_basico") == "00000007", "1").otherwise(F.col("cnpj"))
    work = rows.withColumn("id", hot)
    members = segments.membership(work, "id", F.col("cliente_atendido"), F.lit(False), F.lit(False))
    places = rows.withColumns(
        {"uf": F.lit("SP"), "municipio_nome": F.when(hot == "1", "Sao Paulo").otherwise(F.col("cnpj_basico"))}
    )
    points = places.select(
        F.upper("municipio_nome").alias("NM_MUN"), F.col("uf").alias("SIGLA_UF"), F.lit("1").alias("CD_MUN"),
        F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"),
    )
    with settings(spark, TINY):
        labelled, plan = collect_plan(segments.label_region(work, members, "id", 1, "A"))
        assert "skew=true" in plan and sum(r.segmentacao == "A" for r in labelled) >= HOT
        ranked, plan = collect_plan(segments.region_rows(work, members, "id"))
        assert "skew=true" in plan and sum(r.id == "1" for r in ranked) == HOT
        placed, plan = collect_plan(joins.attach_place(places, points))
        assert "skew=true" in plan and all(r.lat == 1.0 for r in placed)


def test_nearest_with_a_third_of_the_clients_in_one_place(spark, rows):
    n = F.conv(F.substring(F.md5("cnpj"), 1, 6), 16, 10).cast("double")
    hot = F.col("cnpj_basico") == "00000007"
    finals = rows.select(
        "cnpj",
        F.when(hot, -23.5).otherwise(n % 600 / 10 - 30).alias("lat"),
        F.when(hot, -46.6).otherwise(n % 770 / 11 - 60).alias("lon"),
        "nome_fantasia",
    )
    sites = spark.createDataFrame(
        [(f"{i:04d}", "r", "n", "z", -23.5 + i * 1e-4, -46.6) for i in range(2000)],
        "cnpj string, cnpj_basico string, nome_fantasia string, razao_social string, lat double, lon double",
    )
    with settings(spark, TINY):
        out, plan = collect_plan(indirect.allocate(finals, sites, 150.0))
    assert "skew=true" in plan and len(out) == ROWS
    assert sum(r.dist_km_min == 0.0 and r.cnpj_distrib_proximo == "0000" for r in out) >= HOT


def test_enrichment_with_a_hot_id(spark, rows):
    """Without a broadcast both sides shuffle on the id and results are the same."""
    upload = rows.select(
        F.when(F.col("cnpj_basico") == "00000007", "1").otherwise(F.col("cnpj")).alias("id"),
        F.col("nome_fantasia").alias("obs"),
    )
    base = rows.select("cnpj", F.lit("SP").alias("uf"))
    with settings(spark, TINY):
        out, plan = collect_plan(uploads.enrich(upload, base, "id"))
    assert "BroadcastHashJoin" not in plan and "skew=true" in plan
    assert len(out) == ROWS and sum(r.uf is None for r in out) == HOT


def test_register_is_filtered_before_it_moves(spark, tmp_path):
    """The customer list drops register rows below the exchange of the join, and loses no match."""
    n = 200_000
    base = spark.range(n).select(F.lpad(F.col("id").cast("string"), 14, "0").alias("cnpj"), F.lit("47").alias("cnae_principal"))
    base.write.parquet(str(tmp_path / "base"))
    base = spark.read.parquet(str(tmp_path / "base"))
    upload = spark.range(0, n + 5000, 1009).select(F.col("id").cast("string").alias("CNPJ"), F.lit("1,5").alias("valor"))
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}):
        df = uploads.enrich(upload, base, "CNPJ")
        out, plan = collect_plan(df)
    assert sum(r.cnae_principal is not None for r in out) == len(range(0, n, 1009)) and len(out) == upload.count()
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "getbit" in line)
    assert "Project" in lines[at - 1] and "Exchange hashpartitioning(_id" in lines[at - 2]
    ids = joins.with_id(upload, "CNPJ")
    assert base.where(joins.key_filter(ids, "_id")(F.col("cnpj"))).count() < 2 * upload.count()
    assert base.where(joins.key_filter(ids.where("false"), "_id")(F.col("cnpj"))).count() == 0
    full = spark.range(3_000_000).select(F.col("id").cast("string").alias("_id"))
    assert full.where(joins.key_filter(full, "_id")(F.col("_id"))).count() == 3_000_000
