"""Register-shaped views derived from the whole driver tables.

`VIEWS_SQL` states the same views for the SQL side. Every part stands for an establishment; the customer
with its key, if there is one, gives name, capital, size and state. Companies hold one establishment in
997, so that served and unserved ones share companies and towns. The customer list holds every order, with
ids and amounts written the way uploads write them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketreach.functions.text import class_of
from marketreach.operators.focus import mark_company, mark_served
from marketreach.operators.uploads import per_customer

ROOTS = 997  # companies per block of a thousand establishments each
SELLER = ["1-URGENT"]


# Schemas of the driver tables in use: a given schema saves the job that reads footers for one.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def codes(spark: SparkSession, folder: str) -> DataFrame:
    """Trade name, 7-digit code and its description per part."""
    part = table(spark, folder, "part")
    kinds = part.select("p_type").distinct().withColumn(
        "_t", F.row_number().over(Window.orderBy("p_type"))
    )
    return part.join(kinds, "p_type").select(
        F.col("p_partkey").alias("pk"),
        "p_name",
        "p_retailprice",
        F.concat(
            F.lit("47"),
            F.lpad(F.substring("p_brand", 7, 2), 2, "0"),
            F.lpad(F.col("_t").cast("string"), 3, "0"),
        ).alias("code"),
        F.concat_ws(" ", "p_type", "p_brand").alias("code_desc"),
    )


def _cnpj(k: str):
    """Root and id of an establishment; `VIEWS_SQL` has the same rule in `_CNPJ`."""
    root = F.lpad(F.expr(f"cast(({k} div {ROOTS * 1000}) * {ROOTS} + {k} % {ROOTS} as string)"), 8, "0")
    order = F.lpad(F.expr(f"cast(({k} % {ROOTS * 1000}) div {ROOTS} + 1 as string)"), 4, "0")
    check = F.lpad(F.expr(f"cast({k} % 97 as string)"), 2, "0")
    return root, F.concat(root, order, check)


def est(
    spark: SparkSession, folder: str, secondary: bool = False, opened: bool = False
) -> DataFrame:
    """Wide establishment table; secondary codes and opening dates are added on request."""
    own = codes(spark, folder)
    customer = table(spark, folder, "customer").withColumnRenamed("c_custkey", "k")
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = own.withColumnRenamed("pk", "k").join(customer, "k", "left")
    rows = rows.withColumn("c_nationkey", F.coalesce("c_nationkey", (F.col("k") % 25).cast("int")))
    rows = rows.join(nation, "c_nationkey")
    more = []
    if secondary:
        for shift in (1, 2):
            next_code = own.select((F.col("pk") - shift).alias("k"), F.col("code").alias(f"_c{shift}"))
            rows = rows.join(next_code, "k", "left")
        more.append(F.concat_ws(",", "_c1", "_c2").alias("cnaes_secundarios"))
    if opened:
        first = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
            F.min("o_orderdate").alias("data_inicio_atividade")
        )
        rows = rows.join(first, "k", "left")
        more.append(F.col("data_inicio_atividade"))
    k = F.col("k")
    root, cnpj = _cnpj("k")
    located = k % 50 != 0
    cep = F.concat(
        F.lpad(((k * 37) % 2000).cast("string"), 5, "0"),
        F.lit("-"),
        F.lpad((k % 7).cast("string"), 3, "0"),
    )
    return rows.select(
        "k",
        root.alias("cnpj_basico"),
        cnpj.alias("cnpj"),
        F.coalesce("c_name", "p_name").alias("razao_social"),
        F.when(k % 11 == 0, None).when(k % 13 == 0, "  ").otherwise(F.col("p_name")).alias("nome_fantasia"),
        F.coalesce("c_acctbal", "p_retailprice").alias("capital_social"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Micro Empresa")
        .when(F.col("c_mktsegment") == "MACHINERY", "Empresa de Pequeno Porte")
        .when(F.col("c_mktsegment") == "AUTOMOBILE", "Demais")
        .when(F.col("c_mktsegment") == "FURNITURE", "Não Informado")
        .alias("porte_desc"),
        F.col("code").alias("cnae_principal"),
        F.col("code_desc").alias("cnae_principal_desc"),
        F.col("n_name").alias("uf"),
        F.concat(F.lit("MUN_"), (k % 20).cast("string")).alias("municipio_nome"),
        F.when(k % 17 == 0, None).when(k % 19 == 0, "S/N").otherwise(cep).alias("cep"),
        F.when(located, F.lit(-30.0) + F.col("c_nationkey") * 1.2 + (k % 20) * 0.13).alias("lat"),
        F.when(located, F.lit(-60.0) + (F.col("c_nationkey") % 5) * 4.0 + (k % 20) * 0.17).alias("lon"),
        *more,
    )


def upload(spark: SparkSession, folder: str) -> DataFrame:
    """Customer list: punctuated ids, decimal-comma amounts, several rows per id."""
    orders = table(spark, folder, "orders")
    root, cnpj = _cnpj("o_custkey")
    written = F.concat(
        F.substring(cnpj, 1, 8), F.lit("/"), F.substring(cnpj, 9, 4), F.lit("-"), F.substring(cnpj, 13, 2)
    )
    return orders.select(
        F.col("o_orderkey").alias("linha"),
        written.alias("CNPJ"),
        F.replace(F.col("o_totalprice").cast("string"), F.lit("."), F.lit(",")).alias("valor"),
        F.col("o_orderpriority").alias("canal"),
        F.col("o_orderstatus").alias("segmento"),
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return per_customer(upload(spark, folder), "CNPJ", "valor", ["canal", "segmento"], "linha")


def foco(spark: SparkSession, folder: str) -> DataFrame:
    """Focus table over all classes."""
    return mark_company(mark_served(est(spark, folder), customers(spark, folder)))


def hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Activity hierarchy of the codes in use: section by brand band."""
    c = codes(spark, folder).groupBy("code").agg(F.min("code_desc").alias("subclasse_desc"))
    band = F.substring("code", 3, 1)
    return c.select(
        F.translate(band, "012", "ABC").alias("secao"),
        F.concat(F.lit("Faixa "), band).alias("secao_desc"),
        F.substring("code", 1, 2).alias("divisao"),
        F.concat(F.lit("Divisao "), F.substring("code", 1, 2)).alias("divisao_desc"),
        F.substring("code", 1, 3).alias("grupo"),
        F.concat(F.lit("Grupo "), F.substring("code", 1, 3)).alias("grupo_desc"),
        class_of(F.col("code")).alias("classe"),
        F.concat(F.lit("Classe "), class_of(F.col("code"))).alias("classe_desc"),
        F.col("code").alias("subclasse"),
        F.concat(
            F.substring("code", 1, 4), F.lit("-"), F.substring("code", 5, 1), F.lit("/"), F.substring("code", 6, 2)
        ).alias("subclasse_cod"),
        "subclasse_desc",
    )


def centroids(spark: SparkSession, folder: str) -> DataFrame:
    """One point per municipality, names written with an accent."""
    places = est(spark, folder).where(F.col("lat").isNotNull()).groupBy("municipio_nome", "uf").agg(
        F.min("lat").alias("lat"), F.min("lon").alias("lon")
    )
    return places.select(
        F.replace(F.lower("municipio_nome"), F.lit("mun"), F.lit("mún")).alias("NM_MUN"),
        F.lower("uf").alias("SIGLA_UF"),
        F.concat_ws("/", "uf", "municipio_nome").alias("CD_MUN"),
        "lat",
        "lon",
    )


def cache(spark: SparkSession, folder: str) -> DataFrame:
    """Prefix cache: found, not found and failed prefixes, with some absent."""
    n = F.col("cep5").try_cast("int")
    kind = n % 5
    prefixes = est(spark, folder).where(F.col("cep").like("%-%")).select(
        F.substring("cep", 1, 5).alias("cep5")
    ).distinct().where(kind != 4)
    ok = kind < 2
    empty = F.lit("")
    return prefixes.select(
        "cep5",
        F.concat("cep5", F.lit("000")).alias("cep_usado"),
        F.when(ok, F.lit(-20.0) - n * 0.005).alias("lat"),
        F.when(ok, F.lit(-45.0) - n * 0.004).alias("lon"),
        empty.alias("logradouro"),
        empty.alias("bairro"),
        F.concat(F.lit("L"), "cep5").alias("localidade"),
        empty.alias("uf"),
        F.when(ok, "ok").when(kind == 2, "not_found").otherwise("error").alias("status"),
        F.lit("2024-01-01T00:00:00").alias("timestamp"),
    )


_ROOT = f"lpad(CAST((k // {ROOTS * 1000}) * {ROOTS} + k % {ROOTS} AS VARCHAR), 8, '0')"
_CNPJ = (
    f"{_ROOT} || lpad(CAST((k % {ROOTS * 1000}) // {ROOTS} + 1 AS VARCHAR), 4, '0')"
    " || lpad(CAST(k % 97 AS VARCHAR), 2, '0')"
)
VIEWS_SQL = f"""
kinds AS (SELECT p_type, lpad(CAST(row_number() OVER (ORDER BY p_type) AS VARCHAR), 3, '0') AS t
          FROM (SELECT DISTINCT p_type FROM part)),
codes AS (SELECT p_partkey AS pk, p_name, '47' || lpad(substr(p_brand, 7, 2), 2, '0') || t AS code,
                 p_type || ' ' || p_brand AS code_desc
          FROM part JOIN kinds USING (p_type)),
opened AS (SELECT o_custkey AS k, min(o_orderdate) AS d FROM orders GROUP BY o_custkey),
ids AS (SELECT *, {_ROOT} AS root, {_CNPJ} AS cnpj
        FROM (SELECT p_partkey AS k, c_name, coalesce(c_acctbal, p_retailprice) AS c_acctbal, c_mktsegment, coalesce(c_nationkey, p_partkey % 25) AS c_nationkey
              FROM part LEFT JOIN customer ON c_custkey = p_partkey)),
est AS (SELECT k, root AS cnpj_basico, cnpj, coalesce(c_name, own.p_name) AS razao_social,
               CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN '  ' ELSE own.p_name END AS nome_fantasia,
               c_acctbal AS capital_social,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'Micro Empresa' WHEN 'MACHINERY' THEN 'Empresa de Pequeno Porte'
                    WHEN 'AUTOMOBILE' THEN 'Demais' WHEN 'FURNITURE' THEN 'Não Informado' END AS porte_desc,
               own.code AS cnae_principal, own.code_desc AS cnae_principal_desc,
               concat_ws(',', s1.code, s2.code) AS cnaes_secundarios,
               n_name AS uf, 'MUN_' || CAST(k % 20 AS VARCHAR) AS municipio_nome,
               CASE WHEN k % 17 = 0 THEN NULL WHEN k % 19 = 0 THEN 'S/N'
                    ELSE lpad(CAST((k * 37) % 2000 AS VARCHAR), 5, '0') || '-' || lpad(CAST(k % 7 AS VARCHAR), 3, '0') END AS cep,
               opened.d AS data_inicio_atividade,
               CASE WHEN k % 50 <> 0 THEN -30e0 + c_nationkey * 1.2e0 + (k % 20) * 0.13e0 END AS lat,
               CASE WHEN k % 50 <> 0 THEN -60e0 + (c_nationkey % 5) * 4e0 + (k % 20) * 0.17e0 END AS lon
        FROM ids JOIN nation ON n_nationkey = c_nationkey
        JOIN codes own ON own.pk = k LEFT JOIN codes s1 ON s1.pk = k + 1 LEFT JOIN codes s2 ON s2.pk = k + 2
        LEFT JOIN opened USING (k)),
upload AS (SELECT o_orderkey AS linha, {_CNPJ} AS cnpj, o_totalprice AS valor, o_orderpriority AS canal, o_orderstatus AS segmento
           FROM (SELECT *, o_custkey AS k FROM orders)),
customers AS (SELECT cnpj, sum(valor) AS v, arg_min(canal, linha) AS canal, arg_min(segmento, linha) AS segmento
              FROM upload GROUP BY cnpj),
marked AS (SELECT est.*, customers.v AS relevancia_valor, customers.canal, customers.segmento,
                  customers.cnpj IS NOT NULL AS cliente_atendido
           FROM est LEFT JOIN customers USING (cnpj)),
foco AS (SELECT *, bool_or(cliente_atendido) OVER (PARTITION BY cnpj_basico) AS empresa_base_atendida FROM marked),
hier AS (SELECT DISTINCT code AS subclasse, code_desc AS subclasse_desc, translate(substr(code, 3, 1), '012', 'ABC') AS secao,
                'Faixa ' || substr(code, 3, 1) AS secao_desc, left(code, 2) AS divisao, left(code, 3) AS grupo,
                left(code, 4) AS classe FROM codes),
centroids AS (SELECT municipio_nome, uf, uf || '/' || municipio_nome AS cd_mun, min(lat) AS clat, min(lon) AS clon
              FROM est WHERE lat IS NOT NULL GROUP BY municipio_nome, uf),
cache AS (SELECT cep5, n % 5 AS kind, CASE WHEN n % 5 < 2 THEN -20e0 - n * 0.005e0 END AS lat,
                 CASE WHEN n % 5 < 2 THEN -45e0 - n * 0.004e0 END AS lon,
                 CASE WHEN n % 5 < 2 THEN 'ok' WHEN n % 5 = 2 THEN 'not_found' ELSE 'error' END AS status
          FROM (SELECT DISTINCT left(cep, 5) AS cep5, CAST(left(cep, 5) AS INTEGER) AS n FROM est WHERE cep LIKE '%-%')
          WHERE n % 5 <> 4)
"""
