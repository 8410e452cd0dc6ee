"""Register extracts to the wide establishment table."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marketreach import layouts as L
from marketreach.functions.numeric import decimal_comma, register_date, small_int
from marketreach.functions.predicates import is_active
from marketreach.functions.text import pad_code
from marketreach.operators.joins import describe, keep_one, own_exchange
from marketreach.session import tune
from marketreach.sources.exports import is_written, write_table
from marketreach.sources.register import load_lookups, malformed, read_register, read_simples

ESTABLISHMENT_DATES = ["data_situacao_cadastral", "data_inicio_atividade", "data_situacao_especial"]
DROPPED = ["ddd2", "telefone2", "ddd_fax", "fax"]
SIMPLES_DATES = [
    "data_opcao_simples", "data_exclusao_simples", "data_opcao_mei", "data_exclusao_mei",
]
WIDE_FROM_HIERARCHY = L.HIERARCHY[:8]


def unique_codes(lookup: DataFrame) -> DataFrame:
    return own_exchange(keep_one(lookup, ["codigo"], [F.col("descricao")]))


def companies(raw: DataFrame, lookups: Mapping[str, DataFrame]) -> DataFrame:
    """Cleaned companies, with the legal-nature description when its table is there."""
    size = small_int(F.col("porte"))
    label = F.lit(L.SIZE_UNKNOWN)
    for code, name in L.SIZE_LABELS.items():
        label = F.when(size == code, name).otherwise(label)
    out = raw.select(
        pad_code(F.col("cnpj_basico"), 8).alias("cnpj_basico"),
        F.trim("razao_social").alias("razao_social"),
        F.trim("natureza_juridica").alias("natureza_juridica"),
        F.trim("qualificacao_responsavel").alias("qualificacao_responsavel"),
        decimal_comma(F.trim("capital_social")).alias("capital_social"),
        size.alias("porte"),
        label.alias("porte_desc"),
        F.trim("ente_federativo_responsavel").alias("ente_federativo_responsavel"),
    )
    if "naturezas" not in lookups:
        return out
    named = describe(
        out, lookups["naturezas"], "natureza_juridica", "codigo", "descricao", "natureza_juridica_desc"
    )
    return named.select(*out.columns[:-1], "natureza_juridica_desc", out.columns[-1])


def establishments(raw: DataFrame, only_active: bool = True) -> DataFrame:
    """Cleaned establishments with the composed 14-digit id; filtered before anything else."""
    rows = raw.where(is_active(F.col("situacao_cadastral"))) if only_active else raw
    widths = {"cnpj_basico": 8, "cnpj_ordem": 4, "cnpj_dv": 2}
    parts = {c: pad_code(F.col(c), n) for c, n in widths.items()}
    columns = [expr.alias(c) for c, expr in parts.items()]
    columns.append(F.concat(*parts.values()).alias("cnpj"))
    for c in L.ESTABLISHMENTS:
        if c in widths or c in DROPPED:
            continue
        if c in ESTABLISHMENT_DATES:
            expr = register_date(F.col(c))
        elif c == "cep":
            expr = pad_code(F.col(c), 8)
        else:
            expr = F.trim(c)
        columns.append(expr.alias(c))
    return rows.select(*columns)


def partners(raw: DataFrame, lookups: Mapping[str, DataFrame]) -> DataFrame:
    """Cleaned partners, with the qualification description when its table is there."""
    columns = []
    for c in L.PARTNERS:
        if c == "cnpj_basico":
            columns.append(pad_code(F.col(c), 8).alias(c))
        elif c == "data_entrada_sociedade":
            columns.append(register_date(F.col(c)).alias(c))
        else:
            columns.append(F.trim(c).alias(c))
    out = raw.select(*columns)
    if "qualificacoes" not in lookups:
        return out
    named = describe(
        out, lookups["qualificacoes"], "qualificacao_socio", "codigo", "descricao",
        "qualificacao_socio_desc",
    )
    at = out.columns.index("qualificacao_socio") + 1
    return named.select(*out.columns[:at], "qualificacao_socio_desc", *out.columns[at:])


def simples_regime(raw: DataFrame) -> DataFrame:
    """Cleaned small-business regime rows, one per company."""
    columns = [pad_code(F.col("cnpj_basico"), 8).alias("cnpj_basico")]
    for c in L.SIMPLES[1:]:
        expr = register_date(F.col(c)) if c in SIMPLES_DATES else F.trim(c)
        columns.append(expr.alias(c))
    return raw.select(*columns)


def wide_table(
    est: DataFrame,
    emp: DataFrame,
    lookups: Mapping[str, DataFrame],
    simples: DataFrame | None = None,
    hierarchy: DataFrame | None = None,
    dedupe: bool = False,
) -> DataFrame:
    """Establishments LEFT companies, regime, code tables and hierarchy.

    The two large joins share the company root and come first, so their rows move once; code
    tables follow as joins Spark broadcasts by their file size. A repeated root or code on a right
    side repeats rows, unless `dedupe`. A description column exists only when its table does;
    regime columns always exist.
    """
    firm = ["razao_social", "capital_social", "porte", "porte_desc", "natureza_juridica"]
    firm += [c for c in ("natureza_juridica_desc",) if c in emp.columns]
    firm += ["qualificacao_responsavel"]
    side = emp.select("cnpj_basico", *firm)
    if dedupe:
        side = keep_one(side, ["cnpj_basico"], [F.col(c) for c in firm])
        lookups = {name: unique_codes(df) for name, df in lookups.items()}
    out = est.join(own_exchange(side) if dedupe else side, "cnpj_basico", "left")

    if simples is None:
        types = {c: "timestamp" if c in SIMPLES_DATES else "string" for c in L.SIMPLES[1:]}
        out = out.withColumns({c: F.lit(None).cast(t) for c, t in types.items()})
    else:
        regime = simples
        if dedupe:
            regime = own_exchange(
                keep_one(simples, ["cnpj_basico"], [F.col(c) for c in L.SIMPLES[1:]])
            )
        out = out.join(regime, "cnpj_basico", "left")

    described = {
        "cnaes": ("cnae_principal", "cnae_principal_desc"),
        "municipios": ("municipio", "municipio_nome"),
        "motivos": ("motivo_situacao", "motivo_situacao_desc"),
        "paises": ("pais", "pais_nome"),
        "qualificacoes": ("qualificacao_responsavel", "qualificacao_responsavel_desc"),
    }
    names = []
    for table, (code, alias) in described.items():
        if table in lookups:
            out = describe(out, lookups[table], code, "codigo", "descricao", alias)
            names.append(alias)
    levels = []
    if hierarchy is not None:
        side = hierarchy.select(F.col("subclasse").alias("cnae_principal"), *WIDE_FROM_HIERARCHY)
        if dedupe:
            side = own_exchange(
                keep_one(side, ["cnae_principal"], [F.col(c) for c in WIDE_FROM_HIERARCHY])
            )
        out = out.join(side, "cnae_principal", "left")
        levels = WIDE_FROM_HIERARCHY
    return out.select(*est.columns, *firm, *names, *L.SIMPLES[1:], *levels)


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their row counts."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("linhas"))
    return counts.where(F.col("linhas") > 1)


def run_register(
    spark: SparkSession,
    companies_dir: str,
    establishments_dir: str,
    partners_dir: str,
    lookups_dir: str,
    output: str,
    only_active: bool = True,
    include_partners: bool = True,
    include_simples: bool = True,
    hierarchy: DataFrame | None = None,
    companies_mode: str = "ignore",
    dedupe: bool = False,
    partition_by: str | None = None,
    line_breaks: bool = False,
    report_dropped: bool = True,
) -> dict[str, str]:
    """Write companies, establishments, partners and the wide table; returns their paths.

    `line_breaks` is for extracts whose quoted fields hold line breaks; their quotes must be balanced.
    `report_dropped` writes the records with a wrong number of fields (`tabela, file, record`), at the
    price of one more pass over the text files; with `line_breaks`, which counts such records while it
    reads, of those tables only that have some.

    Stages are written as Parquet and read back, so the text files are parsed once and a lost
    executor repeats only its part of the stage. `companies_mode="ignore"` keeps an existing stage.
    """
    tune(spark)
    lookups = load_lookups(spark, lookups_dir)
    extracts = {
        "empresas": (companies_dir, L.COMPANIES),
        "estabelecimentos": (establishments_dir, L.ESTABLISHMENTS),
    }
    if include_partners:
        extracts["socios"] = (partners_dir, L.PARTNERS)
    counted: dict[str, Observation] = {}
    if report_dropped and line_breaks:
        # a stage that is kept is not read, so nothing is counted for it
        kept = {"empresas"} if companies_mode == "ignore" and is_written(spark, f"{output}/empresas") else set()
        counted = {name: Observation() for name in extracts if name not in kept}
    raw = {
        name: read_register(spark, *extract, line_breaks=line_breaks, dropped=counted.get(name))
        for name, extract in extracts.items()
    }
    paths = {
        "empresas": write_table(
            companies(raw["empresas"], lookups), f"{output}/empresas", companies_mode
        ),
        "estabelecimentos": write_table(
            establishments(raw["estabelecimentos"], only_active), f"{output}/estabelecimentos"
        ),
    }
    if include_partners:
        paths["socios"] = write_table(partners(raw["socios"], lookups), f"{output}/socios")
    if report_dropped:
        dropped = [
            malformed(spark, *extract, line_breaks=line_breaks).select(F.lit(name).alias("tabela"), "file", "record")
            for name, extract in extracts.items()
            if name not in counted or counted[name].get["n"] > 0
        ]
        none = spark.range(0).select(*[F.lit("").alias(c) for c in ("tabela", "file", "record")])
        paths["descartados"] = write_table(reduce(DataFrame.unionByName, dropped, none), f"{output}/descartados")

    raw_simples = read_simples(spark, lookups_dir, line_breaks) if include_simples else None
    wide = wide_table(
        spark.read.parquet(paths["estabelecimentos"]),
        spark.read.parquet(paths["empresas"]),
        lookups,
        simples_regime(raw_simples) if raw_simples is not None else None,
        hierarchy,
        dedupe,
    )
    paths["unificada"] = write_table(wide, f"{output}/base_unificada", partition_by=partition_by)
    return paths


def rebuild_wide(spark: SparkSession, output: str, lookups_dir: str, **options) -> DataFrame:
    """The wide table from stages written earlier."""
    return wide_table(
        spark.read.parquet(f"{output}/estabelecimentos"),
        spark.read.parquet(f"{output}/empresas"),
        load_lookups(spark, lookups_dir),
        **options,
    )
