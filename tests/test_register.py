"""Hand-written register extracts through the whole job."""

import pytest
from pyspark.sql import functions as F

from marketreach import layouts as L
from marketreach.plans import register
from marketreach.sources.register import inventory, list_files, load_lookups, malformed, read_register


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes("".join(line + "\n" for line in lines).encode("latin-1"))


def establishment(**fields):
    return ";".join(f'"{fields.get(c, "")}"' for c in L.ESTABLISHMENTS)


@pytest.fixture
def landing(tmp_path):
    root = tmp_path / "landing"
    write(
        root / "empresas" / "Empresas0.csv",
        [
            '"1";" AÇÃO ""X"" LTDA ";"2062";"49";"1000,50";"01";""',
            '"00000002";"BETA";"9999";"50";"1.000,00";"3";"UNIAO"',
            '"3";"GAMA";"2062";"49";"abc";"";""',
            '"curta";"so dois"',
            '"longa";"a";"b";"c";"1,0";"05";"";"extra"',
        ],
    )
    write(root / "empresas" / "Empresas1.csv", ['"3";"GAMA BIS";"2062";"49";"5,0";"05";""'])
    write(
        root / "estab" / "Estabelecimentos0.csv",
        [
            establishment(
                cnpj_basico="1", cnpj_ordem="1", cnpj_dv="9", situacao_cadastral="02", cnae_principal="4744099",
                nome_fantasia=" Loja Pão ", cep="1310100", uf="SP", municipio="7107", motivo_situacao="00",
                pais="105", data_inicio_atividade="20240229", data_situacao_cadastral="20240230",
            ),
            establishment(
                cnpj_basico="00000003", cnpj_ordem="0001", cnpj_dv="10", situacao_cadastral=" 02 ",
                cnae_principal="0000000", municipio="9999", data_inicio_atividade="00000000",
                data_situacao_especial="0",
            ),
            establishment(cnpj_basico="4", cnpj_ordem="1", cnpj_dv="1", situacao_cadastral="08"),
            establishment(cnpj_basico="5", cnpj_ordem="1", cnpj_dv="1", situacao_cadastral="02"),
        ],
    )
    write(
        root / "socios" / "Socios0.csv",
        ['"1";"2";"JOSÉ ";"***1**";"49";"20200101";"";"";"";"00";"4"', '"2";"2";"ANA";"";"77";"";"";"";"";"00";"4"'],
    )
    aux = root / "aux"
    write(aux / "F.K03200$Z.D1.CNAECSV.csv", ['"4744099";" Comércio varejista "', '"ruim"'])
    write(aux / "F.MUNICCSV.csv", ['"7107";"SÃO PAULO"'])
    write(aux / "F.NATJUCSV.csv", ['"2062";"Sociedade Empresária Limitada"'])
    write(aux / "F.QUALSCSV.csv", ['"49";"Sócio-Administrador"'])
    write(aux / "F.SIMPLES.csv", ['"1";"S";"20070701";"00000000";"N";"";""'])
    return root


def run(spark, landing, tmp_path, **options):
    return register.run_register(
        spark, str(landing / "empresas"), str(landing / "estab"), str(landing / "socios"),
        str(landing / "aux"), str(tmp_path / "out"), **options,
    )


def test_malformed_rows_are_dropped_whatever_is_selected(spark, landing):
    df = read_register(spark, str(landing / "empresas"), L.COMPANIES)
    assert df.count() == 4
    assert df.select("cnpj_basico").count() == 4
    assert sorted(r[0] for r in df.select("cnpj_basico").collect()) == ["00000002", "1", "3", "3"]


def test_lookups_found_by_name(spark, landing):
    lookups = load_lookups(spark, str(landing / "aux"))
    assert sorted(lookups) == ["cnaes", "municipios", "naturezas", "qualificacoes"]
    assert [tuple(r) for r in lookups["cnaes"].collect()] == [("4744099", "Comércio varejista")]
    assert load_lookups(spark, str(landing / "nowhere")) == {}


def test_whole_job(spark, landing, tmp_path):
    paths = run(spark, landing, tmp_path)
    emp = {r.cnpj_basico + r.razao_social: r for r in spark.read.parquet(paths["empresas"]).collect()}
    assert set(emp) == {'00000001AÇÃO "X" LTDA', "00000002BETA", "00000003GAMA", "00000003GAMA BIS"}
    assert emp["00000002BETA"].capital_social is None and emp["00000002BETA"].porte_desc == "Empresa de Pequeno Porte"
    assert emp["00000003GAMA"].porte is None and emp["00000003GAMA"].porte_desc == "Não Informado"
    assert emp["00000002BETA"].natureza_juridica_desc is None

    wide = spark.read.parquet(paths["unificada"])
    rows = wide.collect()
    assert len(rows) == 4  # 1, 5 and the repeated root 3 twice; the inactive 4 is out
    one = next(r for r in rows if r.cnpj_basico == "00000001")
    assert one.cnpj == "00000001000109" and one.cep == "01310100" and one.nome_fantasia == "Loja Pão"
    assert one.razao_social == 'AÇÃO "X" LTDA' and one.capital_social == 1000.5 and one.porte == 1
    assert one.cnae_principal_desc == "Comércio varejista" and one.municipio_nome == "SÃO PAULO"
    assert one.qualificacao_responsavel_desc == "Sócio-Administrador"
    assert str(one.data_inicio_atividade) == "2024-02-29 00:00:00" and one.data_situacao_cadastral is None
    assert one.opcao_simples == "S" and str(one.data_opcao_simples)[:10] == "2007-07-01"
    assert one.data_exclusao_simples is None
    five = next(r for r in rows if r.cnpj_basico == "00000005")
    assert five.razao_social is None and five.opcao_mei is None
    assert "pais_nome" not in wide.columns and "secao" not in wide.columns
    assert wide.columns[-6:] == L.SIMPLES[1:]
    dropped = spark.read.parquet(paths["descartados"]).collect()
    assert sorted(tuple(r) for r in dropped) == [
        ("empresas", "Empresas0.csv", '"curta";"so dois"'), ("empresas", "Empresas0.csv", '"longa";"a";"b";"c";"1,0";"05";"";"extra"'),
    ]

    socios = {r.nome_socio: r for r in spark.read.parquet(paths["socios"]).collect()}
    assert socios["JOSÉ"].qualificacao_socio_desc == "Sócio-Administrador"
    assert socios["ANA"].qualificacao_socio_desc is None and socios["ANA"].data_entrada_sociedade is None


def test_options(spark, landing, tmp_path):
    hier = spark.createDataFrame(
        [("G", "s", "47", "d", "47.4", "g", "4744", "c", "4744099", "4744-0/99", "x")], L.text_schema(L.HIERARCHY)
    )
    paths = run(
        spark, landing, tmp_path, only_active=False, include_partners=False, include_simples=False,
        hierarchy=hier, dedupe=True, partition_by="uf", line_breaks=True, report_dropped=False,
    )
    assert "socios" not in paths and "descartados" not in paths
    wide = spark.read.parquet(paths["unificada"])
    assert wide.count() == 4 and wide.where("classe = '4744'").count() == 1
    assert dict(wide.dtypes)["data_opcao_mei"] == "timestamp" and wide.where("opcao_simples is not null").count() == 0
    again = register.rebuild_wide(spark, str(tmp_path / "out"), str(landing / "aux"), dedupe=True)
    assert again.count() == 4 and "secao" not in again.columns


def test_existing_company_stage_is_kept(spark, landing, tmp_path):
    paths = run(spark, landing, tmp_path)
    write(landing / "empresas" / "Empresas2.csv", ['"9";"NOVA";"2062";"49";"1";"01";""'])
    run(spark, landing, tmp_path)
    assert spark.read.parquet(paths["empresas"]).count() == 4
    run(spark, landing, tmp_path, companies_mode="overwrite")
    assert spark.read.parquet(paths["empresas"]).count() == 5


def test_repeated_roots_are_reported(spark, landing):
    raw = read_register(spark, str(landing / "empresas"), L.COMPANIES)
    emp = register.companies(raw, {})
    assert [tuple(r) for r in register.repeated_keys(emp, "cnpj_basico").collect()] == [("00000003", 2)]


def test_inventory(spark, tmp_path):
    for name in ("Empresas0.csv", "empresas1.zip", "Estabelecimentos3.csv", "Socios1.csv", "Cnaes.csv"):
        write(tmp_path / "in" / name, ["x"])
    got = {r.grupo: (r.arquivos, r.bytes) for r in inventory(list_files(spark, str(tmp_path / "in"))).collect()}
    assert got == {"empresas": (2, 4), "estabelecimentos": (1, 2), "socios": (1, 2), "auxiliares": (1, 2)}


def test_null_root_stays_unmatched(spark):
    est = spark.createDataFrame([(None, "a"), ("1", "b")], "cnpj_basico string, cnpj string")
    emp = spark.createDataFrame(
        [(None, "x"), ("1", "y")], "cnpj_basico string, razao_social string"
    ).withColumns(
        {c: F.lit(None).cast("string") for c in ("capital_social", "porte", "porte_desc", "natureza_juridica", "qualificacao_responsavel")}
    )
    got = {r.cnpj: r.razao_social for r in register.wide_table(est, emp, {}).collect()}
    assert got == {"a": None, "b": "y"}


def test_no_record_is_dropped_unseen(spark, landing, tmp_path):
    columns = ["a", "b", "c", "d", "e", "f", "g"]
    folder = str(landing / "empresas")
    dropped = malformed(spark, folder, columns).collect()
    assert sorted((r.file, r.record) for r in dropped) == [
        ("Empresas0.csv", '"curta";"so dois"'), ("Empresas0.csv", '"longa";"a";"b";"c";"1,0";"05";"";"extra"'),
    ]
    write(tmp_path / "quoted" / "q.csv", ['"1";"duas', 'linhas"', '"2";"uma"'])
    where = str(tmp_path / "quoted")
    whole = read_register(spark, where, ["a", "b"], line_breaks=True)
    assert sorted(tuple(r) for r in whole.collect()) == [("1", "duas\nlinhas"), ("2", "uma")]
    assert malformed(spark, where, ["a", "b"], line_breaks=True).count() == 0
    assert malformed(spark, where, ["a", "b"]).count() > 0


def test_tables_without_wrong_records_are_read_once(spark, landing, tmp_path, monkeypatch):
    """With line breaks such records are counted while the stage is written; only tables that hold some are read again."""
    again = []
    monkeypatch.setattr(register, "malformed", lambda s, folder, *a, **o: again.append(folder) or malformed(s, folder, *a, **o))

    def job():
        return register.run_register(
            spark, *[str(landing / d) for d in ("empresas", "estab", "socios", "aux")], str(tmp_path / "out"), line_breaks=True
        )

    paths = job()
    dropped = sorted((r.tabela, r.file) for r in spark.read.parquet(paths["descartados"]).collect())
    assert dropped == [("empresas", "Empresas0.csv")] * 2 and again == [str(landing / "empresas")]
    write(landing / "estab" / "Estabelecimentos1.csv", ['"1";"so dois"'])
    del again[:]
    job()  # the stage of the companies is kept, so nothing is counted for it
    found = sorted((r.tabela, r.file) for r in spark.read.parquet(paths["descartados"]).collect())
    assert found == [*dropped, ("estabelecimentos", "Estabelecimentos1.csv")] and len(again) == 2
    write(landing / "empresas" / "Empresas0.csv", ['"2";"BETA";"9999";"50";"1,00";"3";""'])
    (landing / "estab" / "Estabelecimentos1.csv").write_text("")
    job()
    assert spark.read.parquet(paths["descartados"]).count() == 0
    assert spark.read.parquet(paths["descartados"]).columns == ["tabela", "file", "record"]
