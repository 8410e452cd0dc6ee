"""Refreshes of a landing folder against the whole register job over the same files."""

import json

import pytest
from pyspark.sql import functions as F

from marketreach.plans import landing, register
from test_register import establishment, write


def company(root, name, size="01"):
    return f'"{root}";"{name}";"2062";"49";"1,0";"{size}";""'


def place(root, order="1", **fields):
    return establishment(cnpj_basico=root, cnpj_ordem=order, cnpj_dv="1", situacao_cadastral="02", **fields)


@pytest.fixture
def landed(spark, tmp_path):
    root, out = tmp_path / "landing", str(tmp_path / "out")
    write(root / "empresas" / "Empresas0.csv", [company("00100001", "UM"), company("00200001", "DOIS"), company("x", "ODD")])
    write(root / "estab" / "Estabelecimentos 0.csv", [place("00100001"), place("00200001"), place("x"), place("00300001")])
    write(root / "aux" / "F.NATJUCSV.csv", ['"2062";"Limitada"'])

    def refresh(**options):
        return landing.refresh(spark, *[str(root / d) for d in ("empresas", "estab", "aux")], out, **options)

    def whole(name):
        paths = register.run_register(
            spark, str(root / "empresas"), str(root / "estab"), str(root / "socios"), str(root / "aux"),
            str(tmp_path / name), include_partners=False, report_dropped=False,
        )
        return rows(spark.read.parquet(paths["unificada"]))

    return root, out, refresh, whole


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.select(sorted(set(df.columns) - {"faixa"})).collect()))


def ranges(spark, out):
    return [r.faixas for r in landing.refreshes(spark, out).orderBy("rodada").collect()]


def test_a_new_file_rebuilds_its_ranges_only(spark, landed):
    root, out, refresh, whole = landed
    assert refresh() == 0 and refresh() is None
    assert rows(landing.read_wide(spark, out)) == whole("w0")
    write(root / "empresas" / "Empresas1.csv", [company("00300001", "TRES")])
    assert refresh() == 1
    assert ranges(spark, out)[1] == ["003"]
    assert rows(landing.read_wide(spark, out)) == whole("w1")
    assert {r.razao_social for r in landing.read_wide(spark, out).collect()} == {"UM", "DOIS", "ODD", "TRES"}
    last = landing.refreshes(spark, out).where("rodada = 1").first()
    assert {r.faixa for r in spark.read.parquet(f"{out}/base/lote={last.lote}").select(F.col("faixa").cast("string")).collect()} == {"3"}


def test_a_replaced_file_takes_its_rows_along(spark, landed):
    root, out, refresh, whole = landed
    refresh()
    write(root / "estab" / "Estabelecimentos 0.csv", [place("00100001"), place("00400001", "2"), place("x")])
    assert refresh() == 1 and "002" in ranges(spark, out)[1]
    assert rows(landing.read_wide(spark, out)) == whole("w1")
    assert {r.cnpj_basico for r in landing.read_wide(spark, out).collect()} == {"00100001", "00400001", "0000000x"}


def test_a_changed_code_table_rebuilds_all(spark, landed):
    root, out, refresh, whole = landed
    refresh()
    write(root / "aux" / "F.NATJUCSV.csv", ['"2062";"Sociedade Limitada"'])
    write(root / "aux" / "F.SIMPLES.csv", ['"00100001";"S";"20070701";"00000000";"N";"";""'])
    assert refresh() == 1 and len(ranges(spark, out)[1]) == 4
    assert rows(landing.read_wide(spark, out)) == whole("w1")
    write(root / "empresas" / "Empresas1.csv", [company("00100002", "NOVA")])
    write(root / "estab" / "Estabelecimentos1.csv", [place("00100002")])
    assert refresh() == 2 and ranges(spark, out)[2] == ["001"]
    assert rows(landing.read_wide(spark, out)) == whole("w2")


def test_a_refresh_that_fails_is_invisible(spark, landed, monkeypatch):
    root, out, refresh, whole = landed
    refresh()
    before = rows(landing.read_wide(spark, out))
    write(root / "empresas" / "Empresas1.csv", [company("00300001", "TRES")])
    with monkeypatch.context() as patch:
        patch.setattr(landing, "create_once", lambda *_: False)
        with pytest.raises(RuntimeError, match="another refresh"):
            refresh()
    assert rows(landing.read_wide(spark, out)) == before
    assert refresh() == 1 and rows(landing.read_wide(spark, out)) == whole("w1")


def test_nothing_landed(spark, tmp_path):
    with pytest.raises(LookupError):
        landing.read_wide(spark, str(tmp_path / "none"))


def test_few_ranges_are_written_where_they_are(spark):
    wide = spark.range(10).select(F.lpad(F.col("id").cast("string"), 8, "0").alias("cnpj_basico"))
    moved = {n: "Rebalance" in landing._placed(wide, n)._jdf.queryExecution().analyzed().toString() for n in (1, 4, 500)}
    assert moved == {1: False, 4: False, 500: True}
    assert {r.faixa for r in landing._placed(wide, 1).collect()} == {"000"}
