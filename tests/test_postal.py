import pytest

from marketreach.layouts import CACHE_SCHEMA
from marketreach.operators import joins, postal
from marketreach.plans.focus import run_coordinates, run_focus, run_pending


def cache_row(cep5, status, stamp, lat=None, lon=None):
    return (cep5, cep5 + "000", lat, lon, "", "", "L", "SP", status, stamp)


@pytest.fixture
def cache(spark):
    rows = [
        cache_row("01310", "ok", "2024-01-01", -23.5, -46.6),
        cache_row("20000", "not_found", "2024-01-01"),
        cache_row("30000", "error", "2024-01-01"),
    ]
    return spark.createDataFrame(rows, CACHE_SCHEMA)


@pytest.fixture
def rows(spark):
    ceps = ["01310-100", "01310100", "01310-200", "20000000", "30000-001", "40000123", "4000", None]
    data = [(f"c{i}", c, -1.0 if i % 2 else None, -2.0 if i % 2 else None) for i, c in enumerate(ceps)]
    return spark.createDataFrame(data, "cnpj string, cep string, lat_municipio double, lon_municipio double")


def test_stats_and_representatives(rows):
    assert tuple(postal.cep_stats(rows).first()) == (6, 4)
    best = {r.cep5: r.cep_usado for r in postal.frequent_cep(rows).collect()}
    assert best["01310"] == "01310100" and len(best) == 4
    assert {r.cep5: r.cep_usado for r in postal.any_cep(rows).collect()} == best


def test_pending_retries_errors(rows, cache):
    assert sorted(r.cep5 for r in postal.pending(postal.any_cep(rows), cache).collect()) == ["30000", "40000"]


def test_upsert_and_stats(spark, rows, cache):
    fresh = spark.createDataFrame(
        [cache_row("30000", "ok", "2024-02-01", -10.0, -50.0), cache_row("40000", "not_found", "2024-02-01")], CACHE_SCHEMA
    )
    merged = postal.upsert(cache, fresh)
    got = {r.cep5: (r.status, r.lat) for r in merged.collect()}
    assert got == {"01310": ("ok", -23.5), "20000": ("not_found", None), "30000": ("ok", -10.0), "40000": ("not_found", None)}
    assert merged.columns == cache.columns
    assert tuple(postal.lookup_stats(postal.any_cep(rows), cache, fresh).first()) == (2, 1, 1)
    wanted = postal.wanted_rows(merged, postal.any_cep(rows).where("cep5 <> '20000'"))
    assert sorted(r.cep5 for r in wanted.collect()) == ["01310", "30000", "40000"]


def test_precedence(rows, cache):
    got = {r.cnpj: r for r in postal.attach_prefix_coordinates(rows, cache).collect()}
    assert len(got) == 8
    assert got["c1"].lat == -23.5 and got["c1"].lat_microregiao == -23.5 and got["c1"].lat_municipio == -1.0
    assert got["c3"].lat == -1.0 and got["c3"].lat_microregiao is None
    assert got["c4"].lat is None
    bare = rows.drop("lat_municipio", "lon_municipio")
    assert postal.attach_prefix_coordinates(bare, cache).where("lat is not null").count() == 3


def test_place_join(spark):
    rows = spark.createDataFrame([("a", "SAO JOAO", "SP"), ("b", "SAO JOAO", "RJ"), ("c", None, "SP")], "cnpj string, municipio_nome string, uf string")
    points = spark.createDataFrame(
        [("São João", "sp", "2", 1.0, 2.0), ("SÃO JOÃO ", "SP", "1", 3.0, 4.0)],
        "NM_MUN string, SIGLA_UF string, CD_MUN string, lat double, lon double",
    )
    got = {r.cnpj: (r.CD_MUN, r.lat) for r in joins.attach_place(rows, points).collect()}
    assert got == {"a": ("1", 3.0), "b": (None, None), "c": (None, None)}


def test_jobs(spark, tmp_path, cache):
    base = spark.createDataFrame(
        [("00000001000101", "4744099", "A", "SP", "01310100"), ("00000001000202", "4744001", "B", "SP", "40000-000"),
         ("00000003000101", "0111301", "A", "SP", None)],
        "cnpj string, cnae_principal string, municipio_nome string, uf string, cep string",
    )
    upload = spark.createDataFrame([(1, "1000101", "9,5", "C")], "linha long, id string, valor string, canal string")
    points = spark.createDataFrame([("á", "SP", "77", -5.0, -6.0)], "NM_MUN string, SIGLA_UF string, CD_MUN string, lat double, lon double")
    path = run_focus(spark, base, upload, "id", "valor", ["canal"], "linha", str(tmp_path / "foco"), centroids=points)
    foco = spark.read.parquet(path)
    got = {r.cnpj: r for r in foco.collect()}
    assert set(got) == {"00000001000101", "00000001000202"}  # class 4744 holds every customer
    assert got["00000001000101"].relevancia_valor == 9.5 and got["00000001000101"].CD_MUN == "77"
    assert got["00000001000202"].empresa_base_atendida and got["00000001000202"].lat is None
    assert got["00000001000101"].lat == -5.0

    todo = spark.read.parquet(run_pending(spark, foco, cache, str(tmp_path / "todo")))
    assert [tuple(r) for r in todo.collect()] == [("40000", "40000000")]
    fresh = spark.createDataFrame([cache_row("40000", "ok", "2025-01-01", -7.0, -8.0)], CACHE_SCHEMA)
    out = run_coordinates(spark, foco, cache, fresh, str(tmp_path / "foco2"), str(tmp_path / "cache2"))
    placed = {r.cnpj: r.lat for r in spark.read.parquet(out["foco"]).collect()}
    assert placed == {"00000001000101": -23.5, "00000001000202": -7.0}
    assert spark.read.parquet(out["cache"]).count() == 4
