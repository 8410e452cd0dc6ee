import pytest
from pyspark.sql import functions as F

from marketreach.operators import uploads as U
from marketreach.sources import exports, uploads as src

BASE = "cnpj string, uf string, municipio_nome string, cnae_principal string, razao_social string, extra string"


@pytest.fixture
def base(spark):
    return spark.createDataFrame(
        [("00000000000001", "SP", "A", "4744099", "UM", "e1"), ("00000000000002", "RJ", "B", "4741500", "DOIS", "e2")],
        BASE,
    )


@pytest.fixture
def upload(spark):
    return spark.createDataFrame(
        [
            (1, "1", "10,5", "X", "S1", "user"),
            (2, "0.0.1", "abc", None, "S2", "user"),
            (3, "1", "1", "Y", "S1", "user"),
            (4, "99", None, "Z", "S2", "user"),
            (5, None, "7", "W", None, "user"),
        ],
        "linha long, id string, valor string, canal string, seg string, uf string",
    )


@pytest.mark.parametrize("sep", [";", ",", "\t", "|"])
def test_separator_is_found(spark, tmp_path, sep):
    path = tmp_path / "up.csv"
    path.write_text(f'Meu CNPJ{sep}valor{sep}nome\n007{sep}1{sep}"a"\n8{sep}2{sep}b c\n')
    assert src.sniff_separator(spark, str(path)) == sep
    df = src.read_upload(spark, str(path), row_order=True)
    assert df.columns == ["Meu CNPJ", "valor", "nome", "_row"]
    assert [r["Meu CNPJ"] for r in df.orderBy("_row").collect()] == ["007", "8"]


def test_separator_ignores_quotes_and_later_lines(spark, tmp_path):
    path = tmp_path / "up.csv"
    path.write_text('\n"CNPJ, raiz";nome;valor\n1;"ACME; filial, sul";2\n3;"duas\nlinhas";4\n')
    df = src.read_upload(spark, str(path), line_breaks=True)
    assert [tuple(r) for r in df.collect()] == [("1", "ACME; filial, sul", "2"), ("3", "duas\nlinhas", "4")]
    assert df.columns == ["CNPJ, raiz", "nome", "valor"]
    path.write_text("so uma\n1\n")
    assert src.sniff_separator(spark, str(path)) == ","


def test_parquet_upload(spark, tmp_path, upload):
    for name in ("u.parquet", "tabela"):
        path = str(tmp_path / name)
        upload.write.parquet(path)
        assert src.read_upload(spark, path).count() == 5
    assert src.read_upload(spark, path, fmt="parquet").columns == upload.columns


def test_guesses(upload):
    assert src.guess_key_column(["valor", "CNPJ raiz", "cnpj"]) == "CNPJ raiz"
    assert src.guess_key_column(["a", "b"]) == "a"
    assert src.guess_value_column(upload.drop("linha"), "id") == "valor"
    assert src.guess_value_column(upload.select("id", "canal", "seg"), "id") == "canal"


def test_enrich_base_wins(upload, base):
    out = U.enrich(upload, base, "id")
    rows = {r.linha: r for r in out.collect()}
    assert len(rows) == 5
    assert rows[1].uf == "SP" and rows[2].razao_social == "UM" and rows[4].uf is None and rows[5].uf is None
    rate = U.match_rate(out).first()
    assert (rate.encontrados, rate.linhas, rate.pct) == (3, 5, 60.0)


def test_enrich_all_user_wins(upload, base):
    rows = {r.linha: r for r in U.enrich_all(upload, base, "id", "valor").collect()}
    assert rows[1].uf == "user" and rows[1].extra == "e1" and rows[4].extra is None
    assert rows[1].VALOR_TOTAL == rows[2].VALOR_TOTAL == rows[3].VALOR_TOTAL == 11.5
    assert rows[4].VALOR_TOTAL == 0.0 and rows[2].valor is None


def test_pivot(upload, base):
    out = U.enrich_pivot(upload, base, "id", "seg", "valor", "linha")
    assert [c for c in out.columns if c.endswith(("_S1", "_S2"))] == [
        "valor_S1", "canal_S1", "uf_S1", "seg_S1", "valor_S2", "canal_S2", "uf_S2", "seg_S2",
    ]
    rows = {r.id: r for r in out.collect()}
    one = rows["00000000000001"]
    assert (one.valor_S1, one.canal_S1, one.seg_S1) == (11.5, "X", "S1")
    assert (one.valor_S2, one.canal_S2, one.seg_S2) == (0.0, None, "S2")  # all-unknown sum is 0
    assert one.VALOR_TOTAL == 11.5 and one.uf == "SP"
    other = rows["00000000000099"]
    assert other.valor_S1 is None and other.valor_S2 == 0.0 and other.uf is None
    assert len(rows) == 2


def test_pivot_refuses_many_segments(spark):
    df = spark.range(11).select(F.col("id").cast("string").alias("seg"))
    with pytest.raises(ValueError):
        U.segment_values(df, "seg", 10)
    assert len(U.segment_values(df, "seg")) == 11
    table = U.segment_totals(df.select(F.lit("7").alias("k"), "seg", F.lit("1,5").alias("v")), "k", "seg", "v")
    assert {(r.n, r.v) for r in table.collect()} == {(1, 1.5)} and table.count() == 11


def test_per_customer_and_duplicates(upload):
    rows = {r.cnpj: r for r in U.per_customer(upload, "id", "valor", ["canal"], "linha").collect()}
    assert set(rows) == {"00000000000001", "00000000000099"}
    assert rows["00000000000001"].relevancia_valor == 11.5 and rows["00000000000001"].canal == "X"
    assert tuple(U.duplicates(upload, "id").first()) == (4, 2, True)


def test_export_text(spark, tmp_path):
    df = spark.createDataFrame(
        [(1.5, True, "a;b", 1), (12345678.25, False, 'x "y"', 2), (0.0005, None, "", 3), (None, True, None, 4)],
        "v double, b boolean, s string, i int",
    ).withColumn("d", F.to_timestamp(F.lit("2024-02-29"))).coalesce(1)
    path = exports.write_csv(df, str(tmp_path / "csv"))
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines == [
        "v;b;s;i;d",
        '1,5;True;"a;b";1;2024-02-29',
        '12345678,25;False;"x ""y""";2;2024-02-29',
        "0,0005;;;3;2024-02-29",
        ";True;;4;2024-02-29",
    ]


def test_small_sinks(spark, tmp_path, base):
    path = exports.write_table(base, str(tmp_path / "t"))
    exports.write_table(base.limit(0), path, mode="ignore")
    assert spark.read.parquet(path).count() == 2
    empty = exports.write_table(base.where("false"), str(tmp_path / "e"))
    assert spark.read.parquet(empty).columns == base.columns
    assert tuple(exports.table_size(base).first()) == (2, 6)
    assert exports.keep_existing(base, ["razao_social", "nope", "uf"]).columns == ["razao_social", "uf"]
    assert exports.preview(base, 1).count() == 1


def test_code_frequency(spark):
    df = spark.createDataFrame([("4744099,4741500",), ("4744099",), (None,)], "cnaes_secundarios string")
    assert {tuple(r) for r in U.code_frequency(df).collect()} == {("4744099", 2), ("4741500", 1)}
