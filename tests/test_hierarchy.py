import json

import pytest

from marketreach import layouts as L
from marketreach.operators import explore
from marketreach.operators.outline import lines_of, merge_editions, parse_outline
from marketreach.plans.hierarchy import outline_database, run_hierarchy, run_outline

ITEMS = [
    {
        "id": "4744-0/99", "descricao": "Materiais",
        "classe": {
            "id": "47440", "descricao": "Classe",
            "grupo": {
                "id": "474", "descricao": "Grupo",
                "divisao": {"id": "47", "descricao": "Divisão", "secao": {"id": "G", "descricao": "Comércio"}},
            },
        },
    },
    {"id": "0111301", "descricao": "Arroz", "classe": {"id": "01113", "descricao": "Cereais", "grupo": None}},
    {"id": None, "descricao": None},
]

TEXT = """preâmbulo ignorado
 SEÇÃO A - AGRICULTURA
DIVISÃO 01 - LAVOURA
GRUPO 01.1 – Temporárias
CLASSE 0111-3 - Cereais
0111-3/01 - Arroz
  cultivo de arroz

e beneficiamento
0111302 - Milho
CLASSE 0112-1 - Algodão
solta, sem subclasse aberta
0112-1/01 - Algodão herbáceo
fibras
seção B - INDÚSTRIA
texto solto
0500301 - Sem grupo
DIVISAO 05 - CARVÃO
GRUPO 05,1 - Mineral
0500302 - Carvão
nota final
"""

FIELDS = ["secao_cod", "divisao_cod", "grupo_cod", "classe_cod", "subclasse_cod", "subclasse_nome", "notas_explicativas"]
WANT = [
    ("A", "01", "01.1", "0111-3", "0111-3/01", "Arroz", "cultivo de arroz e beneficiamento"),
    ("A", "01", "01.1", "0111-3", "0111302", "Milho", ""),
    ("A", "01", "01.1", "0112-1", "0112-1/01", "Algodão herbáceo", "fibras"),
    ("B", "", "", "", "0500301", "Sem grupo", ""),
    ("B", "05", "05,1", "", "0500302", "Carvão", "nota final"),
]


def test_json_hierarchy(spark, tmp_path):
    path = tmp_path / "h.json"
    path.write_text(json.dumps(ITEMS), encoding="utf-8")
    out = run_hierarchy(spark, str(path), str(tmp_path / "out"))
    df = spark.read.parquet(out["tabela"])
    assert df.columns == L.HIERARCHY
    rows = {r.subclasse: r for r in df.collect()}
    assert rows["4744099"].secao == "G" and rows["4744099"].subclasse_cod == "4744-0/99"
    assert rows["0111301"].grupo == "" and rows["0111301"].secao_desc == "" and rows["0111301"].classe_desc == "Cereais"
    assert rows[""].subclasse_desc == ""
    assert spark.read.csv(out["csv"], header=True).count() == 3


@pytest.mark.parametrize("chunk", [1, 2, 3, 10_000])
def test_outline(spark, chunk):
    docs = spark.createDataFrame([("d1", TEXT), ("d2", TEXT.replace("\n", "\r\n").replace("DIVISÃO 01", "\u00a0DIVISÃO\u00a001"))], "doc string, text string")
    got = parse_outline(lines_of(docs, "doc", "text"), chunk).orderBy("doc", "line_no")
    for doc in ("d1", "d2"):
        rows = [tuple(r[f] for f in FIELDS) for r in got.collect() if r.doc == doc]
        assert rows == WANT


def test_names_and_resets(spark):
    docs = spark.createDataFrame([("d", TEXT)], "doc string, text string")
    rows = parse_outline(lines_of(docs, "doc", "text")).orderBy("line_no").collect()
    assert rows[0].secao_nome == "AGRICULTURA" and rows[0].grupo_nome == "Temporárias"
    assert rows[3].secao_nome == "INDÚSTRIA" and rows[3].divisao_nome == ""


def test_editions(spark, tmp_path):
    rows = [
        ("e1", 0, "0111-3/01 - Velho", 1), ("e1", 1, "0111302 - Só na primeira", 1),
        ("e2", 0, "0111301 - Novo", 2), ("e2", 1, "0111-3/01 - Novo repetido", 2), ("e2", 2, "nota", 2),
    ]
    lines = spark.createDataFrame(rows, "doc string, line_no int, line string, edition int")
    got = {r.subclasse_cod_num: r for r in outline_database(lines).collect()}
    assert got["0111301"].subclasse_nome == "Novo repetido" and got["0111301"].notas_explicativas == "nota"
    assert got["0111302"].subclasse_nome == "Só na primeira"
    path = run_outline(spark, lines, str(tmp_path / "o"))
    assert spark.read.parquet(path).count() == 2


def test_merge_keeps_last_edition_only(spark):
    docs = spark.createDataFrame([("d", TEXT)], "doc string, text string")
    records = parse_outline(lines_of(docs, "doc", "text"))
    both = records.selectExpr("*", "1 as edition").unionByName(records.selectExpr("*", "2 as edition"))
    assert merge_editions(both, "edition").count() == 5


def test_filters_and_search(spark):
    rows = [
        ("A", "Agro", "01", "d", "011", "g", "0111", "Cereais", "0111301", "0111-3/01", "Arroz"),
        ("G", "Comércio", "47", "d", "474", "g", "4744", "Materiais", "4744099", "4744-0/99", "Tintas e vernizes"),
        ("G", "Comércio", "47", "d", "474", "g", "4741", "Tintas", "4741500", "4741-5/00", None),
    ]
    h = spark.createDataFrame(rows, L.text_schema(L.HIERARCHY))
    codes = lambda df: sorted(r.subclasse for r in df.collect())
    assert codes(explore.hierarchy_filter(h, {})) == []
    assert codes(explore.hierarchy_filter(h, {"secao": ["G"]})) == ["4741500", "4744099"]
    assert codes(explore.hierarchy_filter(h, {"secao": ["G"], "classe": ["4741"]})) == ["4741500"]
    assert codes(explore.search_codes(h, "TINTAS")) == ["4744099"]
    assert codes(explore.search_codes(h, "tintas", ["classe_desc", "subclasse_desc"])) == ["4741500", "4744099"]
    assert codes(explore.search_codes(h, "4744.*")) == []
    assert codes(explore.code_details(h, "4744-0/99")) == ["4744099"]
    base = spark.createDataFrame([("4744099",), ("4744099",), ("1",)], "cnae_principal string")
    assert explore.count_code(base, "4744-0/99").first()[0] == 2
    assert explore.rows_of_codes(base, explore.hierarchy_filter(h, {"secao": ["G"]})).count() == 2
    assert tuple(explore.section_summary(h).collect()[1]) == ("G", "Comércio", 1, 1, 2, 2)
    assert tuple(explore.level_counts(h).first()) == (2, 2, 2, 3, 3)
