import random

import pytest
from pyspark.sql import functions as F

from marketreach.operators import counts, focus, joins, ranking


def cutoff_by_hand(rows, limit=0.95):
    """Plain statement of the class cut-off rule."""
    classes = {}
    for c, v in rows:
        n, s, k = classes.get(c, (0, 0.0, 0))
        classes[c] = (n + 1, s + (v or 0.0), k + (v is not None))

    def chosen(items, total):
        items = sorted(items, key=lambda x: (-x[1], x[0]))
        picked, acc = set(), 0.0
        for c, x in items:
            picked.add(c)
            acc += x
            if acc / total >= limit:
                break
        return picked

    by_n = chosen([(c, n) for c, (n, _, _) in classes.items()], len(rows))
    total = sum(s for _, s, _ in classes.values())
    by_v = chosen([(c, s) for c, (_, s, k) in classes.items() if k], total) if total > 0 else set()
    return {
        c: "Vol + Val" if c in by_n & by_v else "Volume" if c in by_n else "Valor" if c in by_v else "—"
        for c in classes
    }


def case(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(12):
        for _ in range(int(40 / (c + 1)) + 1):
            rows.append((f"{4700 + c}", None if rng.random() < 0.2 else float(rng.randint(-50, 200) * (c + 1))))
    rows.append(("9999", None))
    return rows


@pytest.mark.parametrize("rows", [case(1), case(2), case(3), [("1", -5.0), ("2", -1.0)], [("1", None)]])
def test_class_cutoff(spark, rows):
    df = spark.createDataFrame(rows, "classe string, valor double")
    got = {r.classe: r for r in ranking.class_cutoff(df, "valor").collect()}
    want = cutoff_by_hand(rows)
    assert {c: r.criterio for c, r in got.items()} == want
    assert all(r.selecionada == (r.criterio != "—") for r in got.values())
    assert sum(r.n_clientes for r in got.values()) == len(rows)


def test_empty_cutoff(spark):
    df = spark.createDataFrame([], "classe string, valor double")
    assert ranking.class_cutoff(df, "valor").count() == 0


def test_abc(spark):
    df = spark.createDataFrame([("a", 70), ("b", 10), ("c", 15), ("d", 5)], "cnae_principal string, n int")
    got = {r.cnae_principal: (round(r.pct_acumulado, 6), r.abc) for r in ranking.pareto_abc(df, "n").collect()}
    assert got == {"a": (70.0, "A"), "c": (85.0, "B"), "b": (95.0, "B"), "d": (100.0, "C")}
    shown = ranking.pareto_abc(df, "n", "shown", 2).collect()
    assert [round(r.pct, 4) for r in shown] == [82.3529, 17.6471] and shown[1].pct_acumulado == 100.0
    limited = ranking.pareto_abc(df, "n", "all", 2).collect()
    assert [r.pct for r in limited] == [70.0, 15.0]
    zero = ranking.pareto_abc(df.withColumn("n", F.lit(0)), "n").collect()
    assert {r.pct for r in zero} == {0.0}


def test_portfolio_without_value_column(spark):
    df = spark.createDataFrame([("1", "d", "x", True)], "cnae_principal string, cnae_principal_desc string, cnpj string, cliente_atendido boolean")
    assert tuple(ranking.client_codes(df).first()) == ("1", "d", 1, 0.0)


def test_score_without_positive_value(spark):
    df = spark.createDataFrame([("a", 4, -1.0), ("b", 2, None)], "k string, n int, valor double")
    assert {r.k: r.score for r in ranking.combined_score(df, "k").collect()} == {"a": 1.0, "b": 0.5}


def test_top_per_key_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    out = ranking.top_per_key(df, ["k"], [F.desc("id")], 2)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in out.collect()) == [994, 995, 996, 997, 998, 999]


def test_flagged_ids_on_a_hot_key(spark):
    """A third of the rows share a key; ids repeat, and one id is both served and not."""
    hot = [("SP", f"{i % 50:03d}", i % 2 == 0) for i in range(400)]
    rows = hot + [(f"U{i % 9}", f"x{i}", i % 3 == 0) for i in range(800)]
    rows += [("SP", "000", False), ("SP", None, True)]
    df = spark.createDataFrame(rows, "uf string, cnpj string, cliente_atendido boolean")
    got = {r.uf: r for r in counts.flagged_ids(df, ["uf"]).collect()}
    served = {c for u, c, s in rows if u == "SP" and s and c}
    not_served = {c for u, c, s in rows if u == "SP" and not s and c}
    assert got["SP"].n_atendidos == len(served) and got["SP"].n_nao_atendidos == len(not_served)
    assert got["SP"].n_total == len(served) + len(not_served)


def test_coverage_counts(spark):
    rows = [("r1", "c1", True), ("r1", "c1", False), ("r1", "c2", False), ("r2", "c3", False), ("r2", None, True)]
    df = spark.createDataFrame(rows, "cnpj_basico string, cnpj string, cliente_atendido boolean")
    got = counts.coverage(df).first()
    assert (got.cnpjs, got.cnpjs_atendidos, got.empresas, got.empresas_atendidas) == (3, 1, 2, 2)
    none = counts.coverage(df.where("false")).first()
    assert (none.cnpjs, none.cnpjs_atendidos, none.pct_cnpjs, none.empresas, none.pct_empresas) == (0, 0, 0.0, 0, 0.0)


def test_keep_one_keeps_whole_rows(spark):
    df = spark.createDataFrame([("a", None, 2), ("a", "x", 3), ("b", "y", 1)], "k string, v string, o int")
    got = {tuple(r) for r in joins.keep_one(df, ["k"], [F.col("o")]).collect()}
    assert got == {("a", None, 2), ("b", "y", 1)}


def test_focus_marks(spark):
    base = spark.createDataFrame(
        [("00000001000101", "4744099", "SP"), ("00000001000202", "4744001", "RJ"), ("00000002000103", "0111301", "SP")],
        "cnpj string, cnae_principal string, uf string",
    )
    customers = spark.createDataFrame(
        [("00000001000101", 5.0, "C1", "x", True), ("00000002000103", 1.0, "C2", "y", True)],
        "cnpj string, relevancia_valor double, canal string, uf string, cliente_atendido boolean",
    )
    foco = focus.mark_company(focus.mark_served(focus.filter_classes(base, ["4744"]), customers))
    rows = {r.cnpj: r for r in foco.collect()}
    assert set(rows) == {"00000001000101", "00000001000202"}
    assert rows["00000001000101"].cli_uf == "x" and rows["00000001000101"].uf == "SP"
    second = rows["00000001000202"]
    assert not second.cliente_atendido and second.empresa_base_atendida and second.relevancia_valor is None
    table = spark.createDataFrame([("4744",), ("4744",)], "classe string")
    assert focus.filter_classes(base, table).count() == 2
