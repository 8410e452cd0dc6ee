from pyspark.sql import functions as F

from marketreach.functions import numeric as N
from marketreach.functions import predicates as P
from marketreach.functions import text as T
from marketreach.layouts import STOPWORDS


def run(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "x string").coalesce(1)
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_clean_id_pads_but_never_cuts(spark):
    got = run(spark, ["12.345.678/0001-95", "1", "", None, "123456789012345"], T.clean_id)
    assert got == ["12345678000195", "0" * 13 + "1", "0" * 14, None, "123456789012345"]


def test_pad_code_cuts_like_lpad(spark):
    assert run(spark, [" 7 ", "123456789"], lambda c: T.pad_code(c, 8)) == ["00000007", "12345678"]


def test_postal_codes(spark):
    values = ["01310-100", "1310100", None, "abc"]
    assert run(spark, values, T.clean_cep) == ["01310100", None, None, None]
    assert run(spark, values, T.cep_prefix) == ["01310", "13101", "", ""]


def test_join_name(spark):
    got = run(spark, [" São João d'Água ", "Straße", "Ñu½", None], T.join_name)
    assert got == ["SAO JOAO D'AGUA", "STRASSE", "NU", None]


def test_place_key_is_null_without_name(spark):
    assert run(spark, ["Açu", None], lambda c: T.place_key(c, F.lit(" sp "))) == ["ACU|SP", None]


def test_norm_text(spark):
    got = run(spark, ["Café & Pão-½", "ÀÉÎÕÜ ªº²", "a\tb", "Ĳs €5", None], T.norm_text)
    assert got == ["cafe   pao 14".replace("14", "12"), "aeiou ao2", "a b", "ijs 5", None]


def test_norm_matches_keyword_rule(spark):
    for word in ("Holding", "  Matriz é ", "½ x", "São-José"):
        assert run(spark, [word], T.norm_text) == [T.norm_keyword(word)]


def test_words(spark):
    def kept(c):
        return F.filter(T.word_array(c), lambda w: T.is_word(w, STOPWORDS))

    got = run(spark, ["A LOJA do José & Cia LTDA - tintas", "", None], kept)
    assert got == [["loja", "jose", "tintas"], [], None]


def test_split_codes(spark):
    got = run(spark, ["4744099, 4741500;1 / x", "0111-3/01", " ", None, "12345678"], T.split_codes)
    assert got == [["4744099", "4741500", "0000001"], ["0001113", "0000001"], [], None, []]


def test_labels(spark):
    row = spark.range(1).select(
        T.code_label(F.lit("47"), F.lit("abcdef"), 3),
        T.code_label(F.lit("47"), F.lit(None).cast("string")),
        T.described(F.lit(None).cast("string"), F.lit("own")),
        T.described(F.lit(None).cast("string"), F.lit("—")),
        T.company_label(F.lit("Nome Longo"), F.lit("00000001"), 4),
        T.partner_label(F.lit("R"), F.lit(None).cast("string"), F.lit("9")),
    ).first()
    assert list(row) == ["47 · abc", "47 · ", "own", "—", "Nome  [00000001]", "R  /    [9]"]


def test_slugs():
    assert T.slugify("/x/Minha Base (v2).xlsx") == "minha_base_v2"
    assert T.slugify("###.csv") == "projeto"
    assert T.unique_slug("a", ["a", "a_1"]) == "a_2"
    assert T.unique_slug("b", ["a"]) == "b"


def test_decimal_comma(spark):
    values = ["1000,50", " 2.5 ", "1.000,00", "1d", "0x10p1", "", None, "-3,", "1e3", "NaN"]
    got = run(spark, values, N.decimal_comma)
    assert got == [1000.5, 2.5, None, None, None, None, None, -3.0, 1000.0, None]


def test_small_int_and_dates(spark):
    assert run(spark, [" 05", "x", None, "1.5"], N.small_int) == [5, None, None, None]
    got = run(spark, ["20240229", "20240230", "0", "00000000", "", None, " 19991231 "], N.register_date)
    assert [d and d.strftime("%Y%m%d") for d in got] == [
        "20240229", None, None, None, None, None, "19991231",
    ]


def test_percent_rounds_half_to_even(spark):
    row = spark.range(1).select(
        N.percent(F.lit(1), F.lit(8), 0), N.percent(F.lit(3), F.lit(8), 0), N.percent(F.lit(1), F.lit(0))
    ).first()
    assert list(row) == [12.0, 38.0, 0.0]


def test_grid_cell(spark):
    got = run(spark, ["0.125", "-0.125", "0.024", None], lambda c: N.grid_cell(c.cast("double")))
    assert got == [2, -2, 0, None]


def test_haversine(spark):
    km = N.haversine_km(F.lit(-23.55), F.lit(-46.63), F.lit(-22.91), F.lit(-43.17))
    none = N.haversine_km(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    half = N.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))
    row = spark.range(1).select(km, none, half).first()
    assert abs(row[0] - 360.7) < 1 and row[1] is None and abs(row[2] - 20015.087) < 0.01


def test_predicates_treat_null_as_specified(spark):
    df = spark.createDataFrame(
        [(True, "A", "Loja Hölding"), (True, None, None), (False, None, "holding x"), (False, "B", " ")],
        "served boolean, canal string, nome string",
    ).coalesce(1)
    row = df.select(
        P.in_context(F.col("served"), P.matches_all({"canal": ["A"]})),
        P.not_in(F.col("canal"), ["A"]),
        P.has_text(F.col("nome")),
        P.names_any(F.col("nome"), ["Holding", ""]),
        P.mentions("HOLDING", F.col("canal"), F.col("nome")),
    ).collect()
    assert [tuple(r) for r in row] == [
        (True, False, True, True, False),
        (False, True, False, False, False),
        (True, True, True, True, True),
        (True, True, False, False, False),
    ]


def test_unknown_filter_columns_are_skipped(spark):
    df = spark.createDataFrame([("x",)], "a string")
    assert df.where(P.matches_all({"zz": ["1"], "a": []}, df.columns)).count() == 1


def test_year_filter_keeps_unknown_dates(spark):
    df = spark.createDataFrame([("19800101",), (None,), ("20200101",)], "d string")
    rows = df.where(P.year_between_or_unknown(N.register_date(F.col("d")), 1970, 1990))
    assert sorted(str(r[0]) for r in rows.collect()) == ["19800101", "None"]
