"""Text search through postings against the plain scan."""

import random

import pytest
from pyspark.sql import functions as F

from marketreach.functions.predicates import names_any
from marketreach.operators import market
from marketreach.operators.textindex import (
    build_index,
    drop_indexed_keywords,
    load_index,
    rows_with_keywords,
    search_index,
)

KEYWORDS = ["Bár", "ab", "b", "aba", "abab", "a b", "baab ba", "", "é", "zzz", "a-b", "aaaa"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    names += ["Bar do Zé", "BARRA", "ba", "b", "", None, "  ", "x" * 5000 + "abab"] + ["a" * 6] * 200
    made = [(i, n, i % 7 == 0 if i % 5 else None) for i, n in enumerate(names)]
    return spark.createDataFrame(made, "id long, nome_fantasia string, cliente_atendido boolean")


@pytest.fixture(scope="module")
def index(rows):
    return build_index(rows, F.col("nome_fantasia"))


def test_every_keyword_finds_the_rows_of_the_scan(rows, index):
    found = rows_with_keywords(rows, F.col("nome_fantasia"), index, KEYWORDS).collect()
    got = {(r.palavra, r.id) for r in found}
    assert len(got) == len(found)
    want = set()
    for word in {"bar", "ab", "b", "aba", "abab", "a b", "baab ba", "e", "zzz", "aaaa"}:
        want |= {(word, r.id) for r in rows.where(names_any(F.col("nome_fantasia"), [word])).collect()}
    assert got == want


def test_market_rows_are_dropped_as_by_the_scan(rows, index):
    words = ["bar", "aba", "b a"]
    got = sorted(r.id for r in drop_indexed_keywords(rows, index, words).collect())
    assert got == sorted(r.id for r in market.drop_keywords(rows, words).collect())
    assert drop_indexed_keywords(rows, index, [""]).count() == rows.count()


def test_only_postings_of_the_keyword_are_read(index):
    plan = search_index(index, ["abab", "ba"])._jdf.queryExecution().toString()
    assert "In(piece, [aba,bab])" in plan
    assert "StringStartsWith(piece,ba)" in plan


def test_empty_and_reloaded_index(spark, rows, tmp_path):
    none = build_index(rows.limit(0), F.col("nome_fantasia"))
    assert search_index(none, ["abab", "a"]).count() == 0
    kept = build_index(rows, F.col("nome_fantasia"), str(tmp_path / "index"))
    again = load_index(spark, str(tmp_path / "index"))
    assert search_index(again, ["abab"]).count() == search_index(kept, ["abab"]).count() > 0
