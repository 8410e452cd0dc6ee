"""Ranked search against brute force, on defined cases and random texts."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from marketreach.llm import blocks, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return TERM.findall((text or "").translate(UPPER))


def _brute(items, docs, k=10):
    bags = [(i, Counter(_terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_all, l_all = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * n_all + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        found = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * n_all // l_all
            s = sum(weight[t] * (1000000000 * b[t] // (1000 * b[t] + 8 * m)) for t in set(_terms(text)) if t in b)
            if s > 0:
                found.append((s, i))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, rank + 1, i, s) for rank, (s, i) in enumerate(found[:k])]
    return sorted(out, key=str)


def _got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def _frames(spark, items, docs):
    return (
        spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, number long"),
        spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, part long, terms string"),
    )


ITEMS = [(1, "Alpha beta"), (1, "gamma"), (None, "delta É"), (3, None), (4, "?!"), (5, "absent"), (6, "beta beta ALPHA alpha")]
DOCS = [
    (1, "alpha beta_gamma"), (1, "alpha beta_gamma"), (2, "ALPHA\x00alpha \x7fx"), (3, None), (4, ""), (5, " .,"), (None, "alpha beta"),
    (None, "delta é É"), (6, "beta " * 5000 + "delta"), (7, "x" * 100_000), (8, "delta2 ünï ünÏ"), (9, "delta"), (10, "é"),
]


def test_defined_cases(spark):
    items, docs = _frames(spark, ITEMS, DOCS)
    assert _got(search.search(items, docs)) == _brute(ITEMS, DOCS)
    assert _got(search.search(items, docs, k=2)) == _brute(ITEMS, DOCS, 2)
    assert _got(search.search(items, docs.limit(0))) == []
    assert _got(search.search(items.limit(0), docs)) == []


@pytest.mark.parametrize("limit,held", [(200, 1), (8_000_000, 16)])
def test_random_texts(spark, monkeypatch, limit, held):
    monkeypatch.setattr(search, "SLICE", limit)
    monkeypatch.setattr(search, "ITEMS", 2)
    rng = np.random.default_rng(11)
    words = np.array([f"w{i}" for i in range(300)])
    pick = lambda n: " ".join(words[np.minimum(rng.zipf(1.4, n) - 1, 299)])
    docs = [(i, pick(int(rng.integers(0, 60)))) for i in range(400)] + [(1000 + i, "w1 w7 w9") for i in range(30)]
    items = [(i, pick(8)) for i in range(12)]
    some, many = _frames(spark, items, docs)
    assert _got(search.search(some, many.repartition(4), held=held)) == _brute(items, docs)


def test_long_texts_are_cut_between_terms():
    text = ("alpha " * 50 + "b" * 40 + " gamma") .encode()
    assert b"".join(search.slices_of(text, 7)) == text
    whole, cut = search.Postings([text, b"gamma"]), search.Postings([text, b"gamma"], 7)
    seen = lambda p: {
        t.as_py(): p.tfs[a:b].tolist() for t, a, b in zip(p.terms, np.cumsum(p.dfs) - p.dfs, np.cumsum(p.dfs))
    }
    assert seen(whole) == seen(cut) and whole.sizes.tolist() == cut.sizes.tolist() == [52, 1]


def test_few_accumulators():
    """Frequent terms that cannot lift a document to the k-th score create no accumulator."""
    texts = [b"rare common"] * 12 + [b"common"] * 5000
    found = search.Postings(texts)
    ids = search.pa.array(range(len(texts)), search.pa.int64())
    block = search.Block(
        ids, found.sizes.tobytes(), found.terms, found.dfs, found.docs.tobytes(), found.tfs.tobytes(), len(texts), int(found.sizes.sum())
    )
    names = found.terms.to_pylist()
    blank = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    best = search.Best(10)
    made = search.rank(block, [names.index(b"rare"), names.index(b"common")], [5000, 1], best, *blank)
    assert made == 12 and best.ids.tolist() == list(range(10))
    assert not blank[0].any() and not blank[1].any()


def test_row_groups_of_blocks_are_bounded(spark):
    """Blocks of one task reach a reader in row groups of a few of them, however many the task has."""
    n = 40
    rows = spark.range(n, numPartitions=1).select(
        "id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(16_000)), lambda i: F.sha2((i + F.col("id")).cast("string"), 256)), " ").alias("t")
    )
    written = blocks.stage_blocks(rows)
    groups = [
        meta.row_group(g)
        for path in written.inputFiles()
        for meta in [pq.ParquetFile(path.removeprefix("file://")).metadata]
        for g in range(meta.num_row_groups)
    ]
    assert sum(g.num_rows for g in groups) == n
    assert max(g.total_byte_size for g in groups) < 20_000_000
    assert sorted(r.id for r in written.select("id").collect()) == list(range(n))


def test_blocks_of_one_task(spark, monkeypatch):
    """Many blocks in one task, and occurrences that are kept in four bytes, give the scores of brute force."""
    monkeypatch.setattr(search, "SLICE", 1000)
    docs = [(i, f"w{i % 7} w{i % 11} " + "v " * (i % 5) + "u" * 40) for i in range(2000)] + [(5000, "w3 " * 70_000)]
    items = [(1, "w3 v"), (2, "w10 u"), (3, "v")]
    some, many = _frames(spark, items, docs)
    assert search.index(many.coalesce(1)).count() > 50
    assert _got(search.search(some, many.coalesce(1))) == _brute(items, docs)
