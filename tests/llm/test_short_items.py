"""Decontamination against plain windowed matching, for items of every length."""

import itertools

from marketreach.llm import decontaminate


def _windows(words, items):
    """(item, position, matched) of the best window that reaches the share, wherever it lies."""
    want = {}
    for name, t in items.items():
        v = min(13, len(t))
        for diagonal in range(-len(t), len(words)):
            e = [int(0 <= q + diagonal < len(words) and words[q + diagonal] == t[q]) for q in range(len(t))]
            for q in range(len(t) - v + 1):
                if sum(e[q : q + v]) * 10 >= v * 8:
                    want[name] = max(want.get(name, (0, 0)), (sum(e[q : q + v]), -(diagonal + q)))
    return {(name, -p, n) for name, (n, p) in want.items()}


def test_short_items_match_plain_windows(spark):
    items = {m: [f"i{m}x{k}" for k in range(m)] for m in range(1, 15)}
    docs, noise = [], ["n1", "n2", "n3"]
    for m, t in items.items():
        for r in range(4):
            for out in itertools.combinations(range(m), r):
                made = ["zz" if k in out else w for k, w in enumerate(t)]
                docs.append(noise + made + noise if sum(out) % 2 else made)
    docs += [items[9][1:], items[9][:-1], items[12][2:], noise]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(m, " ".join(t)) for m, t in items.items()], "item_id long, text string")
    got = decontaminate.overlaps(d, b, ["doc_id"]).select("doc_id", "item_id", "position", "matched")
    assert {tuple(r) for r in got.collect()} == {(i, *x) for i, w in enumerate(docs) for x in _windows(w, items)}


def test_unspaced_scripts_and_equal_items(spark, tmp_path):
    docs = [(1, "前文。机器学习是人工智能的一个分支。后文"), (2, "我们说机器学习是人工智慧的一个分支吧"), (3, "Is it a  dog?"), (4, "é x")]
    items = [(1, "机器学习是人工智能的一个分支"), (2, "it a dog"), (3, "It: a dog!"), (4, "--"), (5, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = decontaminate.op8_decontaminate(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 1), (2, 1), (3, 2), (3, 3)]
