"""The pipeline, stage by stage, and as a whole."""

import corpus_pipeline
import __spark_entry__ as entry
from test_operators import _classes, _fingerprint


def test_stages_keep_columns_and_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    from marketreach.session import stage

    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = stage(function(spark, docs, folder))
        assert docs.columns == columns, name
        assert docs.count() <= kept, name
        kept = docs.count()
    assert docs.filter("text like '%token = \"%' and text not like '%[assign]%'").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    whole = entry.queries()["pipeline"](spark, folder)
    ids = lambda df: sorted((r.doc_id, tuple(r.ids)) for r in df.collect())
    assert ids(last) == ids(whole) and len(ids(whole)) == kept


def test_near_duplicates_match_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = sorted(tuple(r) for r in docs.select("doc_id", "text").collect())
    of = _classes([_fingerprint(t) for _, t in texts])
    want = [i for n, (i, _) in enumerate(texts) if of[n] == n]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()) == want


def test_repeated_ids_with_different_texts(spark, folder):
    a, b = (" ".join(f"{c}{i}" for i in range(20)) for c in "ab")
    rows = [(1, a, "en"), (2, a, "en"), (2, b, "en"), (3, b, "de"), (4, "z", "en"), (4, "z", "en"), (None, None, "en"), (None, "", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()
    assert sorted((tuple(r) for r in got if r.doc_id), key=str) == [(1, a, "en"), (2, b, "en"), (4, "z", "en")]
    assert len(got) == 4  # texts without a word have one fingerprint
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), folder).count() == 0
