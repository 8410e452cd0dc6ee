import re
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from marketreach.functions.numeric import decimal_comma
from marketreach.operators import segments as S
from marketreach.plans.segmentation import candidate_codes, overlap, run_segmentation
from marketreach.sources import snapshots

ROWS = [
    (1, "1", "Alfa", "s1", "47", "10,0"), (2, "1", "Beta", "t1", "47", "5"), (3, "2", "Alfa", "s2", "11", "7"),
    (4, "3", "Beta", "t1", "11", "x"), (5, "4", "Gama", "z", "47", "2"), (6, "5", "Alfa", "s1", "47", "100"),
    (7, None, "Alfa", "s1", "47", "1"), (8, "6", "Gama", "z", "11", "1"),
]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "linha int, id string, empresa string, seg string, cnae_principal string, valor string")


@pytest.fixture
def members(rows):
    return overlap(rows, "id", "empresa", "seg", ("Alfa", ["s1"]), ("Beta", ["t1"]), "47", "valor")


def test_regions(members):
    got = {r.id: (r.regiao, r.valor) for r in members.collect()}
    assert got == {"1": (7, 15.0), "2": (0, 7.0), "3": (2, 0.0), "4": (4, 2.0), "5": (5, 100.0), "6": (0, 1.0)}
    counts = {r.regiao: (r.n, r.valor) for r in S.region_counts(members).collect()}
    assert counts == {1: (0, 0.0), 2: (1, 0.0), 3: (0, 0.0), 4: (1, 2.0), 5: (1, 100.0), 6: (0, 0.0), 7: (1, 15.0)}
    assert tuple(S.set_sizes(members).first()) == (2, 2, 3)
    assert sum(n for n, _ in counts.values()) == members.where("a or b or c").count()


def test_labels_of_regions(members):
    got = {r.regiao: (r.nome, r.exclui) for r in S.region_listing(members, ["A", "B", "C" * 30]).collect()}
    assert got[5] == ("A ∩ " + "C" * 25, "¬B") and got[7] == ("A ∩ B ∩ " + "C" * 25, "")


def test_membership_through_the_register(spark, rows, members):
    base = spark.createDataFrame(
        [(f"{'0' * 13}{i}", c, "d") for i, c in ((1, "47"), (2, "11"), (4, "47"), (5, "47"))],
        "cnpj string, cnae_principal string, cnae_principal_desc string",
    )
    bare = rows.drop("cnae_principal")
    other = overlap(bare, "id", "empresa", "seg", ("Alfa", ["s1"]), ("Beta", ["t1"]), "47", "valor", base)
    assert {r.id: r.regiao for r in other.collect()} == {r.id: r.regiao for r in members.collect()}
    tops = candidate_codes(bare, "id", "empresa", "seg", ("Alfa", ["s1", "s2"]), ("Beta", ["t1"]), base)
    assert {r.cnae_principal: r.n_cnpjs for r in tops.collect()} == {"47": 3, "11": 1}


def test_top_rows(rows, members):
    out = S.region_top(rows, members, "id", decimal_comma(F.col("valor")), ["linha"], 1)
    assert {r.regiao: r.linha for r in out.collect()} == {2: 4, 4: 5, 5: 6, 7: 1}
    assert [r.linha for r in S.pick_list(rows, "id", "valor", 3).collect()] == [6, 1, 3]


def test_labelling(rows, members):
    once = S.label_region(rows, members, "id", 7, "  Alvo ")
    assert {r.linha for r in once.where("segmentacao = 'Alvo'").collect()} == {1, 2}
    picked = rows.sparkSession.createDataFrame([("1", "Outro"), ("4", "Outro")], "id string, rotulo string")
    kept = S.apply_labels(once, picked, "id")
    assert {r.linha: r.segmentacao for r in kept.collect() if r.segmentacao} == {1: "Alvo", 2: "Alvo", 5: "Outro"}
    over = S.apply_labels(once, picked, "id", overwrite=True)
    assert {r.linha for r in over.where("segmentacao = 'Outro'").collect()} == {1, 2, 5}
    dist = {r.rotulo: (r.qtd, r.pct) for r in S.label_distribution(kept).collect()}
    assert dist == {None: (5, 62.5), "Alvo": (2, 25.0), "Outro": (1, 12.5)}


def test_two_lists_count_overlaps_twice(spark):
    a = spark.createDataFrame([("47", "d", 3), ("11", "e", 1)], "cnae_principal string, cnae_principal_desc string, n_cnpjs long")
    assert {r.cnae_principal: r.n_cnpjs for r in S.merge_tops(a, a).collect()} == {"47": 6, "11": 2}


def test_versions(spark, rows, members, tmp_path):
    root = str(tmp_path / "v")
    assert snapshots.next_version(spark, root, "p") == 0
    start = snapshots.with_label_column(rows)
    moved = start.select("segmentacao", *[c for c in start.columns if c != "segmentacao"])
    assert snapshots.save_version(moved, root, "p", "inicial", "linha", "base.csv", {"cnpj_col": "id"}) == 0
    assert snapshots.load_version(spark, root, "p", 0).columns[-1] == "segmentacao"
    v = run_segmentation(spark, rows, members, "id", {7: "Alvo", 5: "B"}, root, "p", "regra", "linha", previous=0)
    assert v == 1
    meta = snapshots.list_versions(spark, root, "p").collect()
    assert [(m.version, m.label, m.rows, m.rows_changed) for m in meta] == [(1, "regra", 8, 3), (0, "inicial", 8, 0)]
    assert meta[1].col_map == {"cnpj_col": "id"} and meta[1].changes is None
    snapshots.save_version(start, root, "q", "outro", "linha", "q.csv")
    projects = snapshots.list_projects(snapshots.metadata(spark, root)).collect()
    assert [(p.project, p.n_versions, p.latest_version, p.source_file) for p in projects] == [("q", 1, 0, "q.csv"), ("p", 2, 1, "base.csv")]


def test_a_record_is_never_overwritten(spark, tmp_path):
    path = str(tmp_path / "log" / "0.json")
    assert snapshots.create_once(spark, path, "one") and not snapshots.create_once(spark, path, "two")
    assert [f.name for f in (tmp_path / "log").iterdir()] == ["0.json"]
    assert (tmp_path / "log" / "0.json").read_text() == "one"


def test_a_failed_save_is_invisible(spark, rows, tmp_path, monkeypatch):
    root = str(tmp_path / "v")
    assert snapshots.save_version(rows, root, "a/b = c", "x", "linha") == 0

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(snapshots, "create_once", lost)
        with pytest.raises(OSError, match="lost"):
            snapshots.save_version(rows, root, "a/b = c", "died before its record", "linha")
    assert snapshots.save_version(rows, root, "a/b = c", "y", "linha", previous=0) == 1
    assert snapshots.load_version(spark, root, "a/b = c", 1).count() == rows.count()
    assert [r.version for r in snapshots.list_versions(spark, root, "a/b = c").collect()] == [1, 0]
    with pytest.raises(LookupError):
        snapshots.load_version(spark, root, "a/b = c", 2)


def test_savers_at_once_get_numbers_of_their_own(spark, rows, tmp_path):
    root = str(tmp_path / "v")
    with ThreadPoolExecutor(4) as pool:
        saves = [pool.submit(snapshots.save_version, rows, root, "p", str(i), "linha", parts=2) for i in range(4)]
        numbers = {s.result(): str(i) for i, s in enumerate(saves)}
    assert sorted(numbers) == [0, 1, 2, 3]
    assert {m.version: m.label for m in snapshots.metadata(spark, root).collect()} == numbers


def test_a_comparison_reads_the_parts_that_differ(spark, tmp_path):
    root = str(tmp_path / "v")
    base = spark.range(200).select(F.col("id").alias("linha"), F.lit(None).cast("string").alias("segmentacao"))
    moved = base.withColumn("segmentacao", F.when(F.col("linha") == 7, "A"))
    empty = base.limit(0)
    for version, df in enumerate((base, moved, moved, empty)):
        assert snapshots.save_version(df, root, "p", "x", "linha", previous=version - 1 if version else None) == version
    meta = snapshots.list_versions(spark, root, "p").collect()
    assert [(m.rows, m.rows_changed) for m in meta] == [(0, 0), (200, 0), (200, 1), (200, 0)]
    assert snapshots.load_version(spark, root, "p", 3).columns == ["linha", "segmentacao"]

    def between(new, old):
        found = snapshots.changed_between(spark, root, "p", new, old, "linha")
        plan = found._jdf.queryExecution().executedPlan().toString()
        return found.first()["rows_changed"], [line for line in plan.splitlines() if "FileScan" in line]

    changed, scans = between(1, 0)
    assert changed == 1 and len(scans) == 2
    assert all(re.search(rf"PartitionFilters: \[[^\]]*{snapshots.PART}#\d+ = \d+\)", s) for s in scans)  # one part
    assert between(2, 1) == (0, [])
    assert between(3, 1) == (0, [])


def test_repeated_ids_pair_up_as_in_memory(spark, tmp_path):
    """Half the rows share an id; equal digests must not hide pairs of its rows."""
    root = str(tmp_path / "v")
    rows = [(1, "A" if i % 2 else "B") for i in range(40)] + [(i, "A") for i in range(2, 42)] + [(None, "A"), (None, None)]
    df = spark.createDataFrame(rows, "linha long, segmentacao string")
    want = snapshots.changed_rows(df, df, "linha").first()["rows_changed"]
    snapshots.save_version(df, root, "p", "x", "linha")
    snapshots.save_version(df, root, "p", "y", "linha", previous=0)
    snapshots.save_version(df.withColumn("linha", F.col("linha").cast("string")), root, "p", "z", "linha", previous=0, parts=3)
    meta = snapshots.list_versions(spark, root, "p").collect()
    assert [m.rows_changed for m in meta] == [want, want, 0] and want == 800
