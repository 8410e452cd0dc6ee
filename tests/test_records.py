"""Records with quoted line breaks, read in many ranges, against whole-file readers."""

import csv
import io
import random

import pytest

from marketreach.sources.records import numbered_lines, range_parity, read_records
from marketreach.sources.register import malformed, read_register
from marketreach.sources.uploads import read_upload

COLUMNS = ["a", "b", "c"]


@pytest.fixture
def tiny_ranges(spark):
    """Files are dealt in ranges of a few bytes."""
    settings = {"spark.sql.files.maxPartitionBytes": "70b", "spark.sql.files.openCostInBytes": "1b", "spark.sql.files.minPartitionNum": "200"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _field(rng):
    return "".join(rng.choice(['x', 'é', ';', '"', "\n", "\r\n", " ", "word"]) for _ in range(rng.randrange(6)))


def _file(path, rows, end="\n", last=True):
    quoted = lambda v: '"' + v.replace('"', '""') + '"'
    text = end.join(";".join(map(quoted, r)) for r in rows) + (end if last else "")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode("latin-1"))
    return text


def _plain(rows):
    """Empty quoted fields are empty texts on both sides."""
    return sorted(tuple(v or "" for v in r) for r in rows)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_many_ranges_equal_whole_files(spark, tiny_ranges, tmp_path, end):
    rng = random.Random(len(end))
    rows = {f"f{i}.csv": [[f"{i}-{k}", _field(rng), _field(rng)] for k in range(60)] for i in range(3)}
    rows["f3.csv"] = [["3-0", "long\n" * 100, "z"], ["3-1", "after", "é"]]
    rows["calm.csv"] = [[f"c{k}", "plain", 'a""b'] for k in range(40)]
    for name, part in rows.items():
        _file(tmp_path / "in" / name, part, end, last=name != "f0.csv")
    where = str(tmp_path / "in")
    got = read_register(spark, where, COLUMNS, line_breaks=True)
    assert _plain(got.collect()) == _plain(r for part in rows.values() for r in part)
    whole = spark.read.csv(where, schema="a string, b string, c string", sep=";", escape='"', encoding="ISO-8859-1", multiLine=True)
    # the whole-file reader turns each line end inside quotes into the kind it has found in the file
    one = lambda rows: _plain([v and v.replace("\r\n", "\n") for v in r] for r in rows)
    assert one(got.collect()) == one(whole.collect())
    assert malformed(spark, where, COLUMNS, line_breaks=True).count() == 0
    lines = numbered_lines(spark, where)
    assert lines.rdd.getNumPartitions() > 20
    kinds = {(r.calm, r.inside) for r in range_parity(lines).collect()}
    assert kinds == {(True, False), (False, False), (False, True)}


def test_wrong_field_counts_are_reported(spark, tiny_ranges, tmp_path):
    text = '"1";"two\nlines";"x"\n"2";"short\none"\n\n"3";"a";"b";"long"\n"4";"";"y"\n'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.csv").write_text(text)
    where = str(tmp_path / "in")
    read = read_register(spark, where, COLUMNS, line_breaks=True)
    assert _plain(read.collect()) == [("1", "two\nlines", "x"), ("4", "", "y")]
    assert read.count() == 2 and sorted(r.a for r in read.select("a").collect()) == ["1", "4"]
    dropped = malformed(spark, where, COLUMNS, line_breaks=True).collect()
    assert sorted(tuple(r) for r in dropped) == [("f.csv", '"2";"short\none"'), ("f.csv", '"3";"a";"b";"long"')]


def test_no_records(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.csv").write_text("\n\n")
    assert read_records(spark, str(tmp_path / "in")).count() == 0
    assert read_register(spark, str(tmp_path / "in"), COLUMNS, line_breaks=True).count() == 0


def test_upload_with_line_breaks_keeps_its_order(spark, tiny_ranges, tmp_path):
    rng = random.Random(4)
    rows = [[str(k), _field(rng).replace("\r", "").replace("é", "e") + "z"] for k in range(80)]
    out = io.StringIO()
    csv.writer(out, delimiter=";", lineterminator="\n", quoting=csv.QUOTE_ALL).writerows([["CNPJ", "nome; de"], *rows])
    (tmp_path / "up.csv").write_text(out.getvalue())
    df = read_upload(spark, str(tmp_path / "up.csv"), row_order=True, line_breaks=True)
    assert df.columns == ["CNPJ", "nome; de", "_row"]
    assert [[r["CNPJ"], r["nome; de"]] for r in df.orderBy("_row").collect()] == rows


def test_lines_do_not_move_to_meet_their_range(spark, tmp_path):
    """However large the text: the ranges are few, whatever Spark makes of the size of what they come from."""
    _file(tmp_path / "in" / "calm.csv", [[str(k), "plain", "z"] for k in range(50)])
    _file(tmp_path / "in" / "mixed.csv", [[str(k), "two\nlines", "z"] for k in range(50, 60)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1b")
    try:
        for names in (["calm.csv"], ["calm.csv", "mixed.csv"]):
            found = read_records(spark, [str(tmp_path / "in" / n) for n in names])
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert found.count() == 60
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_record_is_parsed_once(spark, tmp_path):
    _file(tmp_path / "in" / "f.csv", [["1", "a", "b"]])
    plan = read_register(spark, str(tmp_path / "in"), COLUMNS, line_breaks=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv") == 1


def test_quotes_are_counted_beside_letters_of_another_encoding(spark, tmp_path):
    rows = [["1", "\xe9", "x\xf4"], ["2", "\xe3\n\xe9", "y"], ["3", "", "z"]]
    _file(tmp_path / "in" / "f.csv", rows)
    assert [r.odd for r in numbered_lines(spark, str(tmp_path / "in"), "*", "ISO-8859-1").orderBy("at").collect()] == [False, True, True, False]
    assert _plain(read_register(spark, str(tmp_path / "in"), COLUMNS, line_breaks=True).collect()) == _plain(rows)
