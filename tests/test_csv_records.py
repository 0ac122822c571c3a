"""CSV in splits against Python's csv module."""

import csv
import io
import random

import pytest

from parallax.sources import csv_records as R, text as S


def made_up(seed, rows):
    rng = random.Random(seed)
    bits = ["a", "bc", " ", ",", "\n", "\r\n", '"', '""', "é", "x" * 30, ""]
    return [["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))), str(i)] for i in range(rows)]


def read(spark, path):
    return [(r["line_no"], r["text"]) for r in S.read_lm(spark, path).orderBy("line_no").collect()]


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "512", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_records_across_splits(spark, tmp_dir, small_splits, seed, end):
    rows = made_up(seed, 250)
    with open(f"{tmp_dir}/a.csv", "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end, quoting=csv.QUOTE_ALL if seed == 3 else csv.QUOTE_MINIMAL).writerows([["body, of\nit", "n"], *rows])
    assert spark.read.option("lineSep", "\n").text(f"{tmp_dir}/a.csv").rdd.getNumPartitions() > 8
    got = read(spark, f"{tmp_dir}/a.csv")
    assert [n for n, _ in got] == list(range(1, 251))
    assert [t or "" for _, t in got] == [a for a, _ in rows]


def test_a_field_longer_than_many_splits(spark, tmp_dir, small_splits):
    long_ = ("line, with \"quotes\"\n" * 400) + "end"
    with open(f"{tmp_dir}/a.csv", "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([["id", "text"], ["1", "before"], ["2", long_], ["3", "after"]])
    assert read(spark, f"{tmp_dir}/a.csv") == [(1, "before"), (2, long_), (3, "after")]


def test_folder_blank_lines_and_quotes_inside_plain_fields(spark, tmp_dir):
    (path := __import__("pathlib").Path(tmp_dir) / "d.csv").mkdir()
    (path / "part-00000.csv").write_text('text,n\nit is 5" long,1\n\n"a\n\nb",2\n')
    (path / "part-00001.csv").write_text('text,n\r\n,3\r\n"x""y",4\r\n')
    assert read(spark, str(path)) == [(1, 'it is 5" long'), (2, "a\n\nb"), (3, None), (4, 'x"y')]


def test_open_quote_raises(spark, tmp_dir):
    with open(f"{tmp_dir}/a.csv", "w") as f:
        f.write('text\n"open\n' + "more\n" * 50)
    scan = spark.read.option("lineSep", "\n").text(f"{tmp_dir}/a.csv").select("value", *S._place(0))
    with pytest.raises(R.UnclosedQuote):
        R.read_csv_records(spark, scan, max_record_lines=20)


def test_no_header(spark, tmp_dir):
    open(f"{tmp_dir}/a.csv", "w").close()
    with pytest.raises(S.UnsupportedFormat):
        S.read_lm(spark, f"{tmp_dir}/a.csv")


@pytest.mark.parametrize("line,inside,ends", [('a,"b', False, True), ('a,b"c', False, False), ('b"",c', True, True), ('b"""', True, False),
                                              ('","', False, False), ('x","y', True, True), ("", True, True), ("", False, False)])
def test_quote_state(line, inside, ends):
    assert R.quote_state(line, inside) is ends


def test_json_is_read_once(spark, tmp_dir):
    with open(f"{tmp_dir}/a.json", "w") as f:
        f.write('{"n": 1, "other": "p"}\n\n{"n": 2.50, "text": "q"}\nbroken\n{"text": {"a": [1]}}\n')
    assert read(spark, f"{tmp_dir}/a.json") == [(1, None), (2, "q"), (3, None), (4, '{"a":[1]}')]
    with open(f"{tmp_dir}/b.json", "w") as f:
        f.write('{"n": 1, "z": "p"}\n{"n": true}\n')
    assert read(spark, f"{tmp_dir}/b.json") == [(1, "1"), (2, "true")]
