"""Readers and sinks: numbering, alignment, round trips."""

import json
import os

import pytest
from pyspark.sql import functions as F

from parallax.operators.align import AlignmentError, zip_strict
from parallax.operators.corpus import ManifestError, manifest_rows, validation_manifest_rows
from parallax.sources import sinks as K
from parallax.sources import text as S


def _write(path, lines, newline="\n"):
    with open(path, "w", encoding="utf-8") as f:
        f.write(newline.join(lines) + newline)


def test_numbering_across_splits_and_files(spark, tmp_dir):
    lines_a = [f"line a{i} " + "x" * (i % 50) for i in range(3000)]
    lines_b = [f" b{i} " for i in range(1000)]
    os.makedirs(f"{tmp_dir}/in")
    _write(f"{tmp_dir}/in/part-0.txt", lines_a)
    _write(f"{tmp_dir}/in/part-1.txt", lines_b, "\r\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")  # many splits per file
    try:
        got = S.read_lines(spark, f"{tmp_dir}/in").orderBy("line_no").collect()
        per_file = S.read_lines(spark, f"{tmp_dir}/in", per_file=True)
        assert per_file.agg(F.max("line_no")).first()[0] == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    expect = [s.strip() for s in lines_a + lines_b]
    assert [r.line_no for r in got] == list(range(1, 4001))
    assert [r.text for r in got] == expect


def test_mid_file_bom_is_removed(spark, tmp_dir):
    _write(f"{tmp_dir}/a.txt", ["uno", "﻿dos", "tres"])
    got = [r.text for r in S.read_lines(spark, f"{tmp_dir}/a.txt").orderBy("line_no").collect()]
    assert got == ["uno", "dos", "tres"]


def test_parallel_strict_and_truncate(spark, tmp_dir):
    _write(f"{tmp_dir}/s.txt", ["a", "b", "c"])
    _write(f"{tmp_dir}/t.txt", ["A", "B"])
    with pytest.raises(AlignmentError) as e:
        S.read_parallel(spark, f"{tmp_dir}/s.txt", f"{tmp_dir}/t.txt", "strict")
    assert "s.txt" in str(e.value) and "t.txt" in str(e.value)
    tr = S.read_parallel(spark, f"{tmp_dir}/s.txt", f"{tmp_dir}/t.txt", "truncate").orderBy("line_no").collect()
    assert [(r.source, r.target) for r in tr] == [("a", "A"), ("b", "B")]


def test_read_corpora_family(spark, tmp_dir):
    for name, n in (("GNOME", 3), ("QED", 2)):
        _write(f"{tmp_dir}/{name}.es-arg.es", [f"{name} es {i}" for i in range(n)])
        _write(f"{tmp_dir}/{name}.es-arg.arg", [f"{name} arg {i}" for i in range(n)])
    df = S.read_corpora(spark, tmp_dir, ["GNOME", "QED"], "es-arg", "es", "arg", alignment="strict")
    rows = sorted((r.corpus, r.line_no, r.source, r.target) for r in df.collect())
    assert rows[0] == ("GNOME", 1, "GNOME es 0", "GNOME arg 0")
    assert len(rows) == 5


def test_write_lines_and_parallel_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([(i, f"s{i}", f"t{i}") for i in range(500)], "line_no long, source string, target string")
    K.write_parallel(df.repartition(7), f"{tmp_dir}/src", f"{tmp_dir}/tgt", table_path=f"{tmp_dir}/pair")
    back = S.read_parallel(spark, f"{tmp_dir}/src", f"{tmp_dir}/tgt", "strict").orderBy("line_no").collect()
    assert [r.source for r in back] == [f"s{i}" for i in range(500)]
    assert spark.read.parquet(f"{tmp_dir}/pair").count() == 500
    with open([os.path.join(f"{tmp_dir}/src", f) for f in sorted(os.listdir(f"{tmp_dir}/src"))
               if f.startswith("part-")][0], "rb") as f:
        assert not f.read().startswith(b"\xef\xbb\xbf")  # no BOM


def test_append_corpus_rerun_overwrites(spark, tmp_dir):
    a = spark.createDataFrame([("GNOME", 1, "x")], "corpus string, line_no long, text string")
    b = spark.createDataFrame([("QED", 1, "y")], "corpus string, line_no long, text string")
    for _ in range(2):  # a rerun must not duplicate
        K.append_corpus(a, f"{tmp_dir}/train", first=True)
        K.append_corpus(b, f"{tmp_dir}/train")
    assert spark.read.parquet(f"{tmp_dir}/train").count() == 2
    K.replace_corpus(spark.createDataFrame([("QED", 1, "z"), ("QED", 2, "w")], "corpus string, line_no long, text string"),
                     f"{tmp_dir}/train")
    back = spark.read.parquet(f"{tmp_dir}/train")
    assert back.count() == 3 and back.where("corpus = 'GNOME'").count() == 1


def test_predictions_metrics_and_cache(spark, tmp_dir):
    df = spark.createDataFrame([("bleu", "arg", 1, "x"), ("bleu", "arg", 2, "y"), ("chrf", "oci", 1, "z")],
                               "metric string, task string, line_no long, text string")
    K.write_predictions(df, f"{tmp_dir}/pred")
    assert sorted(os.listdir(f"{tmp_dir}/pred/metric=bleu")) == ["task=arg"]
    K.write_metrics(spark.createDataFrame([(31.2,)], "eval_bleu double"), f"{tmp_dir}/m")
    assert spark.read.json(f"{tmp_dir}/m").first().eval_bleu == 31.2
    tok = spark.createDataFrame([("spa", "arg", "train", [1, 2]), ("spa", "arg", "validation", [3])],
                                "src_tag string, tgt_tag string, split string, ids array<int>")
    back = K.cache_tokenized(tok, f"{tmp_dir}/cache")
    assert back.where("split = 'validation'").count() == 1


def test_read_lm_formats(spark, tmp_dir):
    _write(f"{tmp_dir}/a.txt", ["uno", "dos"])
    txt = S.read_lm(spark, f"{tmp_dir}/a.txt").orderBy("line_no").collect()
    assert [r.text for r in txt] == ["uno\n", "dos\n"]
    with open(f"{tmp_dir}/b.csv", "w") as f:
        f.write("id,body\n1,hello\n2,world\n")
    assert [r.text for r in S.read_lm(spark, f"{tmp_dir}/b.csv").orderBy("line_no").collect()] == ["1", "2"]
    with open(f"{tmp_dir}/c.json", "w") as f:
        f.write("\n".join(json.dumps({"text": t, "x": 1}) for t in ["p", "q"]))
    assert [r.text for r in S.read_lm(spark, f"{tmp_dir}/c.json").orderBy("line_no").collect()] == ["p", "q"]
    with pytest.raises(S.UnsupportedFormat):
        S.read_lm(spark, f"{tmp_dir}/d.parquet")


def test_json_and_csv_columns(spark, tmp_dir):
    with open(f"{tmp_dir}/a.json", "w") as f:
        f.write('{"sentence": "s1", "author": "a1"}\n{"sentence": "s2", "author": "a2"}\n')
    assert [r.text for r in S.read_lm(spark, f"{tmp_dir}/a.json").orderBy("line_no").collect()] == ["s1", "s2"]
    with open(f"{tmp_dir}/b.csv", "w") as f:
        f.write('body,id\n"he said ""hi"" to, me",1\n"two\nlines",2\n')
    assert [r.text for r in S.read_lm(spark, f"{tmp_dir}/b.csv").orderBy("line_no").collect()] == ['he said "hi" to, me', "two\nlines"]


def test_lists_pair_in_the_order_given(spark, tmp_dir):
    for name, lines in (("b.es", ["s1", "s2"]), ("a.es", ["s3"]), ("x.an", ["t1", "t2"]), ("y.an", ["t3"])):
        _write(f"{tmp_dir}/{name}", lines)
    at = lambda *names: [f"{tmp_dir}/{n}" for n in names]
    got = S.read_parallel(spark, at("b.es", "a.es"), at("x.an", "y.an")).orderBy("line_no").collect()
    assert [(r.line_no, r.source, r.target) for r in got] == [(1, "s1", "t1"), (2, "s2", "t2"), (3, "s3", "t3")]
    with pytest.raises(AlignmentError) as e:  # totals agree, the files do not
        S.read_parallel(spark, at("b.es", "a.es"), at("y.an", "x.an"))
    assert "b.es" in str(e.value) and "y.an" in str(e.value)
    with pytest.raises(AlignmentError):
        S.read_parallel(spark, at("b.es"), at("x.an", "y.an"))


def test_part_files_are_in_numeric_order(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/in")
    for n in (100000, 10001, 9):
        _write(f"{tmp_dir}/in/part-{n:05d}-x.txt", [str(n)])
    assert [r.text for r in S.read_lines(spark, f"{tmp_dir}/in").orderBy("line_no").collect()] == ["9", "10001", "100000"]


def test_line_breaks_do_not_shift_pairs(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a\rb", "x"), (2, "c", "y\nz"), (3, None, "w")], "line_no long, source string, target string")
    K.write_parallel(df, f"{tmp_dir}/s", f"{tmp_dir}/t")
    got = S.read_parallel(spark, f"{tmp_dir}/s", f"{tmp_dir}/t").orderBy("line_no").collect()
    assert [(r.source, r.target) for r in got] == [("a b", "x"), ("c", "y z"), ("", "w")]
    with pytest.raises(Exception, match="line break inside source"):
        K.write_parallel(df, f"{tmp_dir}/s", f"{tmp_dir}/t", breaks="error")


def test_corpora_are_strict_by_default(spark, tmp_dir):
    _write(f"{tmp_dir}/Q.es-arg.es", ["1", "2", "3"])
    _write(f"{tmp_dir}/Q.es-arg.arg", ["1", "2"])
    with pytest.raises(AlignmentError) as e:
        S.read_corpora(spark, tmp_dir, ["Q"], "es-arg", "es", "arg")
    assert "Q.es-arg.es" in str(e.value)
    assert S.read_corpora(spark, tmp_dir, ["Q"], "es-arg", "es", "arg", alignment="truncate").count() == 2


def test_zip_strict_raises_on_a_line_without_partner(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "line_no long, source string")
    b = spark.createDataFrame([(1, "A")], "line_no long, target string")
    assert zip_strict(a.where("line_no = 1"), b).collect()[0].target == "A"
    with pytest.raises(Exception, match="x.es and x.arg differ in line count: no partner at line_no=2"):
        zip_strict(a, b, names=("x.es", "x.arg")).collect()


def test_manifests_read_their_files(spark, tmp_dir):
    for name, lines in (("a.es", ["1", "2"]), ("a.arg", ["I", "II"]), ("b.es", ["3"]), ("b.arg", ["III"])):
        _write(f"{tmp_dir}/{name}", lines)
    a, b = {"source": "a.es", "target": "a.arg"}, {"source": "b.es", "target": "b.arg"}
    got = S.read_manifest(spark, json.dumps({"x": [a, b, a], "y": [b]}), tmp_dir).collect()
    assert sorted((r.tag, r.ord, r.line_no, r.source, r.target) for r in got) == [
        ("x", 0, 1, "1", "I"), ("x", 0, 2, "2", "II"), ("x", 1, 1, "3", "III"), ("x", 2, 1, "1", "I"), ("x", 2, 2, "2", "II"), ("y", 0, 1, "3", "III")]
    v = S.read_validation_manifest(spark, json.dumps({"t": b}), tmp_dir).collect()
    assert [(r.task, r.line_no, r.source, r.target) for r in v] == [("t", 1, "3", "III")]
    with pytest.raises(Exception, match="nope.es"):
        S.read_manifest(spark, json.dumps({"x": [{"source": "nope.es", "target": "a.arg"}]}), tmp_dir)


def test_mixture_with_a_missing_corpus_raises(spark):
    from parallax.operators.corpus import build_mixture
    pairs = spark.createDataFrame([("a", "s", "t")], "corpus string, source string, target string")
    rows = manifest_rows(spark, json.dumps({"x": [{"source": "a", "target": "a"}, {"source": "nope", "target": "nope"}]}))
    with pytest.raises(Exception, match="corpus without pairs: nope"):
        build_mixture(pairs, rows).collect()


def test_manifests(spark):
    rows = manifest_rows(spark, json.dumps({"fra_Latn": [{"source": "a.es", "target": "a.arg"},
                                                         {"source": "a.es", "target": "a.arg"}]})).collect()
    assert [(r.tag, r.ord) for r in rows] == [("fra_Latn", 0), ("fra_Latn", 1)]
    with pytest.raises(ManifestError):
        manifest_rows(spark, json.dumps({"x": [{"source": "a"}]}))
    v = validation_manifest_rows(spark, json.dumps({"ita_Latn": {"source": "s", "target": "t"}})).collect()
    assert v[0].task == "ita_Latn"


def test_sides_travel_alone_and_stay_in_step(spark, tmp_dir):
    from parallax.sources import sinks
    rows = [(i % 3, f"s{i * 7 % 50}", f"t{i * 7 % 50}") for i in range(200)] + [(None, "s1", "t1"), (1, "s9", "t9"), (1, "s9", "t9")]
    df = spark.createDataFrame(rows, "k int, source string, target string").repartition(5)
    assert sinks._ordered(df, ["k"], ["source", "target"], keep="source").columns == ["k", "source"]
    src, tgt = f"{tmp_dir}/alone-src", f"{tmp_dir}/alone-tgt"
    sinks.write_parallel(df, src, tgt, ["k"])
    from parallax.sources.text import read_parallel
    got = [(r["source"], r["target"]) for r in read_parallel(spark, src, tgt).collect()]
    assert sorted(got) == sorted(r[1:] for r in rows)


def test_truncate_leaves_the_longer_tail_where_it_is(spark, tmp_dir):
    a, b = os.path.join(tmp_dir, "a"), os.path.join(tmp_dir, "b")
    spark.range(0, 900, 1, 3).selectExpr("concat('s', id) AS value").write.text(a)
    spark.range(0, 7, 1, 2).selectExpr("concat('t', id) AS value").write.text(b)
    out = S.read_parallel(spark, a, b, "truncate")
    assert sorted(map(tuple, out.collect())) == [(i + 1, f"s{i}", f"t{i}") for i in range(7)]
    assert "__end" in out._jdf.queryExecution().optimizedPlan().toString()
