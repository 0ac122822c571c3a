"""Scalar text functions against Python semantics."""

import random

from pyspark.sql import functions as F

from parallax.functions import text as tx
from parallax.functions.similarity import wer_words

EDGE = ["", "  ", " a  b ", " x\u001c", "﻿head", "a*b*", ".", "façade 😀 ok", "tab\tsep", "x　y",
        "İstanbul", "a b", "  lead", "trail  "]


def _rows(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, s string")


def test_whitespace_set_is_pythons():
    assert len(tx.PY_WHITESPACE) == 29
    assert all(c.isspace() for c in tx.PY_WHITESPACE)


def test_java_whitespace_class_matches_isspace(spark):
    cps = [c for c in range(1, 0x30000) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(c, chr(c)) for c in cps], "cp int, ch string")
    got = {r.cp for r in df.where(F.col("ch").rlike("^" + tx.JAVA_WS_CLASS + "$")).collect()}
    assert got == {ord(c) for c in tx.PY_WHITESPACE}


def test_strip_words_first_words(spark):
    rnd = random.Random(1)
    vals = EDGE + ["".join(rnd.choice("ab \t  \u001cé") for _ in range(rnd.randint(0, 12)))
                   for _ in range(300)]
    df = _rows(spark, vals)
    out = df.select("id", tx.py_strip("s").alias("p"), tx.words("s").alias("w"),
                    tx.first_words("s", 2).alias("f"), tx.remove_whitespace("s").alias("r")).collect()
    for row in out:
        v = vals[row.id]
        assert row.p == v.strip()
        assert row.w == v.split()
        assert row.f == " ".join(v.split(" ")[:2])
        assert row.r == "".join(v.split())


def test_wer_words_match_usual_transform(spark):
    import re
    vals = EDGE + ["a  b\t c", " x\ty "]
    got = {r.id: r.w for r in _rows(spark, vals).select("id", wer_words("s").alias("w")).collect()}
    for i, v in enumerate(vals):
        exp = [w for w in re.sub(r"\s\s+", " ", v).strip().split(" ") if w]
        assert got[i] == exp


def test_small_functions(spark):
    df = spark.createDataFrame([("Hola.", "Hola"), ("Hola", "Hola."), ("a", "b*c*")], "s string, t string")
    out = df.select(tx.restore_final_period("s", "t").alias("p"), tx.drop_unknown_marks("t").alias("d"),
                    tx.language_name_key(F.lit("spa_Latn")).alias("k"),
                    tx.tag_target("t", "arg_Latn").alias("g")).collect()
    assert [r.p for r in out] == ["Hola.", "Hola.", "b*c*"]
    assert [r.d for r in out] == ["Hola", "Hola.", "bc"]
    assert out[0].k == "spaLatn"
    assert out[0].g == "arg_Latn Hola"
    f = spark.createDataFrame([("a\nb\nc",)], "s string").select(tx.flatten_newlines("s")).first()[0]
    assert f == "a b c"


def test_normalize_and_tokenize_subset(spark):
    df = spark.createDataFrame([("«Hola» , dijo (ella) …",)], "s string")
    r = df.select(tx.normalize_punct("s", "es").alias("n"), tx.word_tokenize("s").alias("t")).first()
    assert "«" not in r.n and "..." in r.n
    assert r.t.endswith("…") or " " in r.t
