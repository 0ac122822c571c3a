"""Rank-order language identification: held-out accuracy, edge cases, whole texts."""

import zlib

import numpy as np
import pytest

from parallax.llm import lang_rank as L
from parallax.llm.queries import QUERIES
from tests.conftest import SF_MID

SCHEMA = "doc_id long, text string, lang string, score string"


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in QUERIES["op10_langid"](spark, SF_MID).collect()}
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").collect()
    assert len(got) == len(docs)
    right = total = 0
    for d in docs:
        g = got[d["doc_id"]]
        assert g["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0)
        assert 0 <= g["score"] <= 1
        if g["held_out"] and d["lang"] and g["lang_pred"] != "und":
            total += 1
            right += g["lang_pred"] == d["lang"]
    assert total > 100 and right / total > 0.97


def test_counts_match_a_plain_count():
    text = "Ab a. ÉB\nab"
    want = {}
    for word in ("ab", "a", "éb", "ab"):
        padded = f" {word} "
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                g = padded[i:i + n]
                if g.strip() and not (n == 3 and g[1] == " "):
                    want[g] = want.get(g, 0) + 1
    keys, counts = L.ngram_counts(text)
    name = {}
    for g in want:
        codes = [0 if c == " " else ord(c) for c in g]
        k = 0
        for c in codes:
            k = k << 18 | c
        name[k + ((len(g) - 1) << 60)] = g
    assert {name[k]: n for k, n in zip(keys.tolist(), counts.tolist())} == want


def test_long_text_is_counted_in_pieces(monkeypatch):
    text = "ab cde fg " * 50
    whole = L.ngram_counts(text)
    monkeypatch.setattr(L, "PIECE", 17)
    parts = L.ngram_counts(text)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


def test_edges(spark):
    rows = [(i, "the cat and the dog", "en", "x") for i in range(20)] + [(20 + i, "der hund und die katze", "de", "x") for i in range(20)]
    rows += [(100, None, "en", None), (101, "", None, None), (102, "12 ?!", "en", None), (None, "the dog", "en", None),
             (103, "the dog", None, None), (103, "the dog", None, None)]
    out = L.identify(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "lang", "held_out", "lang_pred", "score"]
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append((r["held_out"], r["lang_pred"], round(r["score"], 6)))
    assert all(got[i][0][1:] == ("und", 0.0) for i in (100, 101, 102))
    assert got[None][0][:2] == (False, "en")
    assert len(got[103]) == 2 and got[103][0] == got[103][1] and got[103][0][1] == "en"


@pytest.mark.parametrize("rows", [[], [(1, "the cat", None, None)]])
def test_nothing_to_learn(spark, rows):
    out = L.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["lang_pred"], r["score"]) for r in out] == [("und", 0.0)] * len(rows)


def test_ties_go_to_the_first_language():
    r = L.Ranker({"b": [5, 6], "a": [5, 6]}, 4)
    assert r.predict("zz")[0] == "a"


def test_a_column_of_its_own_names(spark):
    from parallax.llm import lang_rank
    df = spark.createDataFrame([(i, "the cat and the dog", "en", "keep") for i in range(20)], "doc_id long, text string, lang string, _p string")
    out = lang_rank.identify(df)
    assert set(df.columns) <= set(out.columns) and {r["_p"] for r in out.collect()} == {"keep"}
