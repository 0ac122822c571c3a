"""BPE against the tiktoken library, exact round trips, the perfect hash."""

import hashlib
import pickle
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from parallax.llm import bpe
from parallax.llm.queries import QUERIES, tokenizer
from tests.conftest import SF_SMALL

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_ranks(PATH), PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_perfect_hash(codec):
    tokens = list(codec.by_rank.values())
    assert sorted(codec.hash.slots(tokens).tolist()) == list(range(len(tokens)))
    assert bpe.PerfectHash([b"a"]).slots([b"a"]).tolist() == [0]


TEXTS = ["", " ", "\n\n  x", "Hello world's 123  ünïcödé", "日本語テキスト 한국어", "a" * 3000, "🙂👩‍👩‍👧 x‍", "\x00\x1c\x1d\x1e\x1f\x85  tab\t\r\n",
         "é ́", "'S 'll 'VE don't", "<|endoftext|>", "   　x", "x" + " " * 500 + "y", "١٢٣ ½ Ⅷ", "ſtrange Kelvin"]


@pytest.mark.parametrize("text", TEXTS)
def test_matches_the_library(codec, library, text):
    assert ids(codec.encode(text)) == library.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text.encode()


def test_random_texts(codec, library):
    rng = random.Random(6)
    alphabet = "ab thinge é ß 日 \n\t1.,'🙂" + "etaoin" * 3
    for _ in range(300):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))
        assert ids(codec.encode(t)) == library.encode_ordinary(t)


def test_pieces_and_memo_bounds(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 5)
    monkeypatch.setattr(bpe, "MEMO", 7)
    small = pickle.loads(pickle.dumps(codec))
    rng = random.Random(7)
    for _ in range(30):
        t = " ".join(str(rng.randint(0, 10 ** rng.randint(1, 9))) + "word" * rng.randint(0, 30) for _ in range(40))
        assert ids(small.encode(t)) == library.encode_ordinary(t)
        assert len(small.memo) <= 50


def test_query(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = QUERIES["op6_bpe"](spark, SF_SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        want = library.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_nulls_and_repeats(spark):
    coder = tokenizer(spark)
    df = spark.createDataFrame([(1, None), (1, None), (None, "a b"), (2, "")], "doc_id long, text string")
    out = bpe.recode(df.withColumn("ids", F.lit("old")), coder)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2  # encoded once, decoded once
    assert sorted((bytes(r["decoded"]), r["doc_id"]) for r in out.fillna(0, "doc_id").collect()) == [(b"", 1), (b"", 1), (b"", 2), (b"a b", 0)]
    assert df.limit(0).select(coder.encode(F.col("text"))).count() == 0


def test_both_ways_together_give_the_same(spark):
    coder = tokenizer(spark)
    df = spark.createDataFrame([(1, None, 0), (1, None, 0), (None, "a b", 1), (2, "", 2), (3, "été 中文 \n" * 50, 3)], "doc_id long, text string, _both int")
    one, two = (sorted((str(r["doc_id"]), r["_both"], bytes(r["ids"]), bytes(r["decoded"])) for r in f(df, coder).collect()) for f in (bpe.recode, bpe.recode_together))
    assert one == two
    out = bpe.recode_together(df.withColumn("ids", F.lit("old")), coder)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1 and out.columns == ["doc_id", "text", "_both", "ids", "decoded"]
