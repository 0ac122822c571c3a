"""Subword pieces against the library that defines the format, and lattices against all cuts."""

import itertools
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from parallax.functions import pieces as P
from parallax.functions.tokens import subword_encode
from parallax.plans import fixtures as fx
from parallax.plans.registry import QUERIES, load_all
from tests.conftest import SF_SMALL

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def model_file(kind, pieces, prefix=True, squeeze=False, fallback=False):
    """A model file of given pieces."""
    m = proto.ModelProto()
    for piece, score, k in [("<unk>", 0.0, P.UNKNOWN), ("<s>", 0.0, P.CONTROL), *pieces]:
        m.pieces.add(piece=piece, score=score, type=k)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = kind, fallback
    m.normalizer_spec.name, m.normalizer_spec.precompiled_charsmap = "identity", b""
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = prefix, squeeze
    return m.SerializeToString()


def test_a_public_vocabulary(library):
    encode = P.Encoder(P.PieceModel.parse(open(PATH, "rb").read()))
    rng = random.Random(1)
    bits = list("abcdeé  \t\n▁中文🙂ﬁ\xa0\x00") + ["the ", "ing", "  ", "   "]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert encode(text) == library.encode(text), text
    assert encode("x" * 20_000) == library.encode("x" * 20_000)


def test_short_stretches_merge_as_the_heap_does(monkeypatch):
    rng = random.Random(2)
    for _ in range(400):
        scores = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))): -float(rng.randint(0, 8)) for _ in range(25)}
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 30)))
        short = P.merge_short(text, scores)
        with monkeypatch.context() as m:
            m.setattr(P, "SHORT", -1)
            assert P.merge_pieces(text, scores) == short


def test_the_token_filter_encodes_once(spark):
    """Each side is encoded by one evaluation, after the join."""
    load_all()
    plan = QUERIES["subword_max_tokens"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2
    assert plan.rindex("ArrowEvalPython") < plan.index("Join")


@pytest.mark.parametrize("kind", [P.UNIGRAM, P.BPE])
@pytest.mark.parametrize("prefix,squeeze", [(True, False), (False, False), (True, True)])
def test_made_up_vocabularies(kind, prefix, squeeze):
    rng = random.Random(kind)
    words = {"a", "b", "c", "▁"} | {"".join(rng.choice("abc▁") for _ in range(rng.randint(2, 5))) for _ in range(60)}
    words = sorted(w for w in words if kind == P.UNIGRAM or len(w) == 1 or "▁" not in w.lstrip("▁"))
    pieces = [(w, -round(rng.uniform(0.5, 9), 3) if kind == P.UNIGRAM else -float(i), P.NORMAL) for i, w in enumerate(words)]
    raw = model_file(kind, pieces, prefix, squeeze)
    encode, lib = P.Encoder(P.PieceModel.parse(raw)), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for _ in range(600):
        text = "".join(rng.choice("abc  d") for _ in range(rng.randint(0, 12)))
        assert encode(text) == lib.encode(text), text


def test_lattice_against_all_cuts():
    rng = random.Random(4)
    for _ in range(150):
        scores = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): -rng.uniform(0, 5) for _ in range(12)}
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))

        def cost(cut):
            return sum(scores[p] if p in scores else -20.0 if len(p) == 1 else float("-inf") for p in cut)

        cuts = []
        for n in range(len(text)):
            for at in itertools.combinations(range(1, len(text)), n):
                ends = [0, *at, len(text)]
                cuts.append([text[a:b] for a, b in zip(ends, ends[1:])])
        got = P.best_path(text, scores, 4, -20.0)
        assert "".join(got) == text and cost(got) == pytest.approx(max(map(cost, cuts)))


def test_other_models_are_refused():
    with pytest.raises(ValueError, match="kind 3"):
        P.PieceModel.parse(model_file(3, []))
    m = proto.ModelProto()
    m.ParseFromString(model_file(P.BPE, []))
    m.normalizer_spec.precompiled_charsmap = b"x"
    with pytest.raises(ValueError, match="character map"):
        P.PieceModel.parse(m.SerializeToString())


def test_column_ids_do_not_depend_on_partitions(spark, library):
    encode = P.piece_encoder(spark, PATH)
    lines = fx.lines(spark, SF_SMALL).select("text").unionByName(spark.createDataFrame([(None,), ("",), ("  ",)], "text string"))
    once, again = (sorted((r["text"] or "", r["ids"]) for r in lines.repartition(n).select("text", encode("text").alias("ids")).collect()) for n in (1, 7))
    assert once == again
    assert all(ids == library.encode(text) for text, ids in once)
    cut = lines.select(F.size(subword_encode("text", encode, 5)).alias("n")).agg(F.max("n")).first()[0]
    assert cut == 5


def test_queries_against_the_library(spark, library):
    load_all()
    text = {(r["corpus"], r["doc_id"], r["line_no"]): r["text"] for r in fx.lines(spark, SF_SMALL).collect()}
    ids = {k: library.encode(t) for k, t in text.items()}
    got = {(r["doc_id"], r["line_no"]): r["ids"] for r in QUERIES["subword_ids"](spark, SF_SMALL).collect()}
    assert got == {k[1:]: " ".join(map(str, v[:100])) for k, v in ids.items()}
    stats = {}
    for (corpus, _, _), v in ids.items():
        n, most, total = stats.get(corpus, (0, 0, 0))
        stats[corpus] = n + 1, max(most, len(v)), total + len(v)
    assert {r["corpus"]: (r["n_lines"], r["max_tokens"], r["total_tokens"]) for r in QUERIES["subword_stats"](spark, SF_SMALL).collect()} == stats
    pairs = {(r["doc_id"], r["line_no"]): (len(library.encode(r["source"])), len(library.encode(r["target"]))) for r in fx.pairs_docs(spark, SF_SMALL).collect()}
    got = {(r["doc_id"], r["line_no"]): (r["n_src"], r["n_tgt"]) for r in QUERIES["subword_max_tokens"](spark, SF_SMALL).collect()}
    assert got == {k: v for k, v in pairs.items() if max(v) <= 100} and len(got) < len(pairs)


def test_training_mixture_against_the_library(spark, library):
    load_all()
    plain = {(r["tag"], r["ord"], r["corpus"], r["doc_id"], r["line_no"]): r for r in QUERIES["build_mixture"](spark, SF_SMALL).collect()}
    pairs = {(r["corpus"], r["doc_id"], r["line_no"]): (r["source"], r["target"]) for r in fx.pairs_docs(spark, SF_SMALL).collect()}
    rows = QUERIES["build_mixture_subword"](spark, SF_SMALL).collect()
    assert len(rows) == len(plain)
    for r in rows[::7]:
        src, tgt = pairs[r["corpus"], r["doc_id"], r["line_no"]]
        assert r["rank"] == plain[r["tag"], r["ord"], r["corpus"], r["doc_id"], r["line_no"]]["rank"]
        assert r["n_src"] == min(100, len(library.encode(f"<2{r['tag']}> {src}"))) and r["n_tgt"] == min(100, len(library.encode(f"{r['tag']} {tgt}")))


def test_language_model_blocks_against_the_library(spark, library):
    load_all()
    order = fx.lines(spark, SF_SMALL).orderBy("corpus", "doc_id", "line_no").collect()
    ids = [library.encode(r["text"] + "\n") for r in order]
    cut = round(len(ids) * 5 / 100)
    want = []
    for split, rows in (("validation", ids[:cut]), ("train", ids[cut:])):
        for g in range(-(-len(rows) // 1000)):
            flat = list(itertools.chain(*rows[g * 1000:(g + 1) * 1000]))
            want += [(split, g, b, " ".join(map(str, flat[b * 128:(b + 1) * 128]))) for b in range(len(flat) // 128)]
    assert sorted(tuple(r) for r in QUERIES["lm_dataset_subword"](spark, SF_SMALL).collect()) == sorted(want)
