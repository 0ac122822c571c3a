"""The pipeline against a brute-force version of its stages."""

import public_tokenizers
import tiktoken

import corpus_pipeline as P
from parallax.llm import bpe
from tests.conftest import SF_SMALL
from tests.llm.test_line_runs import brute as brute_lines
from tests.llm.test_simhash import components, plain_fingerprint


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    ident = P.language_id(spark, docs, SF_SMALL)
    assert ident.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in ident.collect()}
    assert set(kept) == {i for i, r in rows.items() if any(c.isalpha() for c in r["text"] or "")}

    lines = P.line_dedup(spark, ident, SF_SMALL)
    assert lines.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert texts == {i: t for i, _, _, t in brute_lines(list(kept.items()), 20, 3)}

    unique = P.simhash_dedup(spark, lines, SF_SMALL)
    assert unique.columns == docs.columns
    fp = {i: plain_fingerprint(t) for i, t in texts.items()}
    part = components(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    left = {r["doc_id"]: r["text"] for r in unique.collect()}
    assert left == {i: texts[i] for i in fp if part[i] == i}

    mixed = P.mix_sources(spark, unique, SF_SMALL)
    assert mixed.columns == docs.columns
    times = {}
    for r in mixed.collect():
        assert r["text"] == left[r["doc_id"]]
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 2
    words = lambda i: len(left[i].encode().split())
    assert abs(sum(words(i) * n for i, n in times.items()) - 1.5 * sum(map(words, left))) < 0.06 * sum(map(words, left))

    out = P.run(spark, SF_SMALL).collect()
    got = {}
    for r in out:
        assert r["round_trip"]
        got.setdefault(r["doc_id"], []).append(r["n_tokens"])
    assert got == {i: [len(library.encode_ordinary(left[i]))] * n for i, n in times.items()}


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF_SMALL)
    assert docs.count() == 0
