"""SimHash near-dedup against brute force, the crowded-table path included."""

import random

import numpy as np
import xxhash

from parallax.llm import simhash_mih as S
from parallax.llm.components import connected_components
from parallax.llm.queries import QUERIES
from tests.conftest import SF_SMALL


def plain_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_fingerprint():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50):
        t = " ".join(rng.choice(["Éa", "b", "CC", "d e", "f"]) for _ in range(n)) + "\t\x0b"
        assert S.fingerprint(t) == plain_fingerprint(t)
    assert S.fingerprint(None) == 0 and S.fingerprint(" \n") == 0


def test_long_text_in_pieces(monkeypatch):
    t = " ".join(str(i % 37) for i in range(500))
    monkeypatch.setattr(S, "PIECE", 64)
    assert S.fingerprint(t) == plain_fingerprint(t)


def test_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    fp = {i: plain_fingerprint(t) for i, t in docs}
    want = components(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op4_simhash"](spark, SF_SMALL).collect()}
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


def _ball_cloud(seed, n, centre, flips):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        out.add(centre ^ sum(1 << b for b in set(rng.choices(range(64), k=rng.randint(0, flips)))))
    return out


def _check_links(spark, prints, **k):
    signed = [S._signed(f) for f in prints]
    df = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    parts = {r["node"]: r["component"] for r in connected_components(S.near_links(df, 3, **k)).collect()}
    got = {f: parts.get(f, f) for f in signed}
    want = components(signed, lambda a, b: ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 3)
    assert got == want


def test_dense_group(spark):
    prints = _ball_cloud(1, 250, 0x123456789ABCDEF0, 6) | _ball_cloud(2, 60, (1 << 63) | 7, 4)
    prints |= {random.Random(9).getrandbits(64) for _ in range(50)}
    _check_links(spark, prints)


def test_crowded_tables_enumerate_whole_balls(spark):
    prints = _ball_cloud(3, 60, 0xFFFF0000FFFF0000, 5) | {0, 1, 3, 7, 1 << 40}
    _check_links(spark, prints, max_table=8)


def test_edges(spark):
    rows = [(5, None), (6, ""), (7, " \n"), (9, "one two three four"), (8, "ONE  two three four"), (None, "one two three four"),
            (None, "alone here"), (9, "one two three four"), (3, "x " * 70_000)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, component_id string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in S.near_dedup(df).collect()), key=str)
    assert got == sorted([(5, 5), (6, 5), (7, 5), (9, 8), (8, 8), (None, 8), (None, None), (9, 8), (3, 3)], key=str)
    kept = sorted(((r["doc_id"], r["text"], r["component_id"]) for r in S.keep_one(df).collect()), key=str)
    assert kept == sorted([(5, None, "c"), (8, "ONE  two three four", "c"), (None, "alone here", "c"), (3, "x " * 70_000, "c")], key=str)
    assert S.near_dedup(df.limit(0)).count() == 0 and S.keep_one(df.limit(0)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 2000 + i) for i in range(100)] + [(5000, 5000), (None, 1)]
    random.Random(4).shuffle(edges)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, **{2000 + i: 1000 for i in range(100)}}


def test_small_tables_and_large_tables_agree():
    rng = np.random.default_rng(5)
    fp = np.unique(rng.integers(0, 1 << 10, 40).astype(np.uint64))
    import pandas as pd
    rows = pd.DataFrame({"seg": 1, "key": 0, "prober": 0, "fp": fp.view(np.int64)})
    def parts(small):
        frames = list(S._linker(3, small)(iter([rows.iloc[:7], rows.iloc[7:]])))
        pairs = {frozenset(x) for f in frames for x in f.itertuples(index=False, name=None)}
        return components([int(x) for x in fp.view(np.int64)], lambda a, b: frozenset((a, b)) in pairs)
    assert parts(100) == parts(4)


def test_an_id_with_several_texts_keeps_the_one_that_is_no_copy(spark):
    a, b, c = ("the first text of its own", "a second text that is a copy of another", "a third text unlike the other two")
    rows = [(3, b), (5, a), (5, b), (5, a), (None, b), (None, c), (7, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in S.keep_one(df).collect()]
    assert sorted(got, key=str) == sorted([(3, b), (5, a), (5, a), (None, c)], key=str)


def test_keep_one_with_a_column_of_its_own_names(spark):
    from parallax.llm import simhash_mih
    rows = [(1, "a b c d", "x"), (2, "a b c d", "y"), (2, "other words here now", "z"), (None, "quite different text again", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _f string")
    out = simhash_mih.keep_one(df)
    assert out.columns == df.columns
    assert sorted(r["_f"] for r in out.collect()) == ["n", "x", "z"]
