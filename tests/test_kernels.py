"""Pure kernels: goldens and property tests against brute force."""

import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from parallax.functions.ngrams import char_ngram_stats_py, word_ngram_stats_py
from parallax.functions.similarity import edit_distance, indel_ratio_py, lcs_length


def dp_lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


def dp_lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_goldens():
    assert edit_distance("hola", "holas") == 1
    assert abs(indel_ratio_py("hola", "holas") - 8 / 9) < 1e-12
    assert edit_distance("kitten", "sitting") == 3
    assert lcs_length("kitten", "sitting") == 4
    assert abs(indel_ratio_py("kitten", "sitting") - 8 / 13) < 1e-12
    assert indel_ratio_py("abc", "xyz") == 0.0
    assert indel_ratio_py("", "") == 1.0
    assert indel_ratio_py("", "a") == 0.0


text = st.text(alphabet="abcé😀 ", max_size=90)


@settings(max_examples=300, deadline=None)
@given(text, text)
def test_lcs_and_levenshtein_equal_dp(a, b):
    assert lcs_length(a, b) == dp_lcs(a, b)
    assert edit_distance(a, b) == dp_lev(a, b)
    r = indel_ratio_py(a, b)
    assert 0.0 <= r <= 1.0
    assert r == indel_ratio_py(b, a)
    assert indel_ratio_py(a, a) == 1.0


def test_word_level_edit_distance():
    assert edit_distance("a b c".split(), "a x c d".split()) == 2


def _brute_clip(h, r, n):
    hg = [tuple(h[i:i + n]) for i in range(len(h) - n + 1)]
    rg = [tuple(r[i:i + n]) for i in range(len(r) - n + 1)]
    return sum(min(hg.count(g), rg.count(g)) for g in set(hg))


def test_ngram_statistics_against_brute_force():
    rnd = random.Random(7)
    for _ in range(200):
        h = [rnd.choice("abcd") for _ in range(rnd.randint(0, 12))]
        r = [rnd.choice("abcd") for _ in range(rnd.randint(0, 12))]
        st_ = word_ngram_stats_py(h, r)
        assert st_[:2] == [len(h), len(r)]
        for n in range(1, 5):
            assert st_[2 * n] == max(len(h) - n + 1, 0)
            assert st_[2 * n + 1] == _brute_clip(h, r, n)
        hs, rs = "".join(h), "".join(r)
        cs = char_ngram_stats_py(hs, rs)
        for n in range(1, 7):
            assert cs[3 * (n - 1) + 2] == _brute_clip(list(hs), list(rs), n)


def test_matches_by_sorted_and_by_hashed_keys(monkeypatch):
    """Small alphabets fit sorted keys, a large one takes the hashed codes."""
    import parallax.functions.ngrams as N

    calls, real = [], N._match_sorted
    monkeypatch.setattr(N, "_match_sorted", lambda *a: calls.append(1) or real(*a))
    rng = random.Random(3)
    for alphabet, fits in (("a", 40), ("abcé𐐀 ", 40), ("".join(map(chr, range(40, 5000))), 0)):
        before = len(calls)
        for _ in range(40):
            h, r = (["".join(rng.choices(alphabet, k=rng.choice([0, 1, 5, 300]))) for _ in range(6)] + [alphabet[:2000]] for _ in "hr")
            assert N.char_ngram_stats_batch(h, r).tolist() == [N.char_ngram_stats_py(a, b) for a, b in zip(h, r)]
            words = [pa.array([list(x) for x in side], pa.list_(pa.string())) for side in (h, r)]
            assert N.word_ngram_stats_batch(*words).tolist() == [N.word_ngram_stats_py(a, b) for a, b in zip(h, r)]
        assert len(calls) - before == fits + 40  # the words' shorter n-grams fit
    empty = N.word_ngram_stats.func(pa.array([], pa.list_(pa.string())), pa.array([], pa.list_(pa.string())))
    assert empty.to_pylist() == []
    some = N.word_ngram_stats.func(pa.array([["a", "b"], None, []]), pa.array([["a"], ["x"], None], pa.list_(pa.string())))
    assert [x[:4] for x in some.to_pylist()] == [[2, 1, 2, 1], [0, 1, 0, 0], [0, 0, 0, 0]]
