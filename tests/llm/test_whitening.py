"""Whitening against exact whole-number sums and numpy's own eigenvectors."""

from fractions import Fraction

import numpy as np
import pytest

from parallax.llm import symmetric_eigen as S, whitening as W
from parallax.llm.queries import QUERIES
from tests.conftest import SF_SMALL


def check_pairs(a, k):
    values, x = S.leading(a, k)
    k = min(k, len(a))
    want = np.linalg.eigvalsh(a)[::-1][:k]
    scale = np.abs(want).max(initial=np.finfo(float).tiny)
    assert np.allclose(values, want, rtol=0, atol=1e-13 * scale * max(len(a), 4))
    assert np.allclose(x.T @ x, np.eye(k), atol=1e-13)
    assert np.abs(a @ x - x * values).max(initial=0) <= 1e-13 * scale * max(len(a), 4)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 150])
def test_eigenpairs_of_random_matrices(n):
    m = np.random.default_rng(n).standard_normal((n, n))
    check_pairs(m @ m.T, 32)


def test_eigenpairs_of_clustered_and_split_matrices():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    m = rng.standard_normal((16, 16))
    off = np.diag(np.ones(20), 1)
    for a in (np.eye(40), np.diag(np.arange(50.0)), q @ np.diag([5.0] * 20 + [1.0] * 44) @ q.T, np.outer(np.ones(64), np.ones(64)),
              np.kron(np.eye(4), m @ m.T), np.diag(np.abs(np.arange(-10, 11.0))) + off + off.T, np.zeros((5, 5)),
              q @ np.diag(1 + 1e-12 * np.arange(64)) @ q.T):
        check_pairs((a + a.T) / 2, 32)


def test_sturm_counts():
    rng = np.random.default_rng(5)
    d, e = rng.standard_normal(30), rng.standard_normal(29)
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    x = np.linspace(-4, 4, 33)
    assert S.sturm_count(d, e, x).tolist() == [int((values < y).sum()) for y in x]


def test_gram_is_exact():
    rng = np.random.default_rng(6)
    for most in (100, 1 << 30, 1 << 60):
        z = rng.integers(-most, most, (1500, 3))
        want = [[sum(int(a) * int(b) for a, b in zip(z[:, i], z[:, j])) for j in range(3)] for i in range(3)]
        assert W.gram(z).tolist() == want


def plain(rows, components):
    """``{id: (n, deviation, {component: |whitened|}, explained)}`` by exact fractions and numpy."""
    out = {}
    for d in {len(v) for _, v in rows}:
        x = {i: [int(np.floor(64 * float(c))) + 1_000_000 for c in v] for i, v in rows if len(v) == d}
        n = len(x)
        s = [sum(v[j] for v in x.values()) for j in range(d)]
        centred = np.array([[float(Fraction(n * v[j] - s[j], n)) for j in range(d)] for v in x.values()]).reshape(n, d)
        cov = centred.T @ centred / n
        e, axes = np.linalg.eigh(cov)
        e, axes = e[::-1], axes[:, ::-1]
        k = min(components, int((e > d * np.finfo(float).eps * e.max(initial=0)).sum()))
        white = centred @ (axes[:, :k] / np.sqrt(e[:k]))
        for at, (i, v) in enumerate(x.items()):
            out[i] = n, sum((n * v[j] - s[j]) ** 2 for j in range(d)), white[at], e[:k] / max(np.trace(cov), 1e-300)
    return out


def compare(got, want, components):
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(by) == {i for i, w in want.items() if len(w[2])}
    signs = {}
    for i, rows in by.items():
        n, deviation, white, explained = want[i]
        assert sorted(rows) == list(range(1, len(white) + 1))
        for c, r in rows.items():
            assert r["n"] == n and r["deviation"] == (deviation if deviation < 1 << 63 else None) and r["identity_error"] <= 1e-4
            assert r["explained"] == pytest.approx(explained[c - 1], rel=1e-9)
            if abs(white[c - 1]) > 1e-6:
                sign = signs.setdefault((n, len(white), c), np.sign(r["whitened"] * white[c - 1]))
                assert sign * r["whitened"] == pytest.approx(white[c - 1], rel=1e-6, abs=1e-9)


def test_query_against_numpy(spark):
    got = QUERIES["op12_whitening"](spark, SF_SMALL)
    assert dict(got.dtypes)["component"] == "int" and dict(got.dtypes)["n"] == "bigint" and dict(got.dtypes)["deviation"] == "bigint"
    data = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = [(r[0], r[1]) for r in data if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    compare(got.collect(), plain(rows, 32), 32)


def test_spaces_bad_rows_and_large_entries(spark):
    rng = np.random.default_rng(8)
    good = [(i, rng.standard_normal(5).tolist()) for i in range(40)] + [(100 + i, (1e9 * rng.standard_normal(3)).tolist()) for i in range(20)]
    good += [(200 + i, rng.standard_normal(1).tolist()) for i in range(4)] + [(300, [1.0] * 7), (301, [1.0] * 7), (302, []), (400, [0.5] * 8)]
    bad = [(900, None), (901, [1.0, None, 2.0]), (902, [float("nan")] * 5), (903, [float("inf")] * 3), (904, [1e30] * 3)]
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in good + bad], "vec_id long, embedding array<double>, dim string, whitened double").repartition(4)
    got = W.whiten(df, components=4).collect()
    compare(got, plain(good, 4), 4)
    assert {r["vec_id"] for r in got if r["deviation"] is None}  # beyond 64 bits


def test_repeats_null_ids_and_no_rows(spark):
    rows = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (7, [2.0, 0.0]), (7, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    got = W.whiten(df).collect()
    assert len(got) == 8 and {r["n"] for r in got} == {4} and sum(r["vec_id"] is None for r in got) == 4
    assert W.whiten(df.limit(0)).collect() == []
    assert W.whiten(df.where("vec_id is null")).collect() == []  # equal vectors have no component
    with pytest.raises(ValueError, match="cells"):
        W.whiten(df, max_cells=3)
