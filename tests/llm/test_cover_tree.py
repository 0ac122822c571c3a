"""Embedding near-dedup against brute force."""

import numpy as np
import pytest

from parallax.llm import cover_tree as T
from parallax.llm.queries import QUERIES
from tests.conftest import SF_SMALL

SCHEMA = "vec_id long, embedding array<double>, label int, kept string"


def brute(rows, threshold):
    unit = []
    for _, v, label in rows:
        fine = v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) if fine else None)
    n = len(rows)
    links = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][0] is not None and rows[j][0] is not None
              and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = None if rows[i][0] is None else min(rows[j][0] for j in seen)
        out.append((rows[i][0], len(links[i]), least, rows[i][0] is not None and rows[i][0] == least))
    return sorted(out, key=str)


def run(spark, rows, **k):
    df = spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], SCHEMA)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in T.near_dedup(df, **k).collect()), key=str)


@pytest.mark.parametrize("seed,spread,dims", [(1, 0.05, 5), (2, 0.25, 8), (3, 0.6, 3)])
def test_blocks_and_trees(spark, seed, spread, dims):
    r = np.random.default_rng(seed)
    base = r.standard_normal((12, dims))
    x = base[r.integers(0, 12, 300)] + spread * r.standard_normal((300, dims))
    x[::9] = x[9]  # equal vectors
    labels = np.where(r.random(300) < 0.5, 1, r.integers(0, 4, 300))  # one label has most
    rows = [(int(i) + 5, [float(a) for a in v], int(label)) for i, (v, label) in enumerate(zip(x, labels))]
    assert run(spark, rows, threshold=0.93, block=30, pivots=9) == brute(rows, 0.93)


def test_tree_bounds():
    r = np.random.default_rng(4)
    x = T._unit(np.concatenate([r.standard_normal((100, 6)), np.ones((50, 6)) + 0.001 * r.standard_normal((50, 6))]))
    tree = T.CoverTree(x, leaf=4)
    assert sorted(tree.order.tolist()) == list(range(150)) and np.allclose(tree.x, x[tree.order])
    todo = [tree.root]
    while todo:
        n = todo.pop()
        d = np.sqrt(((tree.x[n.start:n.stop] - n.centre) ** 2).sum(axis=1))
        assert d.max() <= n.radius + T._SLACK and d.min() < 1e-12  # covered, and the centre is one of the points
        for c in n.children:
            assert c.radius <= n.radius + T._SLACK
        if n.children:
            assert [c.start for c in n.children] == [n.start, *[c.stop for c in n.children][:-1]]
        todo += n.children


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1),
            (7, [nan, 1.0], 1), (8, [None, 1.0], 1), (9, [inf, 1.0], 1), (10, [], 1), (None, [1.0, 0.0], 1), (11, [1.0], 1), (12, [1e300, 1e250], 1),
            (13, [1e-300, 1e-320], 1), (14, [-1.0, 0.0], 1), (15, [1.0, 1.0, 0.0], 1)]
    assert run(spark, rows) == brute(rows, 0.93)
    assert run(spark, []) == []


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in QUERIES["op5_embeddings"](spark, SF_SMALL).collect()), key=str)
    assert got == brute(rows, 0.93)
