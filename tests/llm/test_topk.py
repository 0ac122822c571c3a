"""Top-k search against brute force."""

import numpy as np
import pytest

from parallax.llm import topk_norm as T
from parallax.llm.queries import QUERIES
from tests.conftest import SF_SMALL

SCHEMA = "vec_id long, embedding array<double>, score string"


def brute(rows, k, every, scale=64.0):
    ints = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    clamp = lambda s: max(-2 ** 63, min(2 ** 63 - 1, s))
    found = {}
    for q, u in ints:
        if q % every == 0:
            found.setdefault(q, []).extend((-clamp(sum(a * b for a, b in zip(u, v))), i) for i, v in ints if i != q and len(v) == len(u))
    return sorted((q, r + 1, i, -s) for q, rows in found.items() for r, (s, i) in enumerate(sorted(rows)[:k]))


def run(spark, rows, **k):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in T.top_k(df, **k).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_skewed_lengths(spark, seed):
    r = np.random.default_rng(seed)
    base = r.standard_normal((6, 8))
    x = base[r.integers(0, 6, 400)] + 0.1 * r.standard_normal((400, 8))
    x *= np.exp(r.standard_normal(400))[:, None]
    x[::7] = x[7]  # one very common vector
    rows = [(int(i), [float(a) for a in v]) for i, v in enumerate(x)]
    assert run(spark, rows, k=5, every=10, bucket=40, block=7) == brute(rows, 5, 10)


def test_pruning_keeps_all_results():
    r = np.random.default_rng(3)
    v = (r.standard_normal((500, 6)) * 40).astype(np.int64)
    q = v[:60] + 1
    scores = q @ v.T
    floor = np.sort(scores, axis=1)[:, -5].astype(float)
    got = sorted(T.search_bucket(q, np.arange(1000, 1060), floor, v, np.arange(500), 5))
    want = sorted((1000 + i, int(j), int(scores[i, j])) for i in range(60) for j in np.lexsort((np.arange(500), -scores[i]))[:5])
    assert got == want


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, None), (40, [nan, 1.0]), (60, [None, 1.0]), (80, [inf, 1.0]), (None, [1.0, 1.0]),
            (1, [0.0, 0.0]), (2, [-1.0, -2.0]), (3, [5.0]), (100, [7.0]), (120, []), (5, []), (6, [1.0, 2.0]), (140, [0.0, 0.0]), (160, [1.0, 2.0, 3.0])]
    assert run(spark, rows, k=3, every=20) == brute(rows, 3, 20)
    assert run(spark, []) == []


def test_large_numbers(spark):
    rows = [(0, [3e7, 1.0]), (1, [2.9e7, -3.0]), (2, [1e9, 1e9]), (3, [-1e16, 4.0]), (4, [1e16, 1e16])]
    assert run(spark, rows, k=4, every=1) == brute(rows, 4, 1)


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in QUERIES["op1_topk"](spark, SF_SMALL).collect())
    assert got == brute(rows, 20, 20)


def test_rows_that_repeat_an_id(spark):
    rows = [(20, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [0.5, 0.5])]
    assert len(run(spark, rows, k=20, every=20)) == 6
    more = rows + [(20, [-1.0, 0.0]), (1, [0.0, 9.0]), (40, [2.0, 2.0]), (40, [2.0, -2.0])]
    for k in (1, 2, 5, 20):
        assert run(spark, more, k=k, every=20) == brute(more, k, 20)


def test_query_with_repeated_ids_against_the_sql(spark, tmp_dir):
    import duckdb
    from parallax.llm.queries import ORACLE_SQL
    r = np.random.default_rng(5)
    rows = [(int(r.integers(0, 60)), [float(x) for x in r.integers(-2, 3, 4)], 1) for _ in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_dir}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_dir}/embeddings.parquet/*.parquet')")
    want = sorted(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({ORACLE_SQL['op1_topk']})").fetchall())
    assert sorted(tuple(x) for x in QUERIES["op1_topk"](spark, tmp_dir).select("query_id", "rank", "vec_id", "score").collect()) == want
