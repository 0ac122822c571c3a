"""Exact top-k inner-product search over norm buckets.

Candidates are grouped by length into buckets, searched in rounds from the
longest to the shortest.  A query's threshold is the k-th best product of the
rounds before; with a bucket's largest length it becomes a local cosine
threshold.  Above 1 the bucket is
skipped; a high one prunes by the coordinates that a candidate must have, a
low one by length alone.  What is left is verified by exact products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._common import remove, save

#: candidates in a bucket and queries in a block (expected), coordinates looked at, cosine from which they prune
BUCKET, QUERIES, FOCUS, COORDINATE = 2048, 1024, 4, 0.5
#: bucket bounds are at most so many; longer lists of equal lengths are split by hash
BOUNDS = 1000
_LONG = 2 ** 63


def whole_numbers(v: Column, scale: float) -> Column:
    """floor(scale * component), the component as double."""
    return F.transform(v.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("long"))


def _usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows as long, clamped to its range."""
    dim = q.shape[1]
    most = (float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(v.astype(np.float64)).max(initial=0))) * max(dim, 1)
    if most < 2 ** 53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    if most < 2 ** 62:
        return q @ v.T
    exact = q.astype(object) @ v.astype(object).T
    return np.array([[max(-_LONG, min(_LONG - 1, int(x))) for x in row] for row in exact], np.int64).reshape(len(q), len(v))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(score) > 4 * k:
        least = np.partition(score, -k)[-k]
        some = np.flatnonzero(score >= least)
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]


def search_bucket(q: np.ndarray, q_id: np.ndarray, floor: np.ndarray, v: np.ndarray, v_id: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """``(query, candidate, score)``, by ids: per query its k best of one bucket with a score of at least ``floor`` (NaN: any)."""
    return [(int(q_id[i]), int(v_id[j]), s) for i, j, s in search_rows(q, q_id, floor, v, v_id, k)]


def search_rows(q: np.ndarray, q_id: np.ndarray, floor: np.ndarray, v: np.ndarray, v_id: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """:func:`search_bucket` by places; a query and a candidate of one id do not meet."""
    q_len = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    v_len = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(-v_len, kind="stable")
    v, v_id, v_len = v[order], v_id[order], v_len[order]
    unit = v / np.where(v_len > 0, v_len, 1)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = floor / (q_len * v_len[0]) if len(v) else floor
    out: list[tuple[int, int, int]] = []

    def keep(i: int, at: np.ndarray, score: np.ndarray) -> None:
        fine = v_id[at] != q_id[i]
        if not np.isnan(floor[i]):
            fine &= score >= floor[i] - abs(floor[i]) * 1e-12
        at, score = at[fine], score[fine]
        best = _best(score, v_id[at], k)
        out.extend((i, int(order[a]), int(s)) for a, s in zip(at[best], score[best]))

    plain = []
    for i in range(len(q)):
        t = cosine[i]
        if t > 1 + 1e-9:  # no candidate is long enough
            continue
        if not t >= COORDINATE:  # also where there is no threshold yet
            plain.append(i)
            continue
        # a candidate as near as t has each coordinate within the cap around the query's
        own = q[i] / q_len[i]
        t = min(t, 1.0) - 1e-9
        focus = np.argsort(-np.abs(own))[:FOCUS]
        wide = np.sqrt(max(0.0, 1 - t * t)) * np.sqrt(np.maximum(0.0, 1 - own[focus] ** 2))
        low = np.where(own[focus] <= -t, -1.0, own[focus] * t - wide)
        high = np.where(own[focus] >= t, 1.0, own[focus] * t + wide)
        near = ((unit[:, focus] >= low - 1e-9) & (unit[:, focus] <= high + 1e-9)).all(axis=1)
        at = np.flatnonzero(near & (v_len * q_len[i] >= floor[i] * (1 - 1e-9)))
        if len(at):
            keep(i, at, products(q[i:i + 1], v[at])[0])
    for s in range(0, len(plain), 256):
        some = plain[s:s + 256]
        scores = products(q[some], v)
        for i, score in zip(some, scores):
            if floor[i] > 0:  # lengths fall, so those long enough come first
                n = int(np.searchsorted(-v_len * q_len[i], -floor[i] * (1 - 1e-9), "right"))
                keep(i, np.arange(n), score[:n])
            else:
                keep(i, np.arange(len(v)), score)
    return out


def _search(due: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Searches each ``(qblock, bucket)`` of ``due(qblock, bucket, key, id, floor, v)`` in a task of its own."""
    meet = due.select("qblock", "bucket").distinct()
    left = due.select("qblock", "bucket", F.lit(True).alias("asks"), "key", "id", "floor", "v")
    right = candidates.join(meet, "bucket").select("qblock", "bucket", F.lit(False).alias("asks"), "key", "id", F.lit(None).cast("double").alias("floor"), "v")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, c = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        rows = []
        if len(q) and len(c):
            q_key, c_key, c_id = q["key"].to_numpy(), c["key"].to_numpy(), c["id"].to_numpy()
            rows = [(q_key[i], c_key[j], c_id[j], s) for i, j, s in search_rows(
                np.stack(q["v"].to_numpy()), q["id"].to_numpy(), q["floor"].to_numpy(np.float64), np.stack(c["v"].to_numpy()), c_id, k)]
        return pd.DataFrame(rows, columns=["key", "vec_key", "vec_id", "score"])

    return left.unionByName(right).groupBy("qblock", "bucket").applyInPandas(run, "key long, vec_key long, vec_id long, score long")


def _best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id", "vec_key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _all_rows(best: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query id: a find counts once for each pair of rows that repeat it."""
    of = rows.select("key", F.col("id").alias("query_id"), F.col("n").alias("asked"))
    times = rows.select(F.col("key").alias("vec_key"), F.col("n").alias("found"))
    each = best.join(of, "key").join(times, "vec_key").select(
        "query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(k).cast("long"), F.col("asked") * F.col("found")))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", scale: float = 64.0, every: int = 20,
          bucket: int = BUCKET, block: int = QUERIES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible by ``every`` its k best other rows.

    The score is the inner product of ``floor(scale * component)``; ties go
    to the smaller id.  Rows with a null id, or a vector that is null or holds
    null or non-finite components, take no part; vectors of different length
    do not compare; a query with fewer than k candidates gets them all.  Rows
    that repeat an id are each a candidate, though not for queries of that
    id; as queries they share the k places of their id.  Scores are clamped to the range of long.  Other columns are
    ignored; an empty table gives an empty one."""
    spark = vectors.sparkSession
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("raw"))
            .where(F.col("id").isNotNull() & _usable(F.col("raw")))
            .select("id", whole_numbers(F.col("raw"), scale).alias("v")).groupBy("id", "v").agg(F.count("*").alias("n"))
            .withColumn("key", F.monotonically_increasing_id()))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows, r_path = save(rows.withColumns({"dim": F.size("v"), "len": length}), "vectors")

    # buckets of like length, the longest first; many rows of one length are split by hash
    per_dim = rows.groupBy("dim").agg(F.count("*").alias("n"), F.percentile_approx(
        "len", F.array(*[F.lit(i / BOUNDS) for i in range(BOUNDS + 1)]), F.lit(10 * BOUNDS)).alias("cut"))
    per_dim = per_dim.withColumn("step", F.greatest(F.lit(1.0), F.lit(float(bucket) * BOUNDS) / F.col("n")))
    bounds = per_dim.select("dim", F.transform(F.sequence(F.lit(0), F.floor(F.lit(float(BOUNDS)) / F.col("step")).cast("int")),
                                               lambda i: F.element_at("cut", F.least(F.lit(BOUNDS + 1), F.floor(i * F.col("step")).cast("int") + 1)))
                            .alias("bounds"))
    band = rows.join(bounds, "dim").withColumn("band", F.size(F.filter(F.array_distinct("bounds"), lambda b: b <= F.col("len")))).drop("bounds")
    parts = band.groupBy("dim", "band").agg(F.ceil(F.count("*") / bucket).alias("parts"))
    placed = (band.join(parts, ["dim", "band"])
              .withColumn("bucket", F.struct("dim", "band", F.pmod(F.xxhash64("key"), F.col("parts")).alias("part"))))
    placed, p_path = save(placed.select("key", "id", "v", "dim", "len", "bucket"), "placed")
    buckets = placed.groupBy("bucket", "dim").agg(F.max("len").alias("longest"), F.count("*").alias("n"))

    asks = placed.where(F.col("id") % every == 0)
    blocks = asks.groupBy("dim").agg(F.ceil(F.count("*") / block).alias("blocks"))
    asks = (asks.drop("bucket").join(blocks, "dim")
            .withColumn("qblock", F.struct("dim", F.pmod(F.xxhash64(F.lit(1), "key"), F.col("blocks")).alias("part"))).drop("blocks"))

    # rounds over ever more buckets, the longest first: what a round finds raises the thresholds of the next,
    # so a round hands back a few times k rows for a query, not k for each bucket
    by_length = Window.partitionBy("dim").orderBy(F.desc("longest"), "bucket")
    buckets, b_path = save(buckets.withColumn("place", F.row_number().over(by_length) - 1), "buckets")
    last = buckets.agg(F.coalesce(F.max("place"), F.lit(0))).first()[0]
    best, paths, low, high = None, [r_path, p_path, b_path], 0, 1
    while best is None or low <= last:
        now = buckets.where((F.col("place") >= low) & (F.col("place") < high)).select("dim", "bucket", "longest")
        due = asks.withColumn("floor", F.lit(None).cast("double")) if best is None else asks.join(
            best.groupBy("key").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("floor")), "key", "left")
        reach = F.col("floor").isNull() | (F.col("len") * F.col("longest") >= F.col("floor") * F.lit(1 - 1e-9))
        due, d_path = save(due.join(now, "dim").where(reach).select("qblock", "bucket", "key", "id", "floor", "v"), "due")
        found = _search(due, placed, k)
        found = found if best is None else best.drop("rank").unionByName(found)
        best, path = save(_best_of(found, k), "top")
        paths += [d_path, path]
        low, high = high, 4 * high
    out, _ = save(_all_rows(best, rows, k), "top")
    remove(spark, *paths)
    return out
