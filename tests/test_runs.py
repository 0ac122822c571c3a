"""Run analytics: goldens and layout invariance of the two-level scans."""

import random

import pytest
from pyspark.sql import functions as F

from parallax.operators import nbest as NB
from parallax.operators import runs as R
from parallax.operators.scan import chunk_by_count


def _vlog(spark, scores, run="r", task="t"):
    return spark.createDataFrame([(run, task, (i + 1) * 10, float(s), float(s), 1.0) for i, s in enumerate(scores)],
                                 "run string, task string, step long, bleu double, chrf double, loss double")


def test_stall_counter_golden(spark):
    # first score 0 (no improvement over the initial 0.0), an equal score, a drop
    v = _vlog(spark, [0.0, 5.0, 5.0, 4.0, 6.0, 6.0])
    got = [(r.best, r.stall) for r in R.stall_counter(v).orderBy("step").collect()]
    assert got == [(0.0, 1), (5.0, 1), (5.0, 2), (5.0, 3), (6.0, 1), (6.0, 2)]
    assert R.stop_step(v, patience=3).first().stop_step == 40
    b = R.best_checkpoint(v).first()
    assert (b.best, b.best_step) == (6.0, 50)
    s = R.resume_state(v, at_step=40).first()
    assert (s.best, s.stalled) == (5.0, 3)


def test_never_improving_run(spark):
    v = _vlog(spark, [0.0, -1.0, 0.0])
    got = [r.stall for r in R.stall_counter(v).orderBy("step").collect()]
    assert got == [1, 2, 3]
    assert R.best_checkpoint(v).first().best_step is None


def test_lm_patience(spark):
    v = spark.createDataFrame([("r", "t", i, 0.0, 0.0, l) for i, l in enumerate([3.0, 2.0, 2.5, 2.1, 2.0, 2.2, 2.3])],
                              "run string, task string, step long, bleu double, chrf double, loss double")
    assert R.lm_patience(v, patience=5).first().stop_step == 6


def test_scans_do_not_depend_on_chunking(spark, monkeypatch):
    rnd = random.Random(4)
    scores = [round(rnd.random() * 50, 2) for _ in range(400)]
    v = _vlog(spark, scores).union(_vlog(spark, scores[:37], run="q"))
    base = {(r.run, r.step): (r.best, r.stall) for r in R.stall_counter(v).collect()}
    many = lambda *a: chunk_by_count(*a, rows=7)  # noqa: E731  many chunks per run
    monkeypatch.setattr(R, "chunk_by_count", many)
    small = {(r.run, r.step): (r.best, r.stall) for r in R.stall_counter(v.repartition(13)).collect()}
    assert base == small
    # brute force
    best, stall = 0.0, 0
    for i, s in enumerate(scores):
        if s > best:
            best, stall = s, 0
        stall += 1
        assert base[("r", (i + 1) * 10)] == (best, stall)


def test_running_cost_and_checkpoints(spark):
    v = spark.createDataFrame([("r", "t", i, 0.0, 0.0, float(l)) for i, l in enumerate([1, 2, 3, 4])],
                              "run string, task string, step long, bleu double, chrf double, loss double")
    assert [r.running_cost for r in R.running_cost(v).orderBy("step").collect()] == [1.0, 1.5, 2.0, 2.5]
    ck = spark.createDataFrame([("r", "step", 1, "2024-01-01 00:00:01"), ("r", "step", 2, "2024-01-01 00:00:03"),
                                ("r", "step", 3, "2024-01-01 00:00:02"), ("r", "bestmodel", 2, "2024-01-01 00:00:03")],
                               "run string, kind string, step long, ctime string").withColumn("ctime", F.to_timestamp("ctime"))
    keep = {(r.kind, r.step): r.keep for r in R.keep_last_k(ck, 2).collect()}
    assert keep == {("step", 2): True, ("step", 3): True, ("step", 1): False, ("bestmodel", 2): True}
    newer = ck.union(spark.createDataFrame([("r", "epoch", 9, "2025-01-01 00:00:00")], "run string, kind string, step long, ctime string")
                     .withColumn("ctime", F.to_timestamp("ctime")))
    r = R.latest_checkpoint(newer).first()
    assert (r.latest_kind, r.latest_step) == ("step", 2)  # one over all kinds, end-of-epoch ones ignored
    r = R.latest_checkpoint(newer, explicit="/models/bestmodel-1").first()
    assert (r.latest_kind, r.latest_step) == ("bestmodel", 1)
    assert R.latest_checkpoint(newer, explicit="final").first().latest_step == 2  # not named like a checkpoint


def test_running_cost_starts_anew_each_epoch(spark):
    v = spark.createDataFrame([("r", "t", i, i // 2, float(x)) for i, x in enumerate([1, 2, 3, 5, 7])],
                              "run string, task string, step long, epoch long, loss double")
    got = [(r.running_cost, r.batches, r.epoch_cost) for r in R.running_cost(v, epoch="epoch").orderBy("step").collect()]
    assert got == [(1.0, 2, 1.5), (1.5, 2, 1.5), (3.0, 2, 4.0), (4.0, 2, 4.0), (7.0, 1, 7.0)]


@pytest.mark.parametrize("key", ["id", "id * 30000", "xxhash64(id)", "cast(pow(1.01, id % 500) * 1000 as bigint) + id"])
def test_chunks_follow_the_measured_range(spark, key):
    df = spark.range(20_000).selectExpr("'g' AS g", f"{key} AS k")
    chunks = chunk_by_count(df, ["g"], "k", rows=1000).groupBy("__by_count").agg(F.count("*").alias("n"), F.min("k"), F.max("k"))
    rows = chunks.orderBy("__by_count").collect()
    assert all(a[3] < b[2] for a, b in zip(rows, rows[1:]))  # in order
    if "pow" not in key:
        assert max(r["n"] for r in rows) <= 2000 and len(rows) == 20


def test_rerank_ties_and_nan(spark):
    hyp = spark.createDataFrame(
        [(0, 0, "a", 1.0), (0, 1, "b", 3.0), (0, 2, "c", 3.0),
         (1, 0, "d", float("nan")), (1, 1, "e", -1.0),
         (2, 0, "f", 0.5), (2, 1, "g", float("nan")), (2, 2, "h", 0.7)],
        "sent_id long, hyp_idx int, text string, loss double")
    mx = {r.sent_id: r.hyp_idx for r in NB.rerank(hyp, mode="max").collect()}
    assert mx == {0: 1, 1: 0, 2: 2}
    mn = {r.sent_id: r.hyp_idx for r in NB.rerank(hyp, mode="min").collect()}
    assert mn == {0: 0, 1: 1, 2: 0}
    flat = spark.createDataFrame([(i, f"h{i}") for i in range(10)], "p long, text string")
    g = NB.group_nbest(flat, "p", 5).collect()
    assert {(r.sent_id, r.hyp_idx) for r in g} == {(i // 5, i % 5) for i in range(10)}


def _log(spark, rows):
    return spark.createDataFrame(rows, "run string, task string, step long, bleu double")


def test_a_state_carried_on_equals_the_scan_of_the_whole_log(spark):
    import random
    from parallax.operators import runs as R
    rng = random.Random(6)
    rows = [(f"r{i % 7}" if i % 11 else None, "t", i, None if i % 13 == 0 else float(rng.randint(-2, 12))) for i in range(400)]
    state = lambda df: {(r["run"], r["task"]): (r["best"], r["stalled"], r["last_step"]) for r in df.collect()}

    def plain(rows):
        out = {}
        for run, task, step, score in sorted(rows, key=lambda r: r[2]):
            best, stalled, _ = out.get((run, task), (0.0, 0, None))
            better = score is not None and score > best
            out[run, task] = (score if better else best, 1 if better else stalled + 1, step)
        return out

    assert state(R.run_state(_log(spark, rows))) == plain(rows)
    for cut in (0, 1, 57, 399, 400):
        first = R.run_state(_log(spark, rows[:cut])) if cut else R.run_state(_log(spark, rows).limit(0))
        assert state(R.continue_state(first, _log(spark, rows[cut:]))) == plain(rows)
        assert state(R.continue_state(first, _log(spark, rows))) == plain(rows)  # what has been counted is passed over
    third = R.continue_state(R.continue_state(R.run_state(_log(spark, rows[:100])), _log(spark, rows[100:101])), _log(spark, rows[101:]))
    assert state(third) == plain(rows)


def test_state_of_an_empty_log(spark):
    from parallax.operators import runs as R
    none = _log(spark, [("r", "t", 1, 1.0)]).limit(0)
    assert R.run_state(none).collect() == []
    some = R.run_state(_log(spark, [("r", "t", 1, 1.0)]))
    assert R.continue_state(some, none).collect() == some.collect()


def test_the_resume_query_on_an_empty_log(spark):
    from pyspark.sql import functions as F
    from parallax.operators import runs as R
    none = _log(spark, [("r", "t", 1, 1.0)]).limit(0)
    assert R.resume_state(none, at_step=none.agg(F.expr("max(step) div 2")).scalar()).collect() == []


def test_chunks_stay_small_with_a_key_far_out(spark):
    from pyspark.sql import functions as F
    from parallax.operators.scan import chunk_by_count
    rows = spark.range(200_000).select(F.lit("g").alias("g"), F.when(F.col("id") == 77, F.lit(10 ** 12)).when(F.col("id") == 5, F.lit(-10 ** 14))
                                       .otherwise(F.col("id")).alias("o"))
    chunks = chunk_by_count(rows, ["g"], "o", "c", rows=2048)
    sizes = chunks.groupBy("c").agg(F.count("*").alias("n"), F.min("o").alias("a"), F.max("o").alias("b")).orderBy("c").collect()
    assert max(r["n"] for r in sizes) <= 3 * 2048 and sum(r["n"] for r in sizes) == 200_000
    assert all(x["b"] < y["a"] for x, y in zip(sizes, sizes[1:]))
    lone = chunk_by_count(spark.createDataFrame([("g", 1), ("g", None), (None, 3)], "g string, o long"), ["g"], "o", "c", rows=1).collect()
    assert len(lone) == 3
