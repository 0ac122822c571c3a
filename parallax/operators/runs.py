"""Validation-log and checkpoint analytics.

The reference keeps a running best score and a stall counter in Python
variables; here they are prefix aggregates over ``(run, task)`` ordered by
step, computed with the two-level scan (``scan.prefix_scan``) so that a run
holding a third of all rows still spreads over many tasks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import chunk_by_count, prefix_scan

KEYS = ("run", "task")


def _scan(vlog: DataFrame, keys, step: str, specs) -> DataFrame:
    """Running aggregates by step, in chunks of measured width."""
    out = chunk_by_count(vlog, list(keys), step)
    return prefix_scan(out, list(keys), F.col("__by_count"), [step], specs).drop("__by_count")


def running_best(vlog: DataFrame, metric: str = "bleu", keys=KEYS, step: str = "step",
                 seed_best: float = 0.0) -> DataFrame:
    """Best-so-far before and after each evaluation, starting at
    ``seed_best`` (0.0); an evaluation improves when strictly greater."""
    out = _scan(vlog, keys, step,
                      [("__pos", "count", None, True), ("__prev", "max", F.col(metric), False)])
    before = F.greatest(F.coalesce(F.col("__prev"), F.lit(seed_best)), F.lit(seed_best))
    return (out.withColumn("best_before", before)
            .withColumn("improved", F.col(metric) > F.col("best_before"))
            .withColumn("best", F.greatest(F.col("best_before"), F.col(metric)))
            .withColumnRenamed("__pos", "eval_no").drop("__prev"))


def stall_counter(vlog: DataFrame, metric: str = "bleu", keys=KEYS, step: str = "step",
                  seed_best: float = 0.0, seed_stall: int = 0) -> DataFrame:
    """Evaluations since the last improvement, the improving one scoring 1
    (the reference resets to 0 and then adds 1).  Before any improvement the
    count continues from ``seed_stall``."""
    rb = running_best(vlog, metric, keys, step, seed_best)
    out = _scan(rb, keys, step,
                      [("__last", "max", F.when(F.col("improved"), F.col("eval_no")), True)])
    stall = F.when(F.col("__last").isNull(), F.lit(seed_stall) + F.col("eval_no")) \
        .otherwise(F.col("eval_no") - F.col("__last") + 1)
    return out.withColumn("stall", stall.cast("long")).drop("__last")


def stop_step(vlog: DataFrame, patience: int, metric: str = "bleu", keys=KEYS, step: str = "step") -> DataFrame:
    """First evaluation whose stall counter equals ``patience`` (NULL: never)."""
    s = stall_counter(vlog, metric, keys, step)
    return s.groupBy(*keys).agg(F.min(F.when(F.col("stall") == patience, F.col(step))).alias("stop_step"))


def best_checkpoint(vlog: DataFrame, metric: str = "bleu", keys=KEYS, step: str = "step",
                    seed_best: float = 0.0) -> DataFrame:
    """Best score and the step where it was first reached (a checkpoint
    is saved only on strict improvement over ``seed_best``)."""
    m = F.col(metric)
    key = F.struct(m.alias("v"), (-F.col(step)).alias("s"))
    return vlog.groupBy(*keys).agg(F.max(key).alias("__b")).select(
        *keys,
        F.greatest(F.col("__b.v"), F.lit(seed_best)).alias("best"),
        F.when(F.col("__b.v") > seed_best, -F.col("__b.s")).alias("best_step"))


def run_state(vlog: DataFrame, metric: str = "bleu", keys=KEYS, step: str = "step", seed_best: float = 0.0) -> DataFrame:
    """``(<keys>, best, stalled, last_step)`` after all evaluations of the
    log: what a run saves with a checkpoint, one row a run and task."""
    none = vlog.select(*keys).limit(0).select(*keys, F.lit(None).cast("double").alias("best"), F.lit(None).cast("long").alias("stalled"),
                                              F.lit(None).cast("long").alias("last_step"))
    return continue_state(none, vlog, metric, keys, step, seed_best)


def continue_state(state: DataFrame, later: DataFrame, metric: str = "bleu", keys=KEYS, step: str = "step", seed_best: float = 0.0) -> DataFrame:
    """A saved ``state`` (see :func:`run_state`) carried on over later evaluations.

    The old log is not needed: an evaluation improves if it is above the
    saved best and all later ones before it, so the last improvement is the
    first evaluation with the highest score, if that is above the saved
    best, and counts as 1 itself (see :func:`stall_counter`).  Evaluations up to ``last_step`` have been counted already and are
    passed over, so a log delivered twice changes nothing.  Runs without a
    state begin at ``seed_best``; runs without later evaluations keep theirs;
    a null score improves nothing."""
    keys = list(keys)
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    known = state.select(*keys, F.col("best").alias("__best"), F.col("stalled").alias("__stalled"), F.col("last_step").alias("__last"))
    new = later.select(*keys, F.col(step).cast("long").alias("__step"), F.col(metric).cast("double").alias("__m"))
    new = (new.alias("n").join(known.alias("k"), same("n", "k"), "left").where(F.col("__last").isNull() | (F.col("__step") > F.col("__last")))
           .select(*[F.col(f"n.{k}").alias(k) for k in keys], "__step", "__m", "__best"))
    start = F.coalesce("__best", F.lit(float(seed_best)))
    top = new.groupBy(*keys).agg(F.max(F.when(F.col("__m") > start, F.struct(F.col("__m").alias("v"), (-F.col("__step")).alias("s")))).alias("__top"))
    after = (new.alias("n").join(top.alias("t"), same("n", "t")).select(*[F.col(f"n.{k}").alias(k) for k in keys], "__step", "__top")
             .groupBy(*keys).agg(F.max("__top").alias("__top"), F.max("__step").alias("__step"),
                                 F.count(F.when(F.col("__top").isNull() | (F.col("__step") >= -F.col("__top.s")), 1)).alias("__n")))
    both = known.alias("k").join(after.alias("a"), same("k", "a"), "full_outer")
    improved = F.col("__top").isNotNull()
    return both.select(*[F.coalesce(F.col(f"k.{k}"), F.col(f"a.{k}")).alias(k) for k in keys],
                       F.when(improved, F.col("__top.v")).otherwise(F.coalesce("__best", F.lit(float(seed_best)))).alias("best"),
                       F.when(improved, F.col("__n")).otherwise(F.coalesce("__stalled", F.lit(0)) + F.coalesce("__n", F.lit(0))).cast("long").alias("stalled"),
                       F.coalesce("__step", "__last").alias("last_step"))


def resume_state(vlog: DataFrame, at_step: int | Column, metric: str = "bleu", keys=KEYS, step: str = "step") -> DataFrame:
    """(best, stalled) as saved with the checkpoint at ``at_step``."""
    s = stall_counter(vlog.where(F.col(step) <= at_step), metric, keys, step)
    last = F.max_by(F.struct(F.col("best"), F.col("stall")), F.col(step))
    return s.groupBy(*keys).agg(last.alias("__l")).select(*keys, F.col("__l.best").alias("best"),
                                                          F.col("__l.stall").alias("stalled"))


def lm_patience(vlog: DataFrame, patience: int = 5, metric: str = "loss", keys=KEYS,
                step: str = "step") -> DataFrame:
    """Early stopping on a minimised metric (eval loss): the counter is
    0 after an improvement and +1 otherwise; stop when it reaches ``patience``."""
    out = _scan(vlog, keys, step,
                      [("__pos", "count", None, True), ("__prev", "max", -F.col(metric), False)])
    improved = F.col("__prev").isNull() | (-F.col(metric) > F.col("__prev"))
    out = out.withColumn("__imp", improved)
    out = _scan(out, keys, step,
                      [("__last", "max", F.when(F.col("__imp"), F.col("__pos")), True)])
    counter = F.col("__pos") - F.col("__last")
    return out.groupBy(*keys).agg(F.min(F.when(counter == patience, F.col(step))).alias("stop_step"))


def running_cost(vlog: DataFrame, loss: str = "loss", keys=KEYS, step: str = "step",
                 decimals: int | None = None, epoch: str | None = None) -> DataFrame:
    """Cumulative loss divided by the number of batches so far.

    ``epoch`` names the column whose change starts the sum and the count
    anew; ``epoch_cost`` is then also given.  With ``decimals`` the losses
    are summed as exact integers in units of 10^-decimals and divided once,
    so the result does not depend on the order in which partial sums were
    combined."""
    keys = [*keys, epoch] if epoch else list(keys)
    value = F.col(loss) if decimals is None else F.round(F.col(loss) * 10 ** decimals).cast("long")
    out = _scan(vlog, keys, step, [("__n", "count", None, True), ("__sum", "sum", value, True)])
    scale = F.lit(float(1 if decimals is None else 10 ** decimals))
    out = out.withColumn("running_cost", F.col("__sum").cast("double") / (F.col("__n") * scale)).drop("__n", "__sum")
    if not epoch:
        return out
    return out.join(epoch_cost(vlog, loss, keys[:-1], epoch, decimals), keys)


def epoch_cost(vlog: DataFrame, loss: str = "loss", keys=KEYS, epoch: str = "epoch",
               decimals: int | None = None) -> DataFrame:
    """A14 at the end of an epoch: all its losses over its number of batches."""
    value = F.col(loss) if decimals is None else F.round(F.col(loss) * 10 ** decimals).cast("long")
    scale = F.lit(float(1 if decimals is None else 10 ** decimals))
    return vlog.groupBy(*keys, epoch).agg(
        F.count(F.lit(1)).alias("batches"),
        (F.sum(value).cast("double") / (F.count(F.lit(1)) * scale)).alias("epoch_cost"))


def keep_last_k(ckpt: DataFrame, k: int = 1, keys=("run", "kind"), ctime: str = "ctime",
                step: str = "step") -> DataFrame:
    """Mark the newest ``k`` checkpoints per kind; the rest are listed
    for removal (nothing is deleted).  ``row_number() <= k`` lets Spark insert
    a per-partition group limit before the shuffle, so a hot kind ships at
    most k rows per task."""
    w = Window.partitionBy(*keys).orderBy(F.col(ctime).desc(), F.col(step).desc())
    top = (ckpt.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k)
           .select(*keys, step, F.lit(True).alias("keep")))
    return ckpt.join(top, [*keys, step], "left").withColumn("keep", F.coalesce("keep", F.lit(False)))


#: kinds of checkpoint that a run can be resumed from (an end-of-epoch one is not)
RESUMABLE = ("step", "bestmodel")


def latest_checkpoint(ckpt: DataFrame, keys=("run",), kind: str = "kind", ctime: str = "ctime", step: str = "step",
                      kinds=RESUMABLE, explicit: str | None = None) -> DataFrame:
    """The newest checkpoint of a run over all resumable kinds, by
    ctime (ties: larger step, then kind).  An ``explicit`` name wins if it
    is named like a checkpoint (a resumable kind and a step number);
    otherwise it is ignored."""
    m = re.fullmatch(rf"(?:.*/)?({'|'.join(map(re.escape, kinds))})[_-]?(\d+)/?", explicit or "")
    newest = F.max_by(F.struct(F.col(kind).alias("k"), F.col(step).alias("s")), F.struct(ctime, step, kind))
    out = ckpt.where(F.col(kind).isin(*kinds)).groupBy(*keys).agg(newest.alias("__l"))
    if m:
        return out.select(*keys, F.lit(m[1]).alias("latest_kind"), F.lit(int(m[2])).cast("long").alias("latest_step"))
    return out.select(*keys, F.col("__l.k").alias("latest_kind"), F.col("__l.s").alias("latest_step"))
