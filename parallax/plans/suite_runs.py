"""Queries: n-best selection (W1-W3) and run analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nbest as NB
from ..operators import runs as R
from ..session import materialize
from . import fixtures as fx
from .registry import register

SCAN_SQL = """
  a AS (SELECT *, row_number() OVER w AS pos,
               max(bleu) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
        FROM vlog WINDOW w AS (PARTITION BY run, task ORDER BY step)),
  b AS (SELECT *, greatest(coalesce(prev, 0.0), 0.0) AS best_before,
               bleu > greatest(coalesce(prev, 0.0), 0.0) AS improved FROM a),
  c AS (SELECT *, max(CASE WHEN improved THEN pos END)
                    OVER (PARTITION BY run, task ORDER BY step ROWS UNBOUNDED PRECEDING) AS lst FROM b),
  st AS (SELECT *, greatest(best_before, bleu) AS best,
                CAST(CASE WHEN lst IS NULL THEN pos ELSE pos - lst + 1 END AS BIGINT) AS stall FROM c)
"""


@register("top1", sql="SELECT sent_id, text FROM nbest WHERE hyp_idx = 0")
def q_top1(spark, d):
    return NB.top1(fx.nbest(spark, d)).select("sent_id", "text")


@register("nbest_groups", sql="SELECT sent_id, hyp_idx, text, loss FROM nbest")
def q_nbest_groups(spark, d):
    return fx.nbest(spark, d).select("sent_id", "hyp_idx", "text", "loss")


@register("rerank", sql="""
  SELECT sent_id, hyp_idx, text, loss FROM (
    SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY
           CASE WHEN isnan(loss) OR loss <= 0 THEN 0.0 ELSE loss END DESC, hyp_idx) AS rk FROM nbest)
  WHERE rk = 1""")
def q_rerank(spark, d):
    return NB.rerank(fx.nbest(spark, d), "loss", "max").select("sent_id", "hyp_idx", "text", "loss")


@register("rerank_min", sql="""
  SELECT sent_id, hyp_idx, text, loss FROM (
    SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY
           CASE WHEN isnan(loss) THEN 'Infinity'::DOUBLE ELSE loss END, hyp_idx) AS rk FROM nbest)
  WHERE rk = 1""")
def q_rerank_min(spark, d):
    return NB.rerank(fx.nbest(spark, d), "loss", "min").select("sent_id", "hyp_idx", "text", "loss")


@register("running_best", sql=f""", {SCAN_SQL.strip()}
  SELECT run, task, step, bleu, best_before, improved, best FROM st""")
def q_running_best(spark, d):
    return R.running_best(fx.vlog(spark, d)).select("run", "task", "step", "bleu", "best_before",
                                                    "improved", "best")


@register("stall_counter", sql=f""", {SCAN_SQL.strip()}
  SELECT run, task, step, best, stall FROM st""")
def q_stall_counter(spark, d):
    return R.stall_counter(fx.vlog(spark, d)).select("run", "task", "step", "best", "stall")


@register("stop_step", sql=f""", {SCAN_SQL.strip()}
  SELECT run, task, min(CASE WHEN stall = 10 THEN step END) AS stop_step FROM st GROUP BY run, task""")
def q_stop_step(spark, d):
    """Where each run and task reaches patience 10; NULL if never."""
    return R.stop_step(fx.vlog(spark, d), patience=10)


@register("best_checkpoint", sql="""
  SELECT run, task, greatest(max(bleu), 0.0) AS best,
         CASE WHEN max(bleu) > 0.0 THEN arg_min(step, CASE WHEN bleu = mb THEN 0 ELSE 1 END) END AS best_step
  FROM (SELECT *, max(bleu) OVER (PARTITION BY run, task) AS mb FROM vlog) GROUP BY run, task""")
def q_best_checkpoint(spark, d):
    return R.best_checkpoint(fx.vlog(spark, d))


@register("resume_state", sql=f""", {SCAN_SQL.strip().replace('FROM vlog WINDOW', 'FROM vlog WHERE step <= (SELECT max(step) // 2 FROM vlog) WINDOW')}
  SELECT run, task, arg_max(best, step) AS best, arg_max(stall, step) AS stalled FROM st GROUP BY run, task""")
def q_resume_state(spark, d):
    """State at the middle of the log."""
    log = fx.vlog(spark, d)
    return R.resume_state(log, at_step=log.agg(F.expr("max(step) div 2")).scalar())


@register("continue_state", sql=f""", {SCAN_SQL.strip()}
  SELECT run, task, arg_max(best, step) AS best, arg_max(stall, step) AS stalled, max(step) AS last_step FROM st GROUP BY run, task""")
def q_continue_state(spark, d):
    """The state of the first half of the log, saved, carried on over the whole of it."""
    log = fx.vlog(spark, d)
    first = log.where(F.col("step") <= log.agg(F.expr("max(step) div 2")).scalar())
    return R.continue_state(materialize(R.run_state(first), "run-state"), log)


@register("lm_patience", sql="""
  , a AS (SELECT *, row_number() OVER w AS pos,
               max(-loss) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
        FROM vlog WINDOW w AS (PARTITION BY run, task ORDER BY step)),
  b AS (SELECT *, (prev IS NULL OR -loss > prev) AS imp FROM a),
  c AS (SELECT *, pos - max(CASE WHEN imp THEN pos END)
                    OVER (PARTITION BY run, task ORDER BY step ROWS UNBOUNDED PRECEDING) AS counter FROM b)
  SELECT run, task, min(CASE WHEN counter = 5 THEN step END) AS stop_step FROM c GROUP BY run, task""")
def q_lm_patience(spark, d):
    return R.lm_patience(fx.vlog(spark, d), patience=5)


@register("running_cost", sql="""
  SELECT run, task, step,
         CAST(sum(CAST(round(loss * 10000) AS BIGINT)) OVER w AS DOUBLE) / (count(*) OVER w * 10000.0) AS running_cost
  FROM vlog WINDOW w AS (PARTITION BY run, task ORDER BY step ROWS UNBOUNDED PRECEDING)""")
def q_running_cost(spark, d):
    out = R.running_cost(fx.vlog(spark, d), decimals=4)
    return out.select("run", "task", "step", "running_cost")


@register("keep_last_k", sql="""
  SELECT run, kind, step,
         row_number() OVER (PARTITION BY run, kind ORDER BY ctime DESC, step DESC) <= 2 AS keep FROM ckpt""")
def q_keep_last_k(spark, d):
    return R.keep_last_k(fx.ckpt(spark, d), k=2).select("run", "kind", "step", "keep")


KIND_SQL = "CASE step % 3 WHEN 0 THEN 'step' WHEN 1 THEN 'bestmodel' ELSE 'epoch' END"


@register("latest_checkpoint", sql=f"""
  SELECT run, arg_max(kind, (ctime, step)) AS latest_kind, arg_max(step, (ctime, step)) AS latest_step
  FROM (SELECT run, {KIND_SQL} AS kind, step, ctime FROM ckpt) WHERE kind <> 'epoch' GROUP BY run""")
def q_latest_checkpoint(spark, d):
    """W10 over three kinds of checkpoint, of which one is not resumable."""
    return R.latest_checkpoint(fx.ckpt(spark, d).withColumn("kind", F.expr(KIND_SQL)))


@register("running_cost_epochs", sql="""
  SELECT run, task, epoch, step, batches,
         CAST(sum(l) OVER w AS DOUBLE) / (count(*) OVER w * 10000.0) AS running_cost, epoch_cost
  FROM (SELECT *, count(*) OVER e AS batches, CAST(sum(l) OVER e AS DOUBLE) / (count(*) OVER e * 10000.0) AS epoch_cost
        FROM (SELECT run, task, step // 2000 AS epoch, step, CAST(round(loss * 10000) AS BIGINT) AS l FROM vlog)
        WINDOW e AS (PARTITION BY run, task, epoch))
  WINDOW w AS (PARTITION BY run, task, epoch ORDER BY step ROWS UNBOUNDED PRECEDING)""")
def q_running_cost_epochs(spark, d):
    """A14 with the sum started anew each epoch, and at the epoch's end."""
    log = fx.vlog(spark, d).withColumn("epoch", F.floor(F.col("step") / 2000))
    out = R.running_cost(log, decimals=4, epoch="epoch")
    return out.select("run", "task", "epoch", "step", "batches", "running_cost", "epoch_cost")
