"""Queries: workflows composed from the operators (X1-X4, X8, X10) and TER (A10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..operators import corpus as C
from ..operators import metrics as M
from ..session import scratch_path
from . import fixtures as fx
from . import workflows as W
from .registry import register
from .suite_cleaning import LCS_SQL, _squeeze_sql
from .suite_corpus import MANIFEST_JSON, MANIFEST_SQL
from .suite_runs import SCAN_SQL
from .suite_scoring import CHRF_EXPR, bleu_ctes, bleu_expr, chrf_ctes, sql_wer_words


def _clean_sql(lo, hi, view="pairs_docs", cols="corpus, doc_id, line_no"):
    return f"""
  SELECT {cols}, source, target FROM (
    SELECT {cols}, {_squeeze_sql('source')} AS source, {_squeeze_sql('target')} AS target FROM {view})
  WHERE source <> '' AND target <> ''
    AND len(string_split(source, ' ')) BETWEEN {lo} AND {hi} AND len(string_split(target, ' ')) BETWEEN {lo} AND {hi}
    AND len(string_split(source, ' ')) <= 9 * len(string_split(target, ' '))
    AND len(string_split(target, ' ')) <= 9 * len(string_split(source, ' '))"""


@register("prepare", sql=_clean_sql(2, 70))
def q_prepare(spark, d):
    """Family -> clean (2, 70) -> append per corpus (K3) -> training table."""
    fam = fx.pairs_docs(spark, d).select("corpus", "doc_id", "line_no", "source", "target")
    return W.prepare(fam, scratch_path(spark, "train")).select("corpus", "doc_id", "line_no", "source", "target")


@register("prepare_runs", sql=f"""
  SELECT r.run, c.* FROM ({_clean_sql(2, 70)}) c, (VALUES ('first'), ('second')) r(run)""")
def q_prepare_runs(spark, d):
    """X1 and K3 by run: two runs, the first one repeated."""
    fam = fx.pairs_docs(spark, d).select("corpus", "doc_id", "line_no", "source", "target")
    out = scratch_path(spark, "train-runs")
    for run in ("first", "second", "first"):
        table = W.prepare(fam, out, run=run)
    return table.select("run", "corpus", "doc_id", "line_no", "source", "target")


@register("prepare_similar", sql=f"""
  , {LCS_SQL.strip()},
  cl AS ({_clean_sql(1, 60, "pairs_parts", "seg_id").replace("source", "hyp").replace("target", "ref")})
  SELECT 'original' AS dataset, seg_id, hyp, ref FROM cl
  UNION ALL
  SELECT 'levenshtein' AS dataset, c.seg_id, c.hyp, c.ref FROM cl c JOIN lcs l ON l.seg_id = c.seg_id
  WHERE CASE WHEN l.m + l.n = 0 THEN 1.0 ELSE 2.0 * l.lcs / (l.m + l.n) END BETWEEN 0.25 AND 0.99""",
          ctes=[("pp", "SELECT seg_id, lower(hyp) AS a, lower(ref) AS b FROM pairs_parts")], recursive=True)
def q_prepare_similar(spark, d):
    """Clean (1, 60) -> 'original'; then the similarity band -> 'levenshtein'; both written (K3)."""
    out = W.prepare_similar(fx.pairs_parts(spark, d), scratch_path(spark, "similar"), src="hyp", tgt="ref")
    return out.select("dataset", "seg_id", "hyp", "ref")


@register("prepare_filtered")
def q_prepare_filtered(spark, d):
    """X3 (dormant in the reference): normalise -> tokenise -> clean (1, 80)
    -> source language = es -> similarity band; the three published variants
    with their text."""
    return W.prepare_filtered(fx.pairs_docs(spark, d), fx.line_labels(spark, d), ["corpus", "doc_id", "line_no"])


MIX_KEY = "md5('42-' || tag || '-' || ord || '-' || corpus || '-' || doc_id || '-' || line_no)"


@register("build_mixture", sql=f"""
  SELECT tag, CAST(ord AS INTEGER) AS ord, corpus, doc_id, line_no, 'spa_Latn' AS src_tag, tag AS tgt_tag,
         rank, CAST((rank - 1) // 16 AS BIGINT) AS batch_id,
         CAST(least(len({fx.sql_words("'<2' || tag || '> ' || source")}), 100) AS BIGINT) AS n_src,
         CAST(least(len({fx.sql_words("tag || ' ' || target")}), 100) AS BIGINT) AS n_tgt
  FROM (SELECT p.*, m.tag, m.ord, row_number() OVER (ORDER BY {MIX_KEY.replace('corpus', 'p.corpus')}, m.tag, m.ord, p.corpus, p.doc_id, p.line_no) AS rank
        FROM pairs_docs p JOIN ({MANIFEST_SQL}) m ON m.corpus = p.corpus)""")
def q_build_mixture(spark, d):
    """Manifest (S5) -> tags (P5) -> prefix / tag (P3, P4) -> encode and
    truncate (P12) -> union (U-ALL, in the join) -> seeded shuffle (B3) ->
    batches (B6)."""
    return _mixture(spark, d, tk.word_length_ids)


@register("build_mixture_subword")
def q_build_mixture_subword(spark, d):
    """X4 with subword pieces."""
    return _mixture(spark, d, fx.subwords(spark))


def _mixture(spark, d, encoder):
    pairs = fx.pairs_docs(spark, d).select("corpus", "doc_id", "line_no", "source", "target")
    out = W.training_mixture(pairs, C.manifest_rows(spark, MANIFEST_JSON), encoder, ["corpus", "doc_id", "line_no"], "spa_Latn")
    return out.select("tag", "ord", "corpus", "doc_id", "line_no", "src_tag", "tgt_tag", "rank", "batch_id",
                      F.size("src_ids").cast("long").alias("n_src"), F.size("tgt_ids").cast("long").alias("n_tgt"))


SYS_BASE = ("sys_base", "SELECT 'A' AS system, seg_id AS seg, hyp_a AS hyp, ref FROM two_systems "
                        "UNION ALL SELECT 'B' AS system, seg_id AS seg, hyp_b AS hyp, ref FROM two_systems")


@register("evaluate", sql=f"""
  , ev AS (SELECT system, count(*) AS n, CAST(sum(CASE WHEN hyp = ref THEN 1 ELSE 0 END) AS BIGINT) AS n_correct,
                 CAST(sum(levenshtein(hyp, ref)) AS BIGINT) AS total_distance FROM sys_base GROUP BY system),
  wr AS (SELECT system, CAST(sum(levenshtein(hx, rx)) AS BIGINT) AS edits, CAST(sum(len(rw)) AS BIGINT) AS ref_words
         FROM (SELECT system, rw,
                 array_to_string(list_transform(hw, lambda w: chr(64 + list_position(v, w))), '') AS hx,
                 array_to_string(list_transform(rw, lambda w: chr(64 + list_position(v, w))), '') AS rx
               FROM (SELECT system, hw, rw, list_distinct(list_concat(hw, rw)) AS v
                     FROM (SELECT system, {sql_wer_words('hyp')} AS hw, {sql_wer_words('ref')} AS rw FROM sys_base)))
         GROUP BY system)
  SELECT ev.system, ev.n, ev.n_correct, round(ev.n_correct / ev.n, 6) AS accuracy, ev.total_distance,
         round(ev.total_distance / ev.n, 6) AS mean_distance, wr.edits, wr.ref_words,
         round(wr.edits / wr.ref_words, 6) AS wer, b.sys_len, b.ref_len, {bleu_expr('b.')} AS bleu, {CHRF_EXPR} AS chrf
  FROM ev JOIN wr USING (system) JOIN b_stats b USING (system) JOIN c_pr c USING (system)""",
          ctes=[SYS_BASE] + bleu_ctes("sys_base", ["system"]) + chrf_ctes("sys_base", ["system"]))
def q_evaluate(spark, d):
    """Strip, then every metric per system in one pass (TER, which has no SQL form, is the query ``ter``)."""
    s = fx.two_systems(spark, d)
    seg = C.concat_corpora({"A": s.select("seg_id", F.col("hyp_a").alias("hyp"), "ref"),
                            "B": s.select("seg_id", F.col("hyp_b").alias("hyp"), "ref")}, "system")
    return W.evaluate_systems(seg, keys=["system"], with_ter=False)


@register("compare_systems")
def q_compare_systems(spark, d):
    """X8 with A15: three systems on whole lines, all pairs, BLEU, chrF and TER at 10,000 trials."""
    hyps = {"A": F.col("hyp_a"), "B": F.col("hyp_b"), "C": F.concat_ws(" ", "hyp_a", "hyp_b")}
    of = F.explode(F.array(*[F.struct(F.lit(n).alias("system"), h.alias("hyp")) for n, h in hyps.items()])).alias("x")
    return M.compare_systems(fx.line_systems(spark, d).select("seg_id", "ref", of).select("seg_id", "x.system", "x.hyp", "ref"))


@register("ter")
def q_ter(spark, d):
    """A10: TER per system (rows-only: no SQL form of the shift search)."""
    s = fx.two_systems(spark, d)
    seg = C.concat_corpora({"A": s.select(F.col("hyp_a").alias("hyp"), "ref"),
                            "B": s.select(F.col("hyp_b").alias("hyp"), "ref")}, "system")
    return M.ter(seg, keys=["system"])


@register("ter_lines")
def q_ter_lines(spark, d):
    """A10 on whole lines, per language."""
    return M.ter(fx.pairs_docs(spark, d), "source", "target", keys=["lang"])


@register("analyze_run", sql=f""", {SCAN_SQL.strip()}
  SELECT run, task, count(*) AS n_evals, greatest(max(bleu), 0.0) AS best,
         min(CASE WHEN improved AND best = (SELECT max(s2.best) FROM st s2 WHERE s2.run = st.run AND s2.task = st.task)
             THEN step END) AS best_step,
         coalesce(min(CASE WHEN stall = 10 THEN step END), -1) AS stop_step,
         arg_max(stall, step) AS final_stall
  FROM st GROUP BY run, task""")
def q_analyze_run(spark, d):
    """-1 stands for a patience of 10 that is never reached."""
    return W.analyze_run(fx.vlog(spark, d), patience=10).withColumn("stop_step", F.coalesce("stop_step", F.lit(-1)))
