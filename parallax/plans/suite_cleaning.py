"""Queries: alignment and pair cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.similarity import indel_ratio
from ..functions.text import normalize_punct, normalize_punct_rules
from ..operators.align import paste, zip_strict
from ..operators.filters import (clean_pairs, drop_empty, filter_language, filter_max_tokens,
                                 filter_similarity)
from ..functions.tokens import encode_words
from . import fixtures as fx
from .registry import register

# the DuckDB bit-parallel LCS (strings of at most 62 characters) as CTEs over
# a pair view ``pp(seg_id, a, b)``: state S starts all ones, for every
# character c of b: u = S & M[c]; S = ((S + u) | (S - u)) & fm.
LCS_SQL = """
lcs_in AS (
  SELECT seg_id, a, b, length(a) AS m, length(b) AS n,
         CASE WHEN length(a) = 0 THEN 0::BIGINT ELSE ((1::BIGINT << length(a)) - 1) END AS fm
  FROM pp),
lcs_run(seg_id, a, b, m, n, fm, j, s) AS (
  SELECT seg_id, a, b, m, n, fm, 0, fm FROM lcs_in
  UNION ALL
  SELECT seg_id, a, b, m, n, fm, j + 1,
         ((s + (s & mk)) | (s - (s & mk))) & fm
  FROM (SELECT *, list_sum(list_transform(generate_series(1, greatest(m, 1)),
                 lambda i: CASE WHEN i <= m AND a[i] = b[j + 1] THEN (1::BIGINT << (i - 1)) ELSE 0::BIGINT END))::BIGINT AS mk
        FROM lcs_run WHERE j < n)),
lcs AS (
  SELECT seg_id, a, b, m, n, m - bit_count(s) AS lcs
  FROM (SELECT *, row_number() OVER (PARTITION BY seg_id ORDER BY j DESC) AS rk FROM lcs_run) WHERE rk = 1)
"""


def _ratio_sql(view: str) -> list[tuple[str, str]]:
    return [("pp", f"SELECT seg_id, lower(hyp) AS a, lower(ref) AS b FROM {view}")]


@register("indel_ratio", sql=f"""
  , {LCS_SQL.strip()}
  SELECT p.seg_id, p.hyp, p.ref,
         round(CASE WHEN l.m + l.n = 0 THEN 1.0 ELSE 2.0 * l.lcs / (l.m + l.n) END, 6) AS ratio
  FROM pairs_parts p JOIN lcs l ON l.seg_id = p.seg_id""", ctes=_ratio_sql("pairs_parts"), recursive=True)
def q_indel_ratio(spark, d):
    p = fx.pairs_parts(spark, d)
    return p.select("seg_id", "hyp", "ref",
                    F.round(indel_ratio(F.lower("hyp"), F.lower("ref")), 6).alias("ratio"))


@register("similarity_band", sql=f"""
  , {LCS_SQL.strip()}
  SELECT seg_id, hyp, ref, ratio FROM (
    SELECT p.seg_id, p.hyp, p.ref,
           round(CASE WHEN l.m + l.n = 0 THEN 1.0 ELSE 2.0 * l.lcs / (l.m + l.n) END, 6) AS ratio,
           CASE WHEN l.m + l.n = 0 THEN 1.0 ELSE 2.0 * l.lcs / (l.m + l.n) END AS r
    FROM pairs_parts p JOIN lcs l ON l.seg_id = p.seg_id)
  WHERE r BETWEEN 0.25 AND 0.99""", ctes=_ratio_sql("pairs_parts"), recursive=True)
def q_similarity_band(spark, d):
    p = fx.pairs_parts(spark, d)
    out = filter_similarity(p, 0.25, 0.99, src="hyp", tgt="ref", ratio_col="ratio")
    return out.select("seg_id", "hyp", "ref", F.round("ratio", 6).alias("ratio"))


@register("similarity_band_docs")
def q_similarity_band_docs(spark, d):
    """F2 on whole lines (beyond what the SQL bit sets hold; tested by brute force)."""
    p = fx.pairs_docs(spark, d).select("doc_id", "line_no", "source", "target")
    return filter_similarity(p, 0.25, 0.99).withColumn("ratio", F.round("ratio", 6))


# ---------------------------------------------------------------------------
# Line table with a skew-safe position inside each corpus
# ---------------------------------------------------------------------------
@register("line_index", sql="""
  SELECT corpus, doc_id, line_no, text,
         CAST(row_number() OVER (PARTITION BY corpus ORDER BY doc_id, line_no) AS BIGINT) AS pos
  FROM lines""")
def q_line_index(spark, d):
    return fx.positioned(spark, d).select("corpus", "doc_id", "line_no", "text", "pos")


@register("zip_truncate", sql="""
  SELECT corpus, lang, doc_id, line_no, source, target FROM pairs_docs""")
def q_zip_truncate(spark, d):
    return fx.pairs_docs(spark, d).select("corpus", "lang", "doc_id", "line_no", "source", "target")


NP_EN = fx.sql_regex_chain("text", normalize_punct_rules("en"))


@register("zip_strict", sql=f"""
  SELECT s.doc_id, s.line_no, s.text AS source, {NP_EN.replace('text', 't.text')} AS target
  FROM lines s JOIN lines t ON s.doc_id = t.doc_id AND s.line_no = t.line_no""")
def q_zip_strict(spark, d):
    ln = fx.lines(spark, d)
    src = ln.select("doc_id", "line_no", F.col("text").alias("source"))
    tgt = ln.select("doc_id", "line_no", normalize_punct("text", "en").alias("target"))
    return zip_strict(src, tgt, ["doc_id"])


@register("paste3", sql="""
  SELECT doc_id, line_no, coalesce(source, '') AS source, coalesce(target, '') AS target,
         coalesce(label, '') AS label
  FROM (SELECT doc_id, line_no, text AS source FROM lines) s
  FULL OUTER JOIN (SELECT doc_id - 1 AS doc_id, line_no, text AS target FROM lines) t USING (doc_id, line_no)
  FULL OUTER JOIN (SELECT doc_id, line_no, label FROM line_labels) l USING (doc_id, line_no)""")
def q_paste3(spark, d):
    ln = fx.lines(spark, d)
    s = ln.select("doc_id", "line_no", F.col("text").alias("source"))
    t = ln.select((F.col("doc_id") - 1).alias("doc_id"), "line_no", F.col("text").alias("target"))
    lab = fx.line_labels(spark, d)
    return paste([s, t, lab], ["source", "target", "label"], ["doc_id"])


def _squeeze_sql(x):
    return f"regexp_replace(regexp_replace({x}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), '^ | $', '', 'g')"


@register("clean_pairs", sql=f"""
  SELECT corpus, doc_id, line_no, source, target FROM (
    SELECT corpus, doc_id, line_no, {_squeeze_sql('source')} AS source, {_squeeze_sql('target')} AS target
    FROM pairs_docs)
  WHERE source <> '' AND target <> ''
    AND len(string_split(source, ' ')) BETWEEN 1 AND 60 AND len(string_split(target, ' ')) BETWEEN 1 AND 60
    AND len(string_split(source, ' ')) <= 9 * len(string_split(target, ' '))
    AND len(string_split(target, ' ')) <= 9 * len(string_split(source, ' '))""")
def q_clean_pairs(spark, d):
    p = fx.pairs_docs(spark, d).select("corpus", "doc_id", "line_no", "source", "target")
    return clean_pairs(p, 1, 60, 9.0)


@register("drop_empty", sql="""
  SELECT doc_id, line_no, source, target FROM (
    SELECT doc_id, line_no, coalesce(source, '') AS source, coalesce(target, '') AS target
    FROM (SELECT doc_id, line_no, text AS source FROM lines) s
    FULL OUTER JOIN (SELECT doc_id - 1 AS doc_id, line_no, text AS target FROM lines) t USING (doc_id, line_no))
  WHERE source <> '' AND target <> ''""")
def q_drop_empty(spark, d):
    ln = fx.lines(spark, d)
    s = ln.select("doc_id", "line_no", F.col("text").alias("source"))
    t = ln.select((F.col("doc_id") - 1).alias("doc_id"), "line_no", F.col("text").alias("target"))
    return drop_empty(paste([s, t], ["source", "target"], ["doc_id"]))


@register("language_filter", sql="""
  SELECT p.corpus, p.doc_id, p.line_no, p.source, p.target FROM pairs_docs p
  WHERE EXISTS (SELECT 1 FROM line_labels l WHERE l.doc_id = p.doc_id AND l.line_no = p.line_no
                AND l.label = '__label__es')""")
def q_language_filter(spark, d):
    p = fx.pairs_docs(spark, d).select("corpus", "doc_id", "line_no", "source", "target")
    return filter_language(p, fx.line_labels(spark, d), "__label__es")


@register("max_token_filter", sql=f"""
  SELECT doc_id, line_no, n_src, n_tgt FROM (
    SELECT doc_id, line_no, CAST(len({fx.sql_words('source')}) AS BIGINT) AS n_src,
           CAST(len({fx.sql_words('target')}) AS BIGINT) AS n_tgt FROM pairs_docs)
  WHERE n_src <= 100 AND n_tgt <= 100""")
def q_max_token_filter(spark, d):
    p = fx.pairs_docs(spark, d)
    p = p.select("doc_id", "line_no", encode_words("source").alias("src_ids"),
                 encode_words("target").alias("tgt_ids"))
    out = filter_max_tokens(p, 100)
    return out.select("doc_id", "line_no", F.size("src_ids").cast("long").alias("n_src"),
                      F.size("tgt_ids").cast("long").alias("n_tgt"))


@register("token_stats", sql="""
  SELECT corpus, count(*) AS n_lines, CAST(max(len(ids)) AS BIGINT) AS max_tokens,
         CAST(sum(len(ids)) AS BIGINT) AS total_tokens
  FROM tokens GROUP BY corpus""")
def q_token_stats(spark, d):
    from ..operators.metrics import token_stats
    return token_stats(fx.tokens(spark, d), ["corpus"])


@register("subword_max_tokens")
def q_subword_max_tokens(spark, d):
    """F4 with subword pieces: pairs with at most 100 tokens a side."""
    p, encode = fx.pairs_docs(spark, d), fx.subwords(spark)
    out = filter_max_tokens(p.select("doc_id", "line_no", encode("source").alias("src_ids"), encode("target").alias("tgt_ids")), 100)
    return out.select("doc_id", "line_no", F.size("src_ids").cast("long").alias("n_src"), F.size("tgt_ids").cast("long").alias("n_tgt"))


@register("subword_stats")
def q_subword_stats(spark, d):
    """P13 and A4 with subword pieces."""
    from ..operators.metrics import token_stats
    return token_stats(fx.lines(spark, d).select("corpus", fx.subwords(spark)("text").alias("ids")), ["corpus"])
