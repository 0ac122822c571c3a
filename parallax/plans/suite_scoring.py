"""Queries: corpus scoring and significance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.similarity import char_edit_distance
from ..operators import metrics as M
from . import fixtures as fx
from .registry import register

WS_RE = fx.WS_RE_SQL


def sql_tok13a(x: str) -> str:
    s = x
    for a, b in M.TOK13A_REPLACE:
        s = f"replace({s}, {fx.sql_str(a)}, {fx.sql_str(b)})"
    s = fx.sql_regex_chain(f"(' ' || {s} || ' ')", M.TOK13A_REGEX)
    return fx.sql_words(s)


def sql_wer_words(x: str) -> str:
    s = f"trim(regexp_replace({x}, {WS_RE} || '{{2,}}', ' ', 'g'), {fx.WS_SQL})"
    return f"list_filter(string_split({s}, ' '), lambda w: w <> '')"


def bleu_ctes(base: str, keys: list[str], p: str = "b") -> list[tuple[str, str]]:
    """CTEs computing summed BLEU statistics per key from a view with
    columns keys..., seg, hyp, ref.  Result view: {p}_stats."""
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    return [
        (f"{p}_tk", f"SELECT {kc}seg, {sql_tok13a('hyp')} AS h, {sql_tok13a('ref')} AS r FROM {base}"),
        (f"{p}_ns", "SELECT unnest([1, 2, 3, 4]) AS n"),
        (f"{p}_hg", f"""SELECT {kc}seg, n, array_to_string(h[i:i + n - 1], ' ') AS g FROM (
             SELECT {kc}seg, n, h, unnest(generate_series(1, len(h) - n + 1)) AS i FROM {p}_tk, {p}_ns)"""),
        (f"{p}_rg", f"""SELECT {kc}seg, n, array_to_string(r[i:i + n - 1], ' ') AS g FROM (
             SELECT {kc}seg, n, r, unnest(generate_series(1, len(r) - n + 1)) AS i FROM {p}_tk, {p}_ns)"""),
        (f"{p}_m", f"""SELECT {kc}n, sum(least(hc.c, rc.c)) AS matches FROM
             (SELECT {kc}seg, n, g, count(*) AS c FROM {p}_hg GROUP BY ALL) hc
             JOIN (SELECT {kc}seg, n, g, count(*) AS c FROM {p}_rg GROUP BY ALL) rc USING ({kc}seg, n, g)
             GROUP BY ALL"""),
        (f"{p}_t", f"""SELECT {kc}n, sum(greatest(len(h) - n + 1, 0)) AS total FROM {p}_tk, {p}_ns GROUP BY ALL"""),
        (f"{p}_stats", f"""SELECT {kc}
             CAST(max(sys_len) AS BIGINT) AS sys_len, CAST(max(ref_len) AS BIGINT) AS ref_len,
             {", ".join(f"CAST(max(CASE WHEN n = {n} THEN total END) AS DOUBLE) AS t{n}, CAST(coalesce(max(CASE WHEN n = {n} THEN matches END), 0) AS DOUBLE) AS m{n}" for n in range(1, 5))}
           FROM (SELECT t.*, m.matches FROM {p}_t t LEFT JOIN {p}_m m USING ({kc}n)) x
           JOIN (SELECT {kc}sum(len(h)) AS sys_len, sum(len(r)) AS ref_len FROM {p}_tk {"GROUP BY " + k if keys else ""}) l
             {"USING (" + k + ")" if keys else "ON TRUE"}
           {"GROUP BY " + ", ".join("x." + c for c in keys) if keys else ""}"""),
    ]


def bleu_expr(p: str = "") -> str:
    return f"round({bleu_raw(p)}, 6)"


def bleu_raw(p: str = "") -> str:
    parts = []
    for n in range(1, 5):
        z = " + ".join(f"(CASE WHEN {p}m{i} = 0 THEN 1 ELSE 0 END)" for i in range(1, n + 1))
        prec = (f"(CASE WHEN {p}t{n} = 0 THEN 0.0 WHEN {p}m{n} = 0 THEN 100.0 / (pow(2.0, {z}) * {p}t{n}) "
                f"ELSE 100.0 * {p}m{n} / {p}t{n} END)")
        parts.append(f"(CASE WHEN {prec} = 0 THEN -9999999999.0 ELSE ln({prec}) END)")
    bp = (f"(CASE WHEN {p}sys_len >= {p}ref_len THEN 1.0 WHEN {p}sys_len = 0 THEN 0.0 "
          f"ELSE exp(1.0 - {p}ref_len / {p}sys_len) END)")
    return (f"(CASE WHEN {p}m1 + {p}m2 + {p}m3 + {p}m4 = 0 THEN 0.0 "
            f"ELSE {bp} * exp(({' + '.join(parts)}) / 4.0) END)")


def chrf_ctes(base: str, keys: list[str], p: str = "c") -> list[tuple[str, str]]:
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    strip = lambda x: f"regexp_replace({x}, {WS_RE}, '', 'g')"
    return [
        (f"{p}_ch", f"SELECT {kc}seg, {strip('hyp')} AS h, {strip('ref')} AS r FROM {base}"),
        (f"{p}_ns", "SELECT unnest([1, 2, 3, 4, 5, 6]) AS n"),
        (f"{p}_hg", f"""SELECT {kc}seg, n, substring(h, i, n) AS g FROM (
             SELECT {kc}seg, n, h, unnest(generate_series(1, length(h) - n + 1)) AS i FROM {p}_ch, {p}_ns)"""),
        (f"{p}_rg", f"""SELECT {kc}seg, n, substring(r, i, n) AS g FROM (
             SELECT {kc}seg, n, r, unnest(generate_series(1, length(r) - n + 1)) AS i FROM {p}_ch, {p}_ns)"""),
        (f"{p}_m", f"""SELECT {kc}n, sum(least(hc.c, rc.c)) AS matches FROM
             (SELECT {kc}seg, n, g, count(*) AS c FROM {p}_hg GROUP BY ALL) hc
             JOIN (SELECT {kc}seg, n, g, count(*) AS c FROM {p}_rg GROUP BY ALL) rc USING ({kc}seg, n, g)
             GROUP BY ALL"""),
        (f"{p}_t", f"""SELECT {kc}n, sum(greatest(length(h) - n + 1, 0)) AS th,
             sum(greatest(length(r) - n + 1, 0)) AS tr FROM {p}_ch, {p}_ns GROUP BY ALL"""),
        (f"{p}_o", f"""SELECT t.*, CAST(coalesce(m.matches, 0) AS DOUBLE) AS mm,
             CASE WHEN th > 0 AND tr > 0 THEN 1 ELSE 0 END AS ok FROM {p}_t t LEFT JOIN {p}_m m USING ({kc}n)"""),
        (f"{p}_pr", f"""SELECT {kc}
             CASE WHEN sum(ok) = 0 THEN 0.0 ELSE sum(CASE WHEN ok = 1 THEN mm / th ELSE 0.0 END) / sum(ok) END AS pp,
             CASE WHEN sum(ok) = 0 THEN 0.0 ELSE sum(CASE WHEN ok = 1 THEN mm / tr ELSE 0.0 END) / sum(ok) END AS rr
           FROM {p}_o {"GROUP BY " + k if keys else ""}"""),
    ]


CHRF_EXPR = "round(CASE WHEN pp + rr > 0 THEN 100.0 * 5.0 * pp * rr / (4.0 * pp + rr) ELSE 0.0 END, 6)"

CONV_BASE = ("seg_base", "SELECT conv_id * 100000 + turn AS seg, source AS hyp, target AS ref FROM pairs_conv")
DOCS_BASE = ("task_base", "SELECT lang AS task, doc_id * 100000 + line_no AS seg, source AS hyp, target AS ref "
                          "FROM pairs_docs")


def _conv_seg(spark, d):
    return fx.pairs_conv(spark, d).select(F.col("source").alias("hyp"), F.col("target").alias("ref"))


@register("accuracy", sql="""
  SELECT CAST(sum(CASE WHEN hyp = ref THEN 1 ELSE 0 END) AS BIGINT) AS n_correct, count(*) AS n,
         round(sum(CASE WHEN hyp = ref THEN 1 ELSE 0 END) / count(*), 6) AS accuracy
  FROM pairs_parts""")
def q_accuracy(spark, d):
    return M.accuracy(fx.pairs_parts(spark, d))


@register("mean_edit_distance", sql="""
  SELECT CAST(sum(levenshtein(hyp, ref)) AS BIGINT) AS total_distance, count(*) AS n,
         round(sum(levenshtein(hyp, ref)) / count(*), 6) AS mean_distance
  FROM pairs_parts""")
def q_mean_edit_distance(spark, d):
    return M.mean_edit_distance(fx.pairs_parts(spark, d))


@register("wer", sql=f"""
  SELECT CAST(sum(levenshtein(hx, rx)) AS BIGINT) AS edits, CAST(sum(len(rw)) AS BIGINT) AS ref_words,
         round(sum(levenshtein(hx, rx)) / sum(len(rw)), 6) AS wer
  FROM (SELECT rw,
          array_to_string(list_transform(hw, lambda w: chr(64 + list_position(v, w))), '') AS hx,
          array_to_string(list_transform(rw, lambda w: chr(64 + list_position(v, w))), '') AS rx
        FROM (SELECT hw, rw, list_distinct(list_concat(hw, rw)) AS v
              FROM (SELECT {sql_wer_words('hyp')} AS hw, {sql_wer_words('ref')} AS rw FROM pairs_parts)))""")
def q_wer(spark, d):
    return M.wer(fx.pairs_parts(spark, d))


@register("bleu", sql=f"SELECT sys_len, ref_len, {bleu_expr()} AS bleu FROM b_stats",
          ctes=[CONV_BASE] + bleu_ctes("seg_base", []))
def q_bleu(spark, d):
    return M.bleu(_conv_seg(spark, d))


@register("chrf", sql=f"SELECT {CHRF_EXPR} AS chrf FROM c_pr",
          ctes=[CONV_BASE] + chrf_ctes("seg_base", []))
def q_chrf(spark, d):
    return M.chrf(_conv_seg(spark, d))


@register("bleu_native", sql=f"SELECT sys_len, ref_len, {bleu_expr()} AS bleu FROM b_stats",
          ctes=[CONV_BASE] + bleu_ctes("seg_base", []))
def q_bleu_native(spark, d):
    """A8 with built-in expressions only."""
    return M.bleu(_conv_seg(spark, d), method="native")


@register("chrf_native", sql=f"SELECT {CHRF_EXPR} AS chrf FROM c_pr",
          ctes=[CONV_BASE] + chrf_ctes("seg_base", []))
def q_chrf_native(spark, d):
    """A9 with built-in expressions only."""
    return M.chrf(_conv_seg(spark, d), method="native")


@register("metrics_by_task", sql=f"""
  SELECT b.task, b.sys_len, b.ref_len, {bleu_expr('b.')} AS bleu, {CHRF_EXPR} AS chrf
  FROM b_stats b JOIN c_pr c USING (task)""",
          ctes=[DOCS_BASE] + bleu_ctes("task_base", ["task"]) + chrf_ctes("task_base", ["task"]))
def q_metrics_by_task(spark, d):
    p = fx.pairs_docs(spark, d).select(F.col("lang").alias("task"), F.col("source").alias("hyp"),
                                       F.col("target").alias("ref"))
    return M.metrics_by_task(p, keys=["task"])


@register("perplexity", sql="""
  SELECT task, count(*) AS n, round(exp(avg(loss)), 6) AS perplexity FROM vlog GROUP BY task""")
def q_perplexity(spark, d):
    out = M.perplexity(fx.vlog(spark, d), keys=["task"])
    return out.withColumn("perplexity", F.round("perplexity", 6))


@register("token_accuracy", sql="""
  SELECT corpus, CAST(sum(greatest(len(ids) - 1, 0)) AS BIGINT) AS n_positions,
         CAST(sum(len(list_filter(generate_series(1, greatest(len(ids) - 1, 0)), lambda i: ids[i] = ids[i + 1])))
              AS BIGINT) AS n_correct,
         round(sum(len(list_filter(generate_series(1, greatest(len(ids) - 1, 0)), lambda i: ids[i] = ids[i + 1])))
               / sum(greatest(len(ids) - 1, 0)), 6) AS accuracy
  FROM tokens GROUP BY corpus""")
def q_token_accuracy(spark, d):
    t = fx.tokens(spark, d)
    return M.token_accuracy(t, "ids", "ids", keys=["corpus"])


@register("paired_randomization", sql="""
  , st AS (SELECT seg_id, CAST(levenshtein(hyp_a, ref) AS DOUBLE) AS a,
                  CAST(levenshtein(hyp_b, ref) AS DOUBLE) AS b FROM two_systems),
  cw AS (SELECT a, b, blk, ('0x' || substr(md5('12345-' || seg_id || '-' || blk), 1, 15))::BIGINT AS w
         FROM st, range(0, 167) r(blk)),
  pt AS (SELECT blk * 60 + bit + 1 AS trial,
                abs(sum(CASE WHEN (w >> bit) & 1 = 1 THEN b - a ELSE a - b END)) AS d
         FROM cw, range(0, 60) q(bit) WHERE blk * 60 + bit + 1 <= 10000 GROUP BY blk * 60 + bit + 1),
  ob AS (SELECT abs(sum(a - b)) AS o FROM st)
  SELECT CAST(10000 AS BIGINT) AS trials, max(ob.o) AS observed,
         CAST(sum(CASE WHEN p.d >= ob.o - 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS n_extreme,
         round((sum(CASE WHEN p.d >= ob.o - 1e-9 THEN 1 ELSE 0 END) + 1) / 10001.0, 6) AS p_value
  FROM pt p, ob""")
def q_paired_randomization(spark, d):
    s = fx.two_systems(spark, d)
    st = s.select("seg_id", char_edit_distance("hyp_a", "ref").alias("a"),
                  char_edit_distance("hyp_b", "ref").alias("b"))
    return M.paired_randomization(st, "a", "b", "seg_id", trials=10000, seed=12345)


@register("scores_unequal", sql="""
  SELECT n_correct, n, round(n_correct / n, 6) AS accuracy, total_distance, round(total_distance / n, 6) AS mean_distance
  FROM (SELECT CAST(sum(CASE WHEN h.p_type = r.p_type THEN 1 ELSE 0 END) AS BIGINT) AS n_correct, count(*) AS n,
               CAST(sum(coalesce(levenshtein(h.p_type, r.p_type), 0)) AS BIGINT) AS total_distance
        FROM part h LEFT JOIN part r ON h.p_partkey = 2 * r.p_partkey)""")
def q_scores_unequal(spark, d):
    """A1 and A3 where some predictions have no reference: part 2k against part k."""
    hyp = fx.table(spark, d, "part").select(F.col("p_partkey").alias("line_no"), F.col("p_type").alias("hyp"))
    ref = hyp.select((F.col("line_no") * 2).alias("line_no"), F.col("hyp").alias("ref"))
    seg = M.pair_predictions(hyp, ref)
    both = M.mean_edit_distance(seg).withColumn("acc", M.accuracy(seg).select(F.struct("n_correct", "accuracy")).scalar())
    return both.select("acc.n_correct", "n", "acc.accuracy", "total_distance", "mean_distance")


SIG_BASE = ("sig_base", "SELECT 'A' AS system, seg_id AS sid, seg_id AS seg, hyp_a AS hyp, ref FROM two_systems "
                        "UNION ALL SELECT 'B' AS system, seg_id AS sid, seg_id AS seg, hyp_b AS hyp, ref FROM two_systems")


def _significance_sql(stats: str, names: list[str], score, trials: int = 10_000, seed: int = 12345) -> str:
    """A15 over a relation ``stats`` with (system, sid, names...)."""
    blocks = -(-trials // 60)
    cols = lambda f: ", ".join(f(n) for n in names)
    side = lambda s, sign: ", ".join(f"max(t.{s}_{n}) {sign} sum(p.s_{n}) AS {n}" for n in names)
    return f"""
  , sd AS (SELECT a.sid, {cols(lambda n: f"a.{n} AS a_{n}, b.{n} AS b_{n}, b.{n} - a.{n} AS d_{n}")}
           FROM (SELECT * FROM ({stats}) WHERE system = 'A') a JOIN (SELECT * FROM ({stats}) WHERE system = 'B') b USING (sid)),
  tot AS (SELECT {cols(lambda n: f"sum(a_{n}) AS a_{n}, sum(b_{n}) AS b_{n}")} FROM sd),
  cw AS (SELECT sd.*, blk, ('0x' || substr(md5('{seed}-' || sid || '-' || blk), 1, 15))::BIGINT AS w FROM sd, range(0, {blocks}) r(blk)),
  sw AS (SELECT blk * 60 + bit + 1 AS trial, {cols(lambda n: f"sum(CASE WHEN (w >> bit) & 1 = 1 THEN d_{n} ELSE 0 END) AS s_{n}")}
         FROM cw, range(0, 60) q(bit) WHERE blk * 60 + bit + 1 <= {trials} GROUP BY ALL),
  ta AS (SELECT trial, {side('a', '+')} FROM sw p, tot t GROUP BY trial),
  tb AS (SELECT trial, {side('b', '-')} FROM sw p, tot t GROUP BY trial),
  oa AS (SELECT {cols(lambda n: f"a_{n} AS {n}")} FROM tot), ob AS (SELECT {cols(lambda n: f"b_{n} AS {n}")} FROM tot),
  o AS (SELECT abs((SELECT {score()} FROM oa) - (SELECT {score()} FROM ob)) AS observed),
  ds AS (SELECT abs(x.v - y.v) AS d FROM (SELECT trial, {score()} AS v FROM ta) x JOIN (SELECT trial, {score()} AS v FROM tb) y USING (trial))
  SELECT CAST({trials} AS BIGINT) AS trials, round(max(observed), 6) AS observed,
         CAST(sum(CASE WHEN d >= observed - 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS n_extreme,
         round((sum(CASE WHEN d >= observed - 1e-9 THEN 1 ELSE 0 END) + 1) / ({trials} + 1), 6) AS p_value FROM ds, o"""


def _chrf_raw() -> str:
    ok = lambda n: f"(h{n} > 0 AND r{n} > 0)"
    eff = "(" + " + ".join(f"CASE WHEN {ok(n)} THEN 1 ELSE 0 END" for n in range(1, 7)) + ")"
    mean = lambda x: "(" + " + ".join(f"CASE WHEN {ok(n)} THEN m{n} / {x}{n} ELSE 0.0 END" for n in range(1, 7)) + f") / {eff}"
    p, r = mean("h"), mean("r")
    return f"(CASE WHEN {eff} = 0 OR ({p}) + ({r}) = 0 THEN 0.0 ELSE 100.0 * 5.0 * ({p}) * ({r}) / (4.0 * ({p}) + ({r})) END)"


BLEU_NAMES = ["sys_len", "ref_len"] + [f"{x}{n}" for n in range(1, 5) for x in "tm"]
CHRF_NAMES = [f"{x}{n}" for n in range(1, 7) for x in "hrm"]
CHRF_ROWS = "SELECT system, sid, " + ", ".join(
    f"CAST(max(CASE WHEN n = {n} THEN {c} END) AS DOUBLE) AS {x}{n}" for n in range(1, 7) for x, c in (("h", "th"), ("r", "tr"), ("m", "mm"))
) + " FROM c_o GROUP BY system, sid"


@register("significance_bleu", sql=_significance_sql("SELECT * FROM b_stats", BLEU_NAMES, bleu_raw),
          ctes=[SIG_BASE] + bleu_ctes("sig_base", ["system", "sid"]))
def q_significance_bleu(spark, d):
    """A15 on BLEU."""
    return M.significance_bleu(fx.two_systems(spark, d))


@register("significance_chrf", sql=_significance_sql(CHRF_ROWS, CHRF_NAMES, _chrf_raw),
          ctes=[SIG_BASE] + chrf_ctes("sig_base", ["system", "sid"]))
def q_significance_chrf(spark, d):
    """A15 on chrF."""
    return M.significance_chrf(fx.two_systems(spark, d))


@register("significance_ter")
def q_significance_ter(spark, d):
    """A15 on TER (no SQL form of the shift search; tested by brute force)."""
    return M.significance_ter(fx.two_systems(spark, d))


@register("significance_ter_lines")
def q_significance_ter_lines(spark, d):
    """A15 on TER over whole lines: the lines of the next two documents against those of each document."""
    return M.significance_ter(fx.line_systems(spark, d))
