"""Queries: text sources and sinks, streaming, the bigram LM
(S1-S9, K1-K6, X5, U5).

The I/O queries write data that Spark derives from the test tables into
the shared checkpoint folder and read it back through the readers, so the
numbering, alignment and streaming code paths are what the oracle checks.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..functions.text import squeeze_spaces
from ..operators import corpus as C
from ..operators import inference as I
from ..operators import kneser_ney as KN
from ..operators import nbest as NB
from ..session import materialize, scratch_path
from ..sources import sinks as K
from ..sources import tables as T
from ..sources import text as S
from ..streaming.lines import read_lines_stream, run_available
from . import fixtures as fx
from .registry import register
from .suite_cleaning import _squeeze_sql
from .suite_corpus import MANIFEST, MANIFEST_SQL
from .workflows import lm_dataset


@register("read_lines_roundtrip", sql="""
  SELECT corpus, row_number() OVER (PARTITION BY corpus ORDER BY doc_id, line_no) AS line_no, text FROM lines""")
def q_read_lines_roundtrip(spark, d):
    root = scratch_path(spark, "lines")
    K.write_lines(fx.lines(spark, d), root, "text", ["doc_id", "line_no"], partition_by=["corpus"])
    return S.read_partitioned_lines(spark, root, "corpus")


@register("read_parallel_roundtrip", sql="""
  SELECT row_number() OVER (ORDER BY doc_id, line_no) AS line_no, source, target FROM pairs_docs""")
def q_read_parallel_roundtrip(spark, d):
    src, tgt = scratch_path(spark, "par-src"), scratch_path(spark, "par-tgt")
    K.write_parallel(fx.pairs_docs(spark, d), src, tgt, ["doc_id", "line_no"])
    return S.read_parallel(spark, src, tgt, "strict").select("line_no", "source", "target")


@register("stream_clean", sql=f"""
  SELECT text FROM (SELECT {_squeeze_sql('text')} AS text FROM lines)
  WHERE text <> '' AND len(string_split(text, ' ')) BETWEEN 1 AND 60""")
def q_stream_clean(spark, d):
    root = scratch_path(spark, "stream-in")
    K.write_lines(fx.lines(spark, d), root, "text", ["corpus", "doc_id", "line_no"])

    def clean(df):
        s = df.select(squeeze_spaces("text").alias("text"))
        n = F.size(F.split("text", " ", -1))
        return s.where((F.col("text") != "") & n.between(1, 60))

    return run_available(spark, read_lines_stream(spark, root, max_files_per_trigger=8), clean)


LM_ORDER = "row_number() OVER (ORDER BY corpus, doc_id, line_no)"


def _lm_text(spark, d):
    root = scratch_path(spark, "lm") + ".txt"
    K.write_lines(fx.lines(spark, d), root, "text", ["corpus", "doc_id", "line_no"])
    return root


@register("lm_dataset", sql=f"""
  , t AS (SELECT ids, {LM_ORDER} AS pos, CAST(round_even(count(*) OVER () * 5 / 100.0, 0) AS BIGINT) AS cut FROM tokens),
  s AS (SELECT ids, CASE WHEN pos <= cut THEN 'validation' ELSE 'train' END AS split,
               CASE WHEN pos <= cut THEN pos ELSE pos - cut END AS p FROM t),
  g AS (SELECT split, CAST((p - 1) // 1000 AS BIGINT) AS group_id, flatten(list(ids ORDER BY p)) AS a FROM s GROUP BY ALL),
  b AS (SELECT split, group_id, a, unnest(generate_series(0, len(a) // 128 - 1)) AS block_idx FROM g)
  SELECT split, group_id, CAST(block_idx AS BIGINT) AS block_idx,
         array_to_string(a[block_idx * 128 + 1 : (block_idx + 1) * 128], ' ') AS input_ids FROM b""")
def q_lm_dataset(spark, d):
    """X5, both splits."""
    parts = lm_dataset(spark, _lm_text(spark, d), tk.word_length_ids, block=128, validation_pct=5.0)
    return C.concat_corpora(parts, "split").select(
        "split", "group_id", "block_idx", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"))


@register("lm_dataset_subword")
def q_lm_dataset_subword(spark, d):
    """X5 with subword pieces, both splits."""
    parts = lm_dataset(spark, _lm_text(spark, d), fx.subwords(spark), block=128, validation_pct=5.0)
    return C.concat_corpora(parts, "split").select(
        "split", "group_id", "block_idx", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"))


@register("lm_lines", sql=f"SELECT {LM_ORDER} AS line_no, text || chr(10) AS text FROM lines")
def q_lm_lines(spark, d):
    """S7 on a text file, line breaks kept."""
    return S.read_lm(spark, _lm_text(spark, d), keep_linebreaks=True)


def _ordered_lines(spark, d):
    keys = ["corpus", "doc_id", "line_no"]
    return fx.lines(spark, d).repartitionByRange(*keys).sortWithinPartitions(*keys)


@register("read_lm_json", sql=f"SELECT {LM_ORDER} AS line_no, text FROM lines")
def q_read_lm_json(spark, d):
    """S7 on JSON lines without a ``text`` field: the first field of the file."""
    path = scratch_path(spark, "lm") + ".json"
    _ordered_lines(spark, d).select(F.col("text").alias("sentence"), F.col("corpus").alias("author")).write.json(path)
    return S.read_lm(spark, path)


@register("read_lm_csv", sql=f"""
  SELECT {LM_ORDER} AS line_no, '"' || text || '", ' || corpus || chr(10) || 'x' AS text FROM lines""")
def q_read_lm_csv(spark, d):
    """S7 on CSV: quotes, commas and line breaks inside the first field."""
    path = scratch_path(spark, "lm") + ".csv"
    body = F.concat(F.lit('"'), "text", F.lit('", '), "corpus", F.lit("\nx")).alias("body")
    _ordered_lines(spark, d).select(body, "doc_id").write.option("header", True).option("escape", '"').csv(path)
    return S.read_lm(spark, path)


def _side_files(spark, d):
    """Each side of the pairs as text, a folder for every corpus."""
    pairs = materialize(fx.pairs_docs(spark, d).select("corpus", "doc_id", "line_no", "source", "target"), "pairs")
    root = scratch_path(spark, "sides")
    for side in ("source", "target"):
        K.write_lines(pairs, f"{root}/{side}", side, ["doc_id", "line_no"], partition_by=["corpus"])
    corpora = sorted(r[0] for r in pairs.select("corpus").distinct().collect())  # one row per corpus
    return root, corpora


@register("read_parallel_files", sql="""
  SELECT row_number() OVER (ORDER BY corpus DESC, doc_id, line_no) AS line_no, source, target FROM pairs_docs""")
def q_read_parallel_files(spark, d):
    """S2 on lists of files, in an order that is not that of their names."""
    root, corpora = _side_files(spark, d)
    at = lambda side: [f"{root}/{side}/corpus={c}" for c in reversed(corpora)]
    return S.read_parallel(spark, at("source"), at("target"), "strict")


POS_PAIRS = "row_number() OVER (PARTITION BY corpus ORDER BY doc_id, line_no)"


@register("append_stream", sql="SELECT corpus, text FROM lines WHERE text <> ''")
def q_append_stream(spark, d):
    """S9 into K3: a stream of lines appended by micro-batch; the second start finds nothing new."""
    root, out, ckpt = (scratch_path(spark, n) for n in ("append-in", "append-out", "append-ckpt"))
    K.write_lines(fx.lines(spark, d), root, "text", ["doc_id", "line_no"], partition_by=["corpus"])
    for _ in range(2):
        lines = spark.readStream.schema("value string, corpus string").option("maxFilesPerTrigger", 8).text(root)
        rows = lines.select("corpus", F.col("value").alias("text")).where("text <> ''")
        T.append_stream(spark, rows, out, "lines", ckpt)
    return T.read_runs(spark, out).select("corpus", "text")


@register("cache_encoded")
def q_cache_encoded(spark, d):
    """K5: subword ids kept by language pair and split; the call that returns finds them all kept."""
    rows = fx.lines(spark, d).select(F.lit("spa_Latn").alias("src_tag"), F.col("corpus").alias("tgt_tag"),
                                     F.when(F.col("line_no") == 1, "validation").otherwise("train").alias("split"), "doc_id", "line_no", "text")
    encode, path = fx.subwords(spark), scratch_path(spark, "encoded-cache")
    ids = lambda df: df.select("src_tag", "tgt_tag", "split", "doc_id", "line_no", encode("text").alias("ids"))
    for _ in range(2):
        kept = T.cache_encoded(rows, path, ids, {"pieces": "piece_bpe_32k"})
    return kept.select("src_tag", "tgt_tag", "split", "doc_id", "line_no", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@register("read_truncate", sql=f"""
  SELECT line_no, source, target FROM (
    SELECT row_number() OVER (ORDER BY doc_id, line_no) AS line_no, text AS source FROM lines) s
  JOIN (SELECT row_number() OVER (ORDER BY doc_id, line_no) AS line_no, target FROM pairs_docs) t USING (line_no)""")
def q_read_truncate(spark, d):
    """S3: a longer source file, its tail dropped."""
    src, tgt = scratch_path(spark, "long"), scratch_path(spark, "short")
    K.write_lines(fx.lines(spark, d, even=False), src, "text", ["doc_id", "line_no"])
    K.write_lines(fx.pairs_docs(spark, d), tgt, "target", ["doc_id", "line_no"])
    return S.read_parallel(spark, src, tgt, "truncate")


@register("read_corpora", sql=f"""
  SELECT 'name=' || corpus AS corpus, {POS_PAIRS} AS line_no, source, target FROM pairs_docs""")
def q_read_corpora(spark, d):
    """Every corpus as a pair of files named by corpus and language."""
    pairs = materialize(fx.pairs_docs(spark, d).select("corpus", "doc_id", "line_no", "source", "target"), "pairs")
    root = scratch_path(spark, "family")
    sides = C.concat_corpora({lang: pairs.select("corpus", "doc_id", "line_no", F.col(c).alias("text"))
                              for lang, c in (("es", "source"), ("arg", "target"))}, "lang")
    named = sides.withColumn("name", F.concat("corpus", F.lit(".es-arg."), "lang"))
    K.write_lines(named, root, "text", ["doc_id", "line_no"], partition_by=["name"])
    names = [f"name={r[0]}" for r in pairs.select("corpus").distinct().orderBy("corpus").collect()]  # one row per corpus
    return S.read_corpora(spark, root, names, "es-arg", "es", "arg")


@register("read_manifest", sql=f"""
  SELECT m.tag, CAST(m.ord AS INTEGER) AS ord, p.line_no, p.source, p.target
  FROM (SELECT corpus, {POS_PAIRS} AS line_no, source, target FROM pairs_docs) p JOIN ({MANIFEST_SQL}) m ON m.corpus = p.corpus""")
def q_read_manifest(spark, d):
    """All file pairs of a manifest, one of them listed twice."""
    root, _ = _side_files(spark, d)
    files = {tag: [{k: f"{k}/corpus={e[k]}" for k in ("source", "target")} for e in es] for tag, es in MANIFEST.items()}
    return S.read_manifest(spark, json.dumps(files), root)


@register("read_validation_manifest", sql=f"""
  SELECT corpus AS task, {POS_PAIRS} AS line_no, source, target FROM pairs_docs""")
def q_read_validation_manifest(spark, d):
    """One file pair for each task."""
    root, corpora = _side_files(spark, d)
    files = {c: {k: f"{k}/corpus={c}" for k in ("source", "target")} for c in corpora}
    return S.read_validation_manifest(spark, json.dumps(files), root)


@register("write_parallel_breaks", sql="""
  SELECT row_number() OVER (ORDER BY doc_id, line_no) AS line_no, trim(source || ' x') AS source, trim('y ' || target) AS target
  FROM pairs_docs""")
def q_write_parallel_breaks(spark, d):
    """K2 with line breaks inside the texts."""
    pairs = fx.pairs_docs(spark, d).select("doc_id", "line_no", F.concat("source", F.lit("\rx")).alias("source"),
                                           F.concat(F.lit("y\r\n"), "target").alias("target"))
    src, tgt = scratch_path(spark, "par-src"), scratch_path(spark, "par-tgt")
    K.write_parallel(pairs, src, tgt, ["doc_id", "line_no"])
    return S.read_parallel(spark, src, tgt, "strict")


@register("predictions_roundtrip", sql="""
  SELECT metric, lang AS task, row_number() OVER (PARTITION BY metric, lang ORDER BY doc_id, line_no) AS line_no, text
  FROM lines, (VALUES ('bleu'), ('chrf')) m(metric)""")
def q_predictions_roundtrip(spark, d):
    """K4: a file for every metric and task, read back."""
    rows = fx.lines(spark, d).select("lang", "doc_id", "line_no", "text")
    rows = C.concat_corpora({m: rows.withColumnRenamed("lang", "task") for m in ("bleu", "chrf")}, "metric")
    root = scratch_path(spark, "predictions")
    K.write_predictions(rows, root, "text", ["doc_id", "line_no"])
    return S.read_partitioned_lines(spark, root, ["metric", "task"])


@register("cache_tokenized", sql="""
  SELECT 'spa_Latn' AS src_tag, corpus AS tgt_tag, CASE WHEN line_no = 1 THEN 'validation' ELSE 'train' END AS split,
         doc_id, line_no, array_to_string(ids, ' ') AS ids FROM tokens""")
def q_cache_tokenized(spark, d):
    """K5: tokenised rows by language pair and split, read back."""
    t = fx.tokens(spark, d).select(F.lit("spa_Latn").alias("src_tag"), F.col("corpus").alias("tgt_tag"),
                                   F.when(F.col("line_no") == 1, "validation").otherwise("train").alias("split"),
                                   "doc_id", "line_no", "ids")
    back = K.cache_tokenized(t, scratch_path(spark, "tokenized"))
    return back.select("src_tag", "tgt_tag", "split", "doc_id", "line_no",
                       F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@register("run_metrics", sql="""
  SELECT round(avg(b), 6) AS eval_bleu, count(*) AS n_tasks,
         (SELECT count(*) FROM lines WHERE line_no > 1) AS train_samples, (SELECT count(*) FROM lines WHERE line_no = 1) AS validation_samples
  FROM (SELECT task, avg(bleu) AS b FROM vlog GROUP BY task)""")
def q_run_metrics(spark, d):
    """K6: the run's mean score over tasks and its sample counts (A16), as JSON, read back."""
    scores = fx.vlog(spark, d).groupBy("task").agg(F.avg("bleu").alias("bleu"))
    split = F.when(F.col("line_no") == 1, "validation").otherwise("train").alias("split")
    counts = C.sample_counts(fx.lines(spark, d).select(split), None, ["split"])
    path = scratch_path(spark, "metrics")
    K.write_metrics(K.run_metrics(scores, counts), path)
    return spark.read.json(path)


def _lm_sql():
    bos, eos = "'<s>'", "'</s>'"
    ws = fx.sql_words
    big = lambda tx: (f"list_transform(generate_series(1, len({ws(tx)}) + 1), lambda i: "
                      f"struct_pack(prev := ([{bos}] || {ws(tx)} || [{eos}])[i], "
                      f"cur := ([{bos}] || {ws(tx)} || [{eos}])[i + 1]))")
    return big


@register("score_ngram", sql=f"""
  , tb AS (SELECT b.prev, b.cur FROM (SELECT unnest({_lm_sql()('text')}) AS b FROM lines)),
  bc AS (SELECT prev, cur, count(*) AS c_bg FROM tb GROUP BY ALL),
  hc AS (SELECT prev, count(*) AS c_h FROM tb GROUP BY ALL),
  v AS (SELECT count(DISTINCT cur) + 1 AS vv FROM tb),
  hb AS (SELECT sent_id, hyp_idx, b.prev, b.cur FROM (SELECT sent_id, hyp_idx, unnest({_lm_sql()('text')}) AS b FROM nbest))
  SELECT hb.sent_id, hb.hyp_idx,
         round(-avg(ln((coalesce(c_bg, 0) + 0.1) / (coalesce(c_h, 0) + 0.1 * vv))), 6) AS loss
  FROM hb LEFT JOIN bc USING (prev, cur) LEFT JOIN hc USING (prev), v GROUP BY hb.sent_id, hb.hyp_idx""")
def q_score_ngram(spark, d):
    lm = I.train_bigram_lm(fx.lines(spark, d), "text")
    hyp = fx.nbest(spark, d).select("sent_id", "hyp_idx", "text")
    out = I.score_loss(hyp, lm, "text")
    return out.select("sent_id", "hyp_idx", F.round("loss", 6).alias("loss"))


@register("score_rerank", sql=f"""
  , tb AS (SELECT b.prev, b.cur FROM (SELECT unnest({_lm_sql()('text')}) AS b FROM lines)),
  bc AS (SELECT prev, cur, count(*) AS c_bg FROM tb GROUP BY ALL),
  hc AS (SELECT prev, count(*) AS c_h FROM tb GROUP BY ALL),
  v AS (SELECT count(DISTINCT cur) + 1 AS vv FROM tb),
  hy AS (SELECT doc_id, (line_no - 1) // 5 AS sent_id, CAST((line_no - 1) % 5 AS INTEGER) AS hyp_idx, text FROM lines),
  hb AS (SELECT doc_id, sent_id, hyp_idx, text, b.prev, b.cur FROM (SELECT doc_id, sent_id, hyp_idx, text, unnest({_lm_sql()('text')}) AS b FROM hy)),
  ls AS (SELECT doc_id, sent_id, hyp_idx, text, round(-avg(ln((coalesce(c_bg, 0) + 0.1) / (coalesce(c_h, 0) + 0.1 * vv))), 6) AS loss
         FROM hb LEFT JOIN bc USING (prev, cur) LEFT JOIN hc USING (prev), v GROUP BY ALL)
  SELECT doc_id, sent_id, hyp_idx, text, loss FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY loss DESC, hyp_idx) AS rk FROM ls) WHERE rk = 1""")
def q_score_rerank(spark, d):
    """U5 -> W3 on real lines: five lines of a document in a row are the hypotheses."""
    ln = fx.lines(spark, d)
    hyp = ln.select("doc_id", F.floor((F.col("line_no") - 1) / 5).alias("sent_id"),
                    ((F.col("line_no") - 1) % 5).cast("int").alias("hyp_idx"), "text")
    lm = I.train_bigram_lm(ln, "text")
    scored = I.score_loss(hyp, lm, "text", ("doc_id", "sent_id", "hyp_idx")).withColumn("loss", F.round("loss", 6))
    return NB.rerank(scored, "loss", "max", ("doc_id", "sent_id")).select("doc_id", "sent_id", "hyp_idx", "text", "loss")


def _kn_sql(hyps: str, keys: str) -> str:
    """Losses of ``hyps`` under a Kneser-Ney model of order 3 of the table lines."""
    ws = fx.sql_words
    disc = lambda t: f"(SELECT CASE WHEN count(*) FILTER (c = 1) = 0 THEN 0.5 ELSE count(*) FILTER (c = 1) / (count(*) FILTER (c = 1) + 2.0 * count(*) FILTER (c = 2)) END FROM {t})"
    return f"""
  , st AS (SELECT ['<s>'] || {ws('text')} || ['</s>'] AS w FROM lines),
  k3 AS (SELECT w[i - 2] AS a, w[i - 1] AS b, w[i] AS x, count(*) AS c FROM (SELECT w, unnest(generate_series(3, len(w))) AS i FROM st) GROUP BY ALL),
  k2 AS (SELECT b, x, count(*) AS c FROM k3 GROUP BY ALL UNION ALL SELECT w[1], w[2], count(*) FROM st GROUP BY ALL),
  k1 AS (SELECT x, count(*) AS c FROM k2 GROUP BY ALL),
  q1 AS (SELECT {disc('k1')} * count(*) / sum(c) / (count(*) + 1) AS unk, {disc('k1')} AS d, sum(c) AS al FROM k1),
  p1 AS (SELECT x, (c - d) / al + unk AS p FROM k1, q1),
  h2 AS (SELECT b, sum(c) AS al, {disc('k2')} * count(*) / sum(c) AS g FROM k2 GROUP BY b),
  p2 AS (SELECT k2.b, k2.x, (c - {disc('k2')}) / al + g * p AS p FROM k2 JOIN h2 ON k2.b = h2.b JOIN p1 ON k2.x = p1.x),
  h3 AS (SELECT a, b, sum(c) AS al, {disc('k3')} * count(*) / sum(c) AS g FROM k3 GROUP BY a, b),
  p3 AS (SELECT k3.a, k3.b, k3.x, (c - {disc('k3')}) / al + g * p AS p
         FROM k3 JOIN h3 ON k3.a = h3.a AND k3.b = h3.b JOIN p2 ON k3.b = p2.b AND k3.x = p2.x),
  hw AS (SELECT {keys}, ['<s>'] || {ws('text')} || ['</s>'] AS w FROM {hyps}),
  hp AS (SELECT {keys}, CASE WHEN i > 2 THEN w[i - 2] END AS a, w[i - 1] AS b, w[i] AS x FROM (SELECT *, unnest(generate_series(2, len(w))) AS i FROM hw)),
  hl AS (SELECT {keys}, coalesce(p3.p, coalesce(h3.g, 1) * coalesce(p2.p, coalesce(h2.g, 1) * coalesce(p1.p, unk))) AS p
         FROM hp LEFT JOIN p3 ON hp.a = p3.a AND hp.b = p3.b AND hp.x = p3.x LEFT JOIN h3 ON hp.a = h3.a AND hp.b = h3.b
         LEFT JOIN p2 ON hp.b = p2.b AND hp.x = p2.x LEFT JOIN h2 ON hp.b = h2.b LEFT JOIN p1 ON hp.x = p1.x, q1),
  loss AS (SELECT {keys}, round(-avg(ln(p)), 6) AS loss FROM hl GROUP BY ALL)"""


@register("score_kneser_ney", sql=_kn_sql("nbest", "sent_id, hyp_idx") + " SELECT sent_id, hyp_idx, loss FROM loss")
def q_score_kneser_ney(spark, d):
    """U5 with a Kneser-Ney model of order 3."""
    lm = KN.train(fx.lines(spark, d), "text", order=3)
    out = KN.score_loss(fx.nbest(spark, d).select("sent_id", "hyp_idx", "text"), lm)
    return out.select("sent_id", "hyp_idx", F.round("loss", 6).alias("loss"))


@register("rerank_kneser_ney", sql=_kn_sql(
    "(SELECT doc_id, (line_no - 1) // 5 AS sent_id, CAST((line_no - 1) % 5 AS INTEGER) AS hyp_idx, text FROM lines)", "doc_id, sent_id, hyp_idx, text") + """
  SELECT doc_id, sent_id, hyp_idx, text, loss FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY loss, hyp_idx) AS rk FROM loss) WHERE rk = 1""")
def q_rerank_kneser_ney(spark, d):
    """U5 -> W3 for the most fluent of five lines in a row, under a Kneser-Ney model of order 3."""
    ln = fx.lines(spark, d)
    hyp = ln.select("doc_id", F.floor((F.col("line_no") - 1) / 5).alias("sent_id"), ((F.col("line_no") - 1) % 5).cast("int").alias("hyp_idx"), "text")
    scored = KN.score_loss(hyp, KN.train(ln, "text", order=3), "text", ("doc_id", "sent_id", "hyp_idx")).withColumn("loss", F.round("loss", 6))
    return NB.rerank(scored, "loss", "min", ("doc_id", "sent_id")).select("doc_id", "sent_id", "hyp_idx", "text", "loss")
