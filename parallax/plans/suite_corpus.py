"""Queries: mixtures, splits, shuffles, batching, packing and token arrays
(U-ALL, S5, P5, X11, B1-B11, A16, P14-P17)."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import tokens as tk
from ..operators import corpus as C
from . import fixtures as fx
from .workflows import mixture_report
from .registry import register

POS = "row_number() OVER (PARTITION BY corpus ORDER BY doc_id, line_no)"

MANIFEST = {"arg_Latn": [{"source": "src0", "target": "src0"}, {"source": "src3", "target": "src3"}],
            "oci_Latn": [{"source": "src5", "target": "src5"}, {"source": "src5", "target": "src5"}],
            "ast_Latn": [{"source": "src7", "target": "src7"}]}
MANIFEST_JSON = json.dumps(MANIFEST)
MANIFEST_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{tag}', {i}, '{e['source']}')" for tag, es in MANIFEST.items() for i, e in enumerate(es)) + \
    ") AS m(tag, ord, corpus)"


def _arr(c):
    return F.array_join(F.col(c).cast("array<string>"), " ")


def _pos_tokens(spark, d):
    return fx.positioned(spark, d).select("corpus", "doc_id", "line_no", "pos", tk.word_length_ids("text").alias("ids"))


@register("concat_corpora", sql="""
  SELECT 'conversations' AS corpus, md5(source) AS source_md5, md5(target) AS target_md5 FROM pairs_conv
  UNION ALL
  SELECT 'documents' AS corpus, md5(source) AS source_md5, md5(target) AS target_md5 FROM pairs_docs""")
def q_concat_corpora(spark, d):
    conv = fx.pairs_conv(spark, d).select("source", "target")
    docs = fx.pairs_docs(spark, d).select("source", "target")
    u = C.concat_corpora({"conversations": conv, "documents": docs})
    return u.select("corpus", F.md5("source").alias("source_md5"), F.md5("target").alias("target_md5"))


@register("mixture", sql=f"""
  SELECT m.tag, CAST(m.ord AS INTEGER) AS ord, p.corpus, p.doc_id, p.line_no,
         '<2' || m.tag || '> ' || p.source AS source, m.tag || ' ' || p.target AS target
  FROM pairs_docs p JOIN ({MANIFEST_SQL}) m ON m.corpus = p.corpus""")
def q_mixture(spark, d):
    pairs = fx.pairs_docs(spark, d).select("corpus", "doc_id", "line_no", "source", "target")
    mix = C.build_mixture(pairs, C.manifest_rows(spark, MANIFEST_JSON))
    return mix.select("tag", "ord", "corpus", "doc_id", "line_no",
                      F.concat(F.lit("<2"), "tag", F.lit("> "), "source").alias("source"),
                      tx.tag_target("target", F.col("tag")).alias("target"))


@register("mixture_report", sql=f"""
  SELECT tag, count(*) AS n_pairs, CAST(sum(len({fx.sql_words('p.source')})) AS BIGINT) AS src_tokens,
         CAST(sum(len({fx.sql_words('p.target')})) AS BIGINT) AS tgt_tokens,
         round(sum(len({fx.sql_words('p.source')})) / sum(sum(len({fx.sql_words('p.source')}))) OVER (), 6) AS src_share
  FROM pairs_docs p JOIN ({MANIFEST_SQL}) m ON m.corpus = p.corpus GROUP BY tag""")
def q_mixture_report(spark, d):
    pairs = fx.pairs_docs(spark, d).select("corpus", "doc_id", "line_no", "source", "target")
    return mixture_report(C.build_mixture(pairs, C.manifest_rows(spark, MANIFEST_JSON)))


@register("mixture_report_origin", sql=f"""
  SELECT tag, origin, n_pairs, src_tokens, tgt_tokens, round(src_tokens / sum(src_tokens) OVER (), 6) AS src_share,
         round(n_pairs / sum(n_pairs) OVER (PARTITION BY tag), 6) AS pair_share
  FROM (SELECT tag, CASE WHEN p.line_no % 2 = 0 THEN 'synthetic' ELSE 'real' END AS origin, count(*) AS n_pairs,
               CAST(sum(len({fx.sql_words('p.source')})) AS BIGINT) AS src_tokens,
               CAST(sum(len({fx.sql_words('p.target')})) AS BIGINT) AS tgt_tokens
        FROM pairs_docs p JOIN ({MANIFEST_SQL}) m ON m.corpus = p.corpus GROUP BY ALL)""")
def q_mixture_report_origin(spark, d):
    """X11 by tag and origin (even lines stand for synthetic ones)."""
    pairs = fx.pairs_docs(spark, d).select("corpus", "doc_id", "line_no", "source", "target")
    mix = C.build_mixture(pairs, C.manifest_rows(spark, MANIFEST_JSON))
    return mixture_report(mix.withColumn("origin", F.when(F.col("line_no") % 2 == 0, "synthetic").otherwise("real")), "origin")


@register("split_head", sql=f"""
  SELECT corpus, doc_id, line_no,
         CASE WHEN pos <= round_even(n * 5 / 100.0, 0) THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT *, {POS} AS pos, count(*) OVER (PARTITION BY corpus) AS n FROM lines)""")
def q_split_head(spark, d):
    return C.split_head_percent(fx.positioned(spark, d, total="n"), 5.0, size="n").select("corpus", "doc_id", "line_no", "split")


@register("sample_counts", sql=f"""
  SELECT corpus, split, CAST(least(200, count(*)) AS BIGINT) AS samples FROM (
    SELECT corpus, CASE WHEN pos <= round_even(n * 5 / 100.0, 0) THEN 'validation' ELSE 'train' END AS split
    FROM (SELECT *, {POS} AS pos, count(*) OVER (PARTITION BY corpus) AS n FROM lines))
  GROUP BY corpus, split""")
def q_sample_counts(spark, d):
    s = C.split_head_percent(fx.positioned(spark, d, total="n"), 5.0, size="n")
    return C.sample_counts(s, 200, ["corpus", "split"])


@register("limit_head", sql=f"""
  SELECT corpus, doc_id, line_no FROM (SELECT *, {POS} AS pos FROM lines) WHERE pos <= 100""")
def q_limit_head(spark, d):
    return C.limit_head(fx.positioned(spark, d), 100).select("corpus", "doc_id", "line_no")


@register("batches", sql=f"""
  SELECT corpus, doc_id, line_no, CAST(({POS} - 1) // 16 AS BIGINT) AS batch_id FROM lines""")
def q_batches(spark, d):
    return C.assign_batches(fx.positioned(spark, d), 16).select("corpus", "doc_id", "line_no", "batch_id")


@register("batch_shapes", sql=f"""
  SELECT corpus, batch_id, count(*) AS rows, CAST(max(len(ids)) AS BIGINT) AS max_len,
         CAST(sum(len(ids)) AS BIGINT) AS tokens, CAST(ceil(max(len(ids)) / 8) * 8 AS BIGINT) AS padded_len,
         CAST(ceil(max(len(ids)) / 8) * 8 * count(*) - sum(len(ids)) AS BIGINT) AS padding
  FROM (SELECT *, CAST(({POS} - 1) // 16 AS BIGINT) AS batch_id FROM tokens) GROUP BY corpus, batch_id""")
def q_batch_shapes(spark, d):
    return C.batch_shapes(C.assign_batches(_pos_tokens(spark, d), 16), multiple_of=8)


@register("skip_batches", sql=f"""
  SELECT corpus, doc_id, line_no, batch_id FROM (
    SELECT corpus, doc_id, line_no, CAST(({POS} - 1) // 16 AS BIGINT) AS batch_id FROM lines)
  WHERE batch_id >= 10""")
def q_skip_batches(spark, d):
    b = C.assign_batches(fx.positioned(spark, d), 16)
    return C.skip_batches(b, 10).select("corpus", "doc_id", "line_no", "batch_id")


@register("schedule", sql="""
  SELECT corpus, count(*) AS rows, CAST(ceil(count(*) / 16) AS BIGINT) AS batches,
         CAST(ceil(ceil(count(*) / 16) / 4) AS BIGINT) AS updates_per_epoch,
         CAST(ceil(ceil(count(*) / 16) / 4) * 3 AS BIGINT) AS total_updates
  FROM lines GROUP BY corpus""")
def q_schedule(spark, d):
    return C.training_schedule(fx.lines(spark, d), 16, accumulation=4, epochs=3)


SHUF_KEY = "md5('42-' || corpus || '-' || doc_id || '-' || line_no)"


@register("shuffle", sql=f"""
  SELECT corpus, doc_id, line_no,
         row_number() OVER (PARTITION BY corpus ORDER BY {SHUF_KEY}, doc_id, line_no) AS rank FROM lines""")
def q_shuffle(spark, d):
    ln = fx.lines(spark, d).select("corpus", "doc_id", "line_no")
    return C.shuffle_rank(ln, 42, ["doc_id", "line_no"])


@register("sample_rows", sql=f"""
  SELECT corpus, doc_id, line_no, text FROM lines ORDER BY {SHUF_KEY} LIMIT 3""")
def q_sample_rows(spark, d):
    ln = fx.lines(spark, d).select("corpus", "doc_id", "line_no", "text")
    return C.sample_rows(ln, 3, 42, ["doc_id", "line_no"])


@register("random_subset", sql=f"""
  SELECT corpus, doc_id, line_no FROM (
    SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY {SHUF_KEY}, doc_id, line_no) AS rk FROM lines)
  WHERE rk <= 100""")
def q_random_subset(spark, d):
    ln = fx.lines(spark, d).select("corpus", "doc_id", "line_no")
    return C.random_subset(ln, 100, 42, ["doc_id", "line_no"])


@register("pack_blocks", sql=f"""
  , g AS (SELECT corpus, CAST((pos - 1) // 1000 AS BIGINT) AS group_id, flatten(list(ids ORDER BY pos)) AS a
         FROM (SELECT *, {POS} AS pos FROM tokens) GROUP BY ALL),
  b AS (SELECT corpus, group_id, a, unnest(generate_series(0, len(a) // 128 - 1)) AS block_idx FROM g)
  SELECT corpus, group_id, CAST(block_idx AS BIGINT) AS block_idx,
         array_to_string(a[block_idx * 128 + 1 : (block_idx + 1) * 128], ' ') AS input_ids FROM b""")
def q_pack_blocks(spark, d):
    p = C.pack_blocks(_pos_tokens(spark, d), 128, 1000)
    return p.select("corpus", "group_id", "block_idx", _arr("input_ids").alias("input_ids"))


@register("prefix_expand", sql="""
  SELECT i, doc_id, line_no, array_to_string(string_split(text, ' ')[1:i], ' ') AS prompt
  FROM lines, range(3, 6) r(i)""")
def q_prefix_expand(spark, d):
    ln = fx.lines(spark, d).select("doc_id", "line_no", "text")
    return C.expand_prefixes(ln, 3).select(F.col("i").cast("long").alias("i"), "doc_id", "line_no", "prompt")


@register("mask_unmask", sql="""
  SELECT corpus, doc_id, line_no,
         array_to_string(list_transform(ids, lambda x: CASE WHEN x = 3 THEN -100 ELSE x END), ' ') AS masked,
         array_to_string(list_transform(list_transform(ids, lambda x: CASE WHEN x = 3 THEN -100 ELSE x END),
                                        lambda x: CASE WHEN x = -100 THEN 3 ELSE x END), ' ') AS restored
  FROM tokens""")
def q_mask_unmask(spark, d):
    t = fx.tokens(spark, d).withColumn("m", tk.mask_padding("ids", 3))
    return t.select("corpus", "doc_id", "line_no", _arr("m").alias("masked"),
                    F.array_join(tk.unmask_labels("m", 3).cast("array<string>"), " ").alias("restored"))


@register("pad", sql=f"""
  SELECT corpus, doc_id, line_no, CAST(target AS BIGINT) AS padded_len,
         array_to_string(list_concat(ids, list_transform(generate_series(1, target - len(ids)), lambda x: 0)), ' ')
           AS padded
  FROM (SELECT *, CAST(ceil(max(len(ids)) OVER (PARTITION BY corpus, batch_id) / 8) * 8 AS BIGINT) AS target
        FROM (SELECT *, ({POS} - 1) // 16 AS batch_id FROM tokens))""")
def q_pad(spark, d):
    b = C.assign_batches(_pos_tokens(spark, d), 16)
    longest = F.max(F.size("ids")).over(Window.partitionBy("corpus", "batch_id"))  # 16 rows per window
    b = b.withColumn("__n", longest)
    out = b.withColumn("padded", tk.pad_to("ids", F.col("__n"), 0, multiple_of=8))
    return out.select("corpus", "doc_id", "line_no", F.size("padded").cast("long").alias("padded_len"),
                      _arr("padded").alias("padded"))


@register("shift", sql="""
  SELECT corpus, doc_id, line_no,
         array_to_string(list_transform(generate_series(1, greatest(len(ids) - 1, 0)),
                                        lambda i: ids[i] || ':' || ids[i + 1]), ' ') AS pairs
  FROM tokens""")
def q_shift(spark, d):
    t = fx.tokens(spark, d).withColumn("z", tk.shift_for_next_token("ids", "ids"))
    return t.select("corpus", "doc_id", "line_no",
                    F.array_join(F.transform("z", lambda x: F.concat_ws(":", x["p"].cast("string"),
                                                                        x["l"].cast("string"))), " ").alias("pairs"))
