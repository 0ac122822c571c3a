"""Queries: scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.tokens import subword_encode
from ..functions.word_tokens import tokenize_words
from . import fixtures as fx
from .registry import register


@register("source_prefix", sql="""
  SELECT conv_id, turn, md5('translate to target: ' || source) AS source_md5 FROM pairs_conv""")
def q_source_prefix(spark, d):
    p = fx.pairs_conv(spark, d)
    return p.select("conv_id", "turn",
                    F.md5(tx.add_source_prefix("source", "translate to target: ")).alias("source_md5"))


@register("prefix_tag", sql="""
  SELECT doc_id, line_no, lang || '_Latn ' || target AS tagged FROM pairs_docs""")
def q_prefix_tag(spark, d):
    p = fx.pairs_docs(spark, d)
    return p.select("doc_id", "line_no",
                    tx.tag_target("target", F.concat("lang", F.lit("_Latn"))).alias("tagged"))


@register("final_period", sql="""
  SELECT doc_id, line_no,
         CASE WHEN suffix(source, '.') AND NOT suffix(target, '.') THEN target || '.' ELSE target END AS target_pos
  FROM pairs_docs""")
def q_final_period(spark, d):
    p = fx.pairs_docs(spark, d)
    return p.select("doc_id", "line_no", tx.restore_final_period("source", "target").alias("target_pos"))


@register("drop_marks", sql="""
  SELECT conv_id, turn, md5(replace(text, '*', '')) AS text_md5,
         CAST(length(text) - length(replace(text, '*', '')) AS BIGINT) AS n_marks
  FROM conversations""")
def q_drop_marks(spark, d):
    c = fx.table(spark, d, "conversations")
    cleaned = tx.drop_unknown_marks("text")
    return c.select("conv_id", "turn", F.md5(cleaned).alias("text_md5"),
                    (F.length("text") - F.length(cleaned)).cast("long").alias("n_marks"))


@register("flatten_newlines", sql="""
  SELECT doc_id, md5(replace(text, chr(10), ' ')) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars
  FROM documents""")
def q_flatten_newlines(spark, d):
    docs = fx.table(spark, d, "documents")
    return docs.select("doc_id", F.md5(tx.flatten_newlines("text")).alias("text_md5"),
                       F.length("text").cast("long").alias("n_chars"))


@register("first_words", sql="""
  SELECT doc_id, line_no, array_to_string(string_split(text, ' ')[1:3], ' ') AS prompt FROM lines""")
def q_first_words(spark, d):
    return fx.lines(spark, d).select("doc_id", "line_no", tx.first_words("text", 3).alias("prompt"))


@register("name_key", sql="""
  SELECT DISTINCT lang || '_Latn' AS tag, replace(lang || '_Latn', '_', '') AS name_key FROM documents""")
def q_name_key(spark, d):
    tags = fx.table(spark, d, "documents").select(F.concat("lang", F.lit("_Latn")).alias("tag")).distinct()
    return tags.select("tag", tx.language_name_key("tag").alias("name_key"))


def _np_sql():
    parts = []
    for lang in ("en", "fr", "de", "es"):
        parts.append(f"WHEN lang = '{lang}' THEN {fx.sql_regex_chain('text', tx.normalize_punct_rules(lang))}")
    return "CASE " + " ".join(parts) + f" ELSE {fx.sql_regex_chain('text', tx.normalize_punct_rules('xx'))} END"


@register("normalize_punct", sql=f"""
  SELECT doc_id, line_no, md5({_np_sql()}) AS norm_md5 FROM lines""")
def q_normalize_punct(spark, d):
    ln = fx.lines(spark, d)
    return ln.select("doc_id", "line_no", F.md5(tx.normalize_punct_by("text", "lang")).alias("norm_md5"))


@register("word_tokenize", sql=f"""
  SELECT doc_id, line_no, {fx.sql_regex_chain('text', tx.WORD_TOKENIZE_RULES)} AS tokens FROM lines""")
def q_word_tokenize(spark, d):
    return fx.lines(spark, d).select("doc_id", "line_no", tx.word_tokenize("text").alias("tokens"))


@register("word_tokenize_lang")
def q_word_tokenize_lang(spark, d):
    """P11 by the rules of each line's language."""
    return fx.lines(spark, d).select("doc_id", "line_no", tokenize_words("text", F.col("lang")).alias("tokens"))


@register("vocab_size", sql="""
  SELECT side, count(DISTINCT tok) AS n_vocab FROM (
    SELECT 'source' AS side, unnest(regexp_extract_all(source, '([\\p{L}\\p{N}]+)', 1)) AS tok FROM pairs_docs
    UNION ALL
    SELECT 'target' AS side, unnest(regexp_extract_all(target, '([\\p{L}\\p{N}]+)', 1)) AS tok FROM pairs_docs)
  GROUP BY side""")
def q_vocab_size(spark, d):
    from ..operators.metrics import vocab_size
    return vocab_size(fx.pairs_docs(spark, d))


@register("word_counts", sql="""
  SELECT tok AS token, count(*) AS n FROM (
    SELECT unnest(regexp_extract_all(text, '([\\p{L}\\p{N}]+)', 1)) AS tok FROM lines)
  GROUP BY tok""")
def q_word_counts(spark, d):
    from ..operators.metrics import word_counts
    return word_counts(fx.lines(spark, d), "text")


@register("corpus_stats", sql=f"""
  SELECT corpus, count(*) AS n_pairs,
         CAST(sum(len({fx.sql_words('source')})) AS BIGINT) AS src_words,
         CAST(sum(len({fx.sql_words('target')})) AS BIGINT) AS tgt_words
  FROM pairs_docs GROUP BY corpus""")
def q_corpus_stats(spark, d):
    from ..operators.metrics import corpus_stats
    return corpus_stats(fx.pairs_docs(spark, d), ["corpus"])


@register("subword_ids")
def q_subword_ids(spark, d):
    """Ids of every line with subword pieces, truncated to 100."""
    ids = subword_encode("text", fx.subwords(spark), 100)
    return fx.lines(spark, d).select("doc_id", "line_no", F.array_join(ids.cast("array<string>"), " ").alias("ids"))
