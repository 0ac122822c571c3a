"""From raw documents to token ids: five stages over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parallax.llm import bpe, lang_rank, line_runs, mixing, queries, simhash_mih
from parallax.llm._common import free_prefix, save


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter (or text) are rejected; the rest stays, those without a language with the one predicted."""
    profiles = lang_rank.learn(docs.where(~lang_rank.held_out("doc_id")))
    found = f"{free_prefix(docs)}found"
    # a generator: the prediction is made once for the filter and the column
    named = docs.select("*", F.explode(F.array(lang_rank.predict_udf(profiles)(F.col("text")))).alias(found))
    kept = named.where(F.col(found)["lang_pred"] != "und")
    return kept.withColumn("lang", F.coalesce("lang", F.col(found)["lang_pred"])).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 or more characters found in three documents stay in the last one only."""
    return line_runs.dedup_lines(docs).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are connected at 3 bits the smallest id stays."""
    return simhash_mih.keep_one(docs, k=3, max_bits=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated (or left out) as their source's target weight asks."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether decoding them gives the text back."""
    coded = bpe.recode_together(docs.select("doc_id", "text"), queries.tokenizer(spark))
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"), "ids", (F.col("decoded") == whole).alias("round_trip"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup),
          ("mix_sources", mix_sources), ("bpe_encode", encode)]
#: fingerprints (XXH64) and BPE have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
