"""Sinks (K1-K6).

Parquet with explicit key columns is the default everywhere: it keeps row
identity without relying on file order.  Ordered text output is available
where a line-per-row file is the point (K1, K2, K4); it is produced by a
range-partitioned sort, so part files concatenated in name order are in
line order and no single task has to hold the whole output.  A line break
inside a text would shift every later line, so it is replaced by a blank (or,
with ``breaks="error"``, raises).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: what a line reader takes for the end of a line
LINE_BREAK = "\r\n|\r|\n"


def one_line(c: str, breaks: str = "replace"):
    """A text column as one line of a file; null is an empty line."""
    x = F.coalesce(F.col(c), F.lit(""))
    if breaks == "replace":
        return F.regexp_replace(x, LINE_BREAK, " ")
    if breaks == "error":
        return F.when(x.rlike(LINE_BREAK), F.raise_error(F.lit(f"line break inside {c}"))).otherwise(x)
    raise ValueError("breaks must be 'replace' or 'error'")


def _ordered(df: DataFrame, order_cols, texts, partition_cols=(), keep=None) -> DataFrame:
    """Rows in order; of equal keys by the texts' hashes.  Range bounds are sampled from keys
    and hashes, so no text reaches the driver or travels as a key.  ``keep``: the one text that
    travels with them; rows of equal keys are then told apart by 96 bits of hashes."""
    hashes = {"__hash": F.xxhash64(*texts)} | ({"__hash2": F.hash(*texts)} if keep else {})
    keys = [*partition_cols, *order_cols, *hashes]
    hashed = df.withColumns(hashes).select(*dict.fromkeys([*keys, *([keep] if keep else df.columns)]))
    return hashed.repartitionByRange(*keys).sortWithinPartitions(*keys, *([keep] if keep else texts)).drop(*hashes)


def write_lines(df: DataFrame, path: str, text: str = "text", order_cols=("line_no",),
                partition_by=(), mode: str = "overwrite", breaks: str = "replace") -> None:
    """K1: ordered text output, one line per row (no BOM).  With
    ``partition_by`` every value gets its own folder of part files."""
    out = _ordered(df.select(*partition_by, *order_cols, text), order_cols, [text], list(partition_by))
    w = out.select(*partition_by, one_line(text, breaks).alias("value")).write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.text(path)


def write_parallel(df: DataFrame, src_path: str, tgt_path: str, order_cols=("line_no",),
                   src: str = "source", tgt: str = "target", table_path: str | None = None,
                   breaks: str = "replace") -> None:
    """K2: the two sides as line files kept in step.

    The pairs are first written once as a keyed Parquet table (kept at
    ``table_path`` if given, else a scratch table), and each side is sorted
    from it by the same key, without the other side's text; hashes of both
    texts belong to the key, so that ties cannot come out in different
    orders."""
    keyed = df.select(*order_cols, src, tgt)
    if table_path:
        keyed.write.mode("overwrite").parquet(table_path)
        keyed = df.sparkSession.read.parquet(table_path)
    else:
        keyed = materialize(keyed, "pair")
    for side, path in ((src, src_path), (tgt, tgt_path)):
        ordered = _ordered(keyed, order_cols, [src, tgt], keep=side)
        ordered.select(one_line(side, breaks).alias("value")).write.mode("overwrite").text(path)


def append_corpus(df: DataFrame, path: str, corpus_col: str = "corpus", first: bool = False) -> None:
    """K3: add sub-corpora to a running training table, partitioned by
    corpus.  ``first=True`` replaces the whole table (a rerun starts from
    scratch, as the reference deletes its output first); later calls
    append."""
    w = df.write.partitionBy(corpus_col)
    if first:
        w.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    else:
        w.mode("append").parquet(path)


def replace_corpus(df: DataFrame, path: str, corpus_col: str = "corpus") -> None:
    """Re-run of single sub-corpora: only the corpora present in ``df`` are
    replaced (dynamic partition overwrite); the others are kept."""
    df.write.partitionBy(corpus_col).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_predictions(df: DataFrame, path: str, text: str = "text", order_cols=("line_no",),
                      partition_by=("metric", "task")) -> None:
    """K4: one prediction file per (metric, task), lines in order."""
    write_lines(df, path, text, order_cols, partition_by)


def cache_tokenized(df: DataFrame, path: str, key_cols=("src_tag", "tgt_tag", "split")) -> DataFrame:
    """K5: materialise tokenised data keyed by language pair *and split* (the
    reference's cache key leaves the split out, so train and validation can
    collide); returns the re-read table, whose lineage is cut."""
    df.write.mode("overwrite").partitionBy(*key_cols).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """K6: scores as JSON records (one small file: metrics are one row per
    group)."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def run_metrics(scores: DataFrame, counts: DataFrame, score: str = "bleu", task: str = "task") -> DataFrame:
    """K6 record of a run: ``eval_<score>`` (the mean over its tasks), and
    ``<split>_samples`` from ``counts(split, samples)`` (A16), one row."""
    mean = scores.agg(F.round(F.avg(score), 6).alias(f"eval_{score}"), F.count_distinct(task).alias("n_tasks"))
    samples = counts.agg(*[F.sum(F.when(F.col("split") == s, F.col("samples"))).cast("long").alias(f"{s}_samples")
                           for s in ("train", "validation")])
    return mean.withColumns({c: samples.select(c).scalar() for c in samples.columns})
