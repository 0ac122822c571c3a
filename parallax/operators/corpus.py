"""Mixtures, splits, shuffles, batches and packing (U-ALL, S5/S6, P5, B1-B11).

Positions inside a corpus (needed for head splits, batches and packing)
come from the two-level scan in ``scan``; seeded shuffles order rows by an
md5 key, which is independent of partitioning and identical in any SQL
engine, and rank them with the same two-level scan on md5 prefix buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_words
from .scan import line_positions, prefix_scan


def _cols(x):
    return [x] if isinstance(x, str) else list(x or [])


# ---------------------------------------------------------------------------
# U-ALL, S5, S6, P5
# ---------------------------------------------------------------------------
def concat_corpora(frames: dict[str, DataFrame] | list[DataFrame], corpus_col: str = "corpus") -> DataFrame:
    """U-ALL: concatenation without de-duplication (UNION ALL), with the
    origin of every row kept in ``corpus_col``."""
    if isinstance(frames, dict):
        frames = [df.withColumn(corpus_col, F.lit(name)) for name, df in frames.items()]
    return reduce(DataFrame.unionByName, frames)  # differing columns are an error


MANIFEST_TYPE = T.MapType(T.StringType(), T.ArrayType(
    T.StructType([T.StructField("source", T.StringType()), T.StructField("target", T.StringType())])))
VALIDATION_TYPE = T.MapType(T.StringType(), T.StructType(
    [T.StructField("source", T.StringType()), T.StructField("target", T.StringType())]))


class ManifestError(ValueError):
    pass


def manifest_rows(spark: SparkSession, manifest_json: str) -> DataFrame:
    """``{tag: [{source, target}, ...]}`` -> rows (tag, ord, source, target).

    Parsed with ``from_json``; an entry without both keys is an error.  The
    manifest is configuration (a handful of rows), so it is safe to collect
    the validation result and to broadcast it."""
    m = spark.range(1).select(F.from_json(F.lit(manifest_json), MANIFEST_TYPE).alias("m"))
    rows = (m.select(F.explode("m").alias("tag", "entries"))
            .select("tag", F.posexplode("entries").alias("ord", "e"))
            .select("tag", "ord", F.col("e.source").alias("source"), F.col("e.target").alias("target")))
    bad = rows.where(F.col("source").isNull() | F.col("target").isNull()).limit(1).collect()
    if bad:
        raise ManifestError(f"manifest entry for tag {bad[0]['tag']!r} needs both 'source' and 'target'")
    return rows


def validation_manifest_rows(spark: SparkSession, manifest_json: str) -> DataFrame:
    """``{tag: {source, target}}`` -> rows (task, source, target)."""
    m = spark.range(1).select(F.from_json(F.lit(manifest_json), VALIDATION_TYPE).alias("m"))
    rows = m.select(F.explode("m").alias("task", "e")).select(
        "task", F.col("e.source").alias("source"), F.col("e.target").alias("target"))
    bad = rows.where(F.col("source").isNull() | F.col("target").isNull()).limit(1).collect()
    if bad:
        raise ManifestError(f"validation entry {bad[0]['task']!r} needs both 'source' and 'target'")
    return rows


def assign_tags(df: DataFrame, src_tag, tgt_tag) -> DataFrame:
    """P5: every pair carries a source and a target language tag."""
    as_c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.withColumn("src_tag", as_c(src_tag)).withColumn("tgt_tag", as_c(tgt_tag))


def build_mixture(pairs: DataFrame, manifest: DataFrame, corpus_col: str = "corpus",
                  entry_col: str = "source") -> DataFrame:
    """X4 core: attach every manifest entry to the corpus it names.

    A corpus listed twice is included twice (upsampling), exactly like
    concatenating it twice.  An entry whose corpus has no pair is an error,
    raised when the result is computed.  The manifest side is a handful of
    rows, so it is broadcast; the pair side is never shuffled."""
    m = manifest.select("tag", "ord", F.col(entry_col).alias(corpus_col))
    there = pairs.select(corpus_col).distinct()
    gone = F.concat(F.lit("the manifest names a corpus without pairs: "), F.col(corpus_col))
    checked = m.join(there.withColumn("__there", F.lit(True)), corpus_col, "left").withColumn(
        "tag", F.when(F.col("__there"), F.col("tag")).otherwise(F.raise_error(gone).cast("string"))).drop("__there")
    return pairs.join(F.broadcast(checked), corpus_col)


# ---------------------------------------------------------------------------
# B1, B2, B6-B9
# ---------------------------------------------------------------------------
def with_positions(lines: DataFrame, group=("corpus",), doc_col="doc_id", line_col="line_no",
                   name: str = "pos", dense: bool = False) -> DataFrame:
    return line_positions(lines, list(group), doc_col, line_col, name, dense=dense)


def group_sizes(df: DataFrame, group=("corpus",)) -> DataFrame:
    return df.groupBy(*_cols(group)).agg(F.count(F.lit(1)).alias("__n"))


def with_group_size(df: DataFrame, group=("corpus",)) -> DataFrame:
    """Adds ``__n``, the row count of the row's group (an equi-join with the
    per-group count table; a scalar subquery when there is no group)."""
    keys = _cols(group)
    if not keys:
        return df.withColumn("__n", df.agg(F.count(F.lit(1))).scalar())  # scalar subquery
    return df.join(group_sizes(df, group), keys)


def split_head_percent(df: DataFrame, pct: float = 5.0, group=("corpus",), pos: str = "pos",
                       size: str | None = None) -> DataFrame:
    """B1: the first ``pct`` % of every group (by position) is validation,
    the rest train.  The cut is round-half-even(n * pct / 100).  ``size``
    names a column that already holds the group's row count."""
    j = df.withColumn("__n", F.col(size)) if size else with_group_size(df, group)
    cut = F.bround(F.col("__n") * F.lit(pct) / 100.0, 0)
    return j.withColumn("split", F.when(F.col(pos) <= cut, F.lit("validation")).otherwise(F.lit("train"))).drop("__n")


def limit_head(df: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """B2: the first ``min(n, len)`` rows of each group (a stable filter on
    the position, not ``limit``)."""
    return df.where(F.col(pos) <= n)


def assign_batches(df: DataFrame, size: int, pos: str = "pos") -> DataFrame:
    """Consecutive batches of ``size`` rows; the last one may be short."""
    return df.withColumn("batch_id", F.floor((F.col(pos) - 1) / size).cast("long"))


def batch_shapes(df: DataFrame, group=("corpus",), ids: str = "ids", multiple_of: int | None = None) -> DataFrame:
    """Rows, longest row (the padded length) and padding waste per batch."""
    n = F.size(ids)
    out = df.groupBy(*_cols(group), "batch_id").agg(F.count(F.lit(1)).alias("rows"),
                                                    F.max(n).cast("long").alias("max_len"),
                                                    F.sum(n).cast("long").alias("tokens"))
    padded = F.col("max_len") if not multiple_of else F.ceil(F.col("max_len") / multiple_of) * multiple_of
    return out.withColumn("padded_len", padded.cast("long")) \
        .withColumn("padding", (F.col("padded_len") * F.col("rows") - F.col("tokens")).cast("long"))


def skip_batches(df: DataFrame, n: int) -> DataFrame:
    """Resume mid-epoch by dropping the first ``n`` batches."""
    return df.where(F.col("batch_id") >= n)


def training_schedule(df: DataFrame, batch_size: int, accumulation: int = 1, epochs: int = 1,
                      group=("corpus",)) -> DataFrame:
    """Batches per epoch, optimizer updates per epoch and in total."""
    n = group_sizes(df, group)
    batches = F.ceil(F.col("__n") / batch_size)
    updates = F.ceil(batches / accumulation)
    return n.select(*_cols(group), F.col("__n").alias("rows"), batches.cast("long").alias("batches"),
                    updates.cast("long").alias("updates_per_epoch"),
                    (updates * epochs).cast("long").alias("total_updates"))


# ---------------------------------------------------------------------------
# Seeded, partition-independent randomness
# ---------------------------------------------------------------------------
def shuffle_key(seed, *cols) -> Column:
    """md5 of 'seed-col1-col2-...': the same in Spark and any SQL engine."""
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws("-", *parts))


def shuffle_rank(df: DataFrame, seed, key_cols, group=("corpus",), name: str = "rank",
                 bucket_hex: int = 4) -> DataFrame:
    """1-based rank of every row in the seeded shuffle of its group.

    Ranks are computed with the two-level scan, chunked by the first
    ``bucket_hex`` hex digits of the md5 key: md5 is uniform, so no chunk is
    hot no matter how large one group is."""
    k = shuffle_key(seed, *_cols(group), *_cols(key_cols))
    d = df.withColumn("__key", k)
    chunk = F.conv(F.substring("__key", 1, bucket_hex), 16, 10).cast("long")
    out = prefix_scan(d, _cols(group), chunk, ["__key", *_cols(key_cols)], [(name, "count", None, True)])
    return out.withColumn(name, F.col(name).cast("long")).drop("__key")


def sample_rows(df: DataFrame, k: int, seed, key_cols, group=("corpus",)) -> DataFrame:
    """``k`` rows with the smallest shuffle keys (TakeOrderedAndProject)."""
    key = shuffle_key(seed, *_cols(group), *_cols(key_cols))
    return df.withColumn("__key", key).orderBy("__key").limit(k).drop("__key")


def random_subset(df: DataFrame, n: int, seed, key_cols, group=("corpus",), bucket_hex: int = 4) -> DataFrame:
    """The first ``n`` rows of the seeded shuffle of every group.

    Counts per md5 bucket (its first ``bucket_hex`` digits) give the bucket
    in which the n-th row lies: earlier buckets are taken whole, and only the
    rows of that one are ranked."""
    group, key_cols = _cols(group), _cols(key_cols)
    d = df.withColumn("__key", shuffle_key(seed, *group, *key_cols)).withColumn("__bk", F.substring("__key", 1, bucket_hex))
    sums = d.groupBy(*group, "__bk").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy("__bk").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("__before", before).where(F.col("__before") < n)
    taken = d.join(sums, [*group, "__bk"])
    whole = taken.where(F.col("__before") + F.col("__n") <= n)
    rank = F.row_number().over(Window.partitionBy(*group, "__bk").orderBy("__key", *key_cols))
    cut = taken.where(F.col("__before") + F.col("__n") > n).withColumn("__rk", rank).where(F.col("__before") + F.col("__rk") <= n)
    return whole.select(*df.columns).unionByName(cut.select(*df.columns))


# ---------------------------------------------------------------------------
# B10, B11
# ---------------------------------------------------------------------------
def pack_blocks(df: DataFrame, block: int, group_rows: int = 1000, group=("corpus",), pos: str = "pos",
                ids: str = "ids") -> DataFrame:
    """Concatenate the token lists of every ``group_rows`` consecutive
    rows, cut into blocks of ``block`` tokens and drop each group's
    remainder.  A collect group is bounded by ``group_rows`` rows."""
    g = F.floor((F.col(pos) - 1) / group_rows).cast("long")
    grouped = (df.withColumn("group_id", g)
               .groupBy(*_cols(group), "group_id")
               .agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(ids).alias("t")))).alias("__r")))
    flat = grouped.select(*_cols(group), "group_id", F.flatten(F.transform("__r", lambda x: x["t"])).alias("__all"))
    nblocks = F.floor(F.size("__all") / block)
    idx = F.when(nblocks > 0, F.sequence(F.lit(0), nblocks - 1)).otherwise(F.array().cast("array<bigint>"))
    ex = flat.select(*_cols(group), "group_id", "__all", F.explode(idx).alias("block_idx"))
    return ex.select(*_cols(group), "group_id", F.col("block_idx").cast("long"),
                     F.slice("__all", F.col("block_idx").cast("int") * block + 1, block).alias("input_ids")) \
        .withColumn("labels", F.col("input_ids"))


def expand_prefixes(df: DataFrame, n: int, text: str = "text") -> DataFrame:
    """For i in 3..n+2, every line's first i words (output order (i, line))."""
    return df.withColumn("i", F.explode(F.sequence(F.lit(3), F.lit(n + 2)))) \
        .withColumn("prompt", first_words(text, F.col("i")))


def sample_counts(df: DataFrame, cap: int | None, group=()) -> DataFrame:
    """``min(cap, available)`` per group."""
    n = F.count(F.lit(1))
    return df.groupBy(*_cols(group)).agg((F.least(F.lit(cap), n) if cap is not None else n).cast("long").alias("samples"))
