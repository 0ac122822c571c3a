"""Workflows a user calls (X1-X5, X8, X10, X11): compositions of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_punct, py_strip, tag_target, word_tokenize, words
from ..functions.tokens import truncate
from ..operators import corpus as C
from ..operators import metrics as M
from ..operators import runs as R
from ..operators.filters import clean_pairs, filter_language, filter_similarity
from ..operators.scan import document_offsets
from ..session import materialize
from ..sources import sinks as K
from ..sources.tables import append_run, read_runs
from ..sources.text import read_lm


# ---------------------------------------------------------------------------
# Training pairs
# ---------------------------------------------------------------------------
def prepare(pairs: DataFrame, out: str, min_len: int = 2, max_len: int = 70, first: bool = True,
            run: str | None = None) -> DataFrame:
    """Clean the pairs and add them to the training table at ``out``, by
    corpus (K3).  With ``run`` the table is kept by run, and the same run
    again replaces what it added."""
    if run is not None:
        clean = clean_pairs(pairs, min_len, max_len)
        append_run(clean, out, run)
        return read_runs(pairs.sparkSession, out, clean).drop("batch")
    K.append_corpus(clean_pairs(pairs, min_len, max_len), out, first=first)
    return pairs.sparkSession.read.parquet(out)


def prepare_similar(pairs: DataFrame, out: str, min_len: int = 1, max_len: int = 60, lo: float = 0.25,
                    hi: float = 0.99, src: str = "source", tgt: str = "target", dataset: str = "dataset") -> DataFrame:
    """The cleaned pairs as dataset ``original`` and those in the
    similarity band as ``levenshtein``, both written below ``out`` (K3)."""
    K.append_corpus(clean_pairs(pairs, min_len, max_len, src=src, tgt=tgt).withColumn(dataset, F.lit("original")), out,
                    dataset, first=True)
    clean = pairs.sparkSession.read.parquet(out).where(F.col(dataset) == "original")  # cleaned once
    similar = filter_similarity(clean, lo, hi, src=src, tgt=tgt, ratio_col=None)
    K.append_corpus(similar.withColumn(dataset, F.lit("levenshtein")), out, dataset)
    return pairs.sparkSession.read.parquet(out)


def prepare_filtered(pairs: DataFrame, labels: DataFrame, keys, lang: str = "es", label: str = "__label__es",
                     min_len: int = 1, max_len: int = 80, lo: float = 0.25, hi: float = 0.99) -> DataFrame:
    """Normalise and tokenise both sides, clean, keep source lines of the
    language, then the similarity band; the three published variants with
    their text, named in ``dataset``."""
    keys = list(keys)
    raw = pairs.select(*keys, "source", "target")
    norm = raw.select(*keys, *[word_tokenize(normalize_punct(c, lang)).alias(c) for c in ("source", "target")])
    # published and filtered further: saved once instead of normalising for each branch
    kept = materialize(filter_language(clean_pairs(norm, min_len, max_len), labels, label), "filtered")
    similar = filter_similarity(kept, lo, hi, ratio_col=None)
    return C.concat_corpora({"original": raw, "filtered": kept, "levenshtein": similar}, "dataset")


# ---------------------------------------------------------------------------
# mixtures
# ---------------------------------------------------------------------------
def training_mixture(pairs: DataFrame, manifest: DataFrame, encoder: Callable[[Column], Column], keys, src_tag: str,
                     seed: int = 42, max_tokens: int = 100, batch_size: int = 16) -> DataFrame:
    """Manifest entries -> tags (P5) -> prefix and tag (P3, P4) -> encode
    and truncate (P12) -> seeded shuffle (B3) -> batches (B6)."""
    mix = C.assign_tags(C.build_mixture(pairs, manifest), src_tag, F.col("tag"))
    order = ["tag", "ord", *keys]
    prefixed = F.concat(F.lit("<2"), F.col("tag"), F.lit("> "), F.col("source"))
    mix = mix.select(*order, "src_tag", "tgt_tag", truncate(encoder(prefixed), max_tokens).alias("src_ids"),
                     truncate(encoder(tag_target("target", F.col("tag"))), max_tokens).alias("tgt_ids"))
    return C.assign_batches(C.shuffle_rank(mix, seed, order, group=()), batch_size, pos="rank")


def mixture_report(mix: DataFrame, origin: str | None = None) -> DataFrame:
    """X11: pairs and source/target tokens per tag (and ``origin``, e.g. real
    or synthetic), and each row's share of all source tokens and, with an
    origin, of its tag's pairs.  Shares are computed over the aggregated
    rows by a window, so the mixture is read once."""
    from pyspark.sql import Window
    keys = ["tag"] + ([origin] if origin else [])
    per = mix.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"),
                                 F.sum(F.size(words("source"))).cast("long").alias("src_tokens"),
                                 F.sum(F.size(words("target"))).cast("long").alias("tgt_tokens"))
    share = [F.round(F.col("src_tokens") / F.sum("src_tokens").over(Window.partitionBy()), 6).alias("src_share")]
    if origin:
        share.append(F.round(F.col("n_pairs") / F.sum("n_pairs").over(Window.partitionBy("tag")), 6).alias("pair_share"))
    return per.select(*keys, "n_pairs", "src_tokens", "tgt_tokens", *share)


# ---------------------------------------------------------------------------
# LM dataset
# ---------------------------------------------------------------------------
def block_positions(packed: DataFrame) -> DataFrame:
    """Position of every packed block in (group_id, block_idx) order."""
    per = packed.groupBy("group_id").agg(F.count(F.lit(1)).alias("__n"))
    per = document_offsets(per, [], "group_id", name="__off")
    out = packed.join(per.select("group_id", "__off"), "group_id")
    return out.withColumn("block_pos", F.col("__off") + F.col("block_idx") + 1).drop("__off")


def lm_dataset(spark: SparkSession, path: str, encoder: Callable[[str], Column], block: int = 1024,
               validation_pct: float = 5.0, max_train_samples: int | None = None,
               max_validation_samples: int | None = None, group_rows: int = 1000) -> dict[str, DataFrame]:
    """Read (S7) -> head split (B1) -> encode (P12) -> pack (B10) -> cap
    (B2, counted in packed blocks), for ``train`` and ``validation``.

    The numbered lines are read and encoded once, into a keyed table; the
    cut is round-half-even(n * pct / 100) of its row count."""
    lines = materialize(read_lm(spark, path).select("line_no", encoder("text").alias("ids")), "encoded")
    cut = F.bround(F.lit(lines.count()) * F.lit(validation_pct) / 100.0, 0).cast("long")  # row count from file metadata
    parts = {"validation": lines.where(F.col("line_no") <= cut).withColumn("pos", F.col("line_no")),
             "train": lines.where(F.col("line_no") > cut).withColumn("pos", F.col("line_no") - cut)}
    caps = {"validation": max_validation_samples, "train": max_train_samples}
    out = {}
    for name, rows in parts.items():
        packed = C.pack_blocks(rows, block, group_rows, group=(), pos="pos", ids="ids")
        out[name] = packed if caps[name] is None else C.limit_head(block_positions(packed), caps[name], pos="block_pos")
    return out


# ---------------------------------------------------------------------------
# Evaluation and run analysis
# ---------------------------------------------------------------------------
def evaluate_systems(seg: DataFrame, hyp: str = "hyp", ref: str = "ref", keys=("system",), with_ter: bool = True) -> DataFrame:
    """Strip both sides (P1), then accuracy, edit distance, WER, BLEU,
    chrF and TER per system.  Compare two systems with
    ``metrics.significance_bleu`` and its like (A15)."""
    keys = list(keys)
    clean = seg.select(*keys, py_strip(hyp).alias("hyp"), py_strip(ref).alias("ref"))
    out = M.evaluate(clean, keys=keys)
    return out.join(M.ter(clean, keys=keys).select(*keys, "ter"), keys) if with_ter else out


def analyze_run(vlog: DataFrame, patience: int = 10, metric: str = "bleu", keys=R.KEYS, step: str = "step") -> DataFrame:
    """Running best (W4) -> stall counter (W5) -> stop step (W6, NULL if
    never) -> best checkpoint (W7), per run and task, in one aggregation:
    the best checkpoint is the last improving evaluation."""
    s = R.stall_counter(vlog, metric, keys, step)
    return s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_evals"),
        F.max("best").alias("best"),
        F.max(F.when(F.col("improved"), F.col(step))).alias("best_step"),
        F.min(F.when(F.col("stall") == patience, F.col(step))).alias("stop_step"),
        F.max_by("stall", step).alias("final_stall"))
