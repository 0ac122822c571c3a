"""Corpus metrics.

Every metric is a sum of per-segment sufficient statistics followed by one
closed-form expression.  The statistics are computed where the segment is:
counts and edit distances with built-in expressions, n-gram matches (BLEU,
chrF) and TER shifts in Arrow UDFs that process a whole batch of segments
(``functions/ngrams.py``), or, with ``method="native"``, by a sort-merge
over the segment's own n-grams inside ``aggregate``.  Scoring therefore
shuffles nothing but one small partial-aggregate row per task and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import char_edit_distance, wer_words, word_edit_distance
from ..functions.text import alnum_tokens, remove_whitespace, words


def _cols(x):
    return [x] if isinstance(x, str) else list(x or [])


# ---------------------------------------------------------------------------
# simple corpus statistics
# ---------------------------------------------------------------------------
def token_stats(df: DataFrame, keys=(), ids: str = "ids") -> DataFrame:
    """A4: per group: lines, longest line in tokens, total tokens."""
    n = F.size(ids)
    return df.groupBy(*_cols(keys)).agg(F.count(F.lit(1)).alias("n_lines"),
                                        F.max(n).cast("long").alias("max_tokens"),
                                        F.sum(n).cast("long").alias("total_tokens"))


def corpus_stats(df: DataFrame, keys=("corpus",), src: str = "source", tgt: str = "target") -> DataFrame:
    """A5: sentence pairs and words per side for every sub-corpus."""
    return df.groupBy(*_cols(keys)).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.sum(F.size(words(src))).cast("long").alias("src_words"),
        F.sum(F.size(words(tgt))).cast("long").alias("tgt_words"))


def word_counts(df: DataFrame, text: str = "text", keys=()) -> DataFrame:
    """Alphanumeric token frequencies (the ``uniq -c`` table).

    A hot token is not a problem: the partial aggregate folds it per task
    before the shuffle."""
    return (df.select(*_cols(keys), F.explode(alnum_tokens(text)).alias("token"))
            .groupBy(*_cols(keys), "token").agg(F.count(F.lit(1)).alias("n")))


def vocab_size(df: DataFrame, sides=("source", "target"), approx: bool = False) -> DataFrame:
    """Distinct alphanumeric tokens per side."""
    by_side = F.array(*[F.struct(F.lit(s).alias("side"), alnum_tokens(s).alias("toks")) for s in sides])
    u = df.select(F.inline(by_side)).select("side", F.explode("toks").alias("tok"))  # one pass over the pairs
    agg = F.approx_count_distinct("tok") if approx else F.count_distinct("tok")
    return u.groupBy("side").agg(agg.cast("long").alias("n_vocab"))


# ---------------------------------------------------------------------------
# accuracy, edit distance, WER (A1-A3)
# ---------------------------------------------------------------------------
def pair_predictions(hyps: DataFrame, refs: DataFrame, keys=(), line_col: str = "line_no") -> DataFrame:
    """Every prediction with its reference by position, null where the
    reference file is shorter; surplus references are dropped."""
    return hyps.join(refs, [*_cols(keys), line_col], "left")


def accuracy(seg: DataFrame, hyp: str = "hyp", ref: str = "ref", keys=()) -> DataFrame:
    """A1: exact-match count / number of predictions.  A prediction without
    a reference (null) is counted and not correct; an empty input gives
    NULL."""
    return seg.groupBy(*_cols(keys)).agg(
        F.sum(F.coalesce(F.col(hyp) == F.col(ref), F.lit(False)).cast("long")).alias("n_correct"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("accuracy", F.round(F.try_divide(F.col("n_correct").cast("double"), F.col("n")), 6))


def mean_edit_distance(seg: DataFrame, hyp: str = "hyp", ref: str = "ref", keys=()) -> DataFrame:
    """A3: summed character Levenshtein distance over the number of
    predictions; one without a reference (null) is counted and adds nothing."""
    return seg.groupBy(*_cols(keys)).agg(
        F.sum(F.coalesce(char_edit_distance(hyp, ref), F.lit(0))).cast("long").alias("total_distance"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("mean_distance", F.round(F.try_divide(F.col("total_distance").cast("double"), F.col("n")), 6))


def wer(seg: DataFrame, hyp: str = "hyp", ref: str = "ref", keys=()) -> DataFrame:
    """A2: corpus word error rate = sum of word edits / sum of reference words."""
    w = seg.select(*_cols(keys), wer_words(hyp).alias("__hw"), wer_words(ref).alias("__rw"))
    w = w.select(*_cols(keys), F.size("__rw").alias("__nr"), word_edit_distance("__hw", "__rw").alias("__edits"))
    return w.groupBy(*_cols(keys)).agg(
        F.sum("__edits").cast("long").alias("edits"),
        F.sum("__nr").cast("long").alias("ref_words"),
    ).withColumn("wer", F.round(F.try_divide(F.col("edits").cast("double"), F.col("ref_words")), 6))


# ---------------------------------------------------------------------------
# n-gram statistics
# ---------------------------------------------------------------------------
def _word_grams(toks: Column, n: int) -> Column:
    k = F.size(toks) - n + 1
    return F.when(k > 0, F.transform(F.sequence(F.lit(1), k),
                                     lambda i: F.array_join(F.slice(toks, i, n), " "))) \
        .otherwise(F.array().cast("array<string>"))


def _char_grams(s: Column, chars: Column, n: int) -> Column:
    """n-grams of the characters of ``s``, zipped from their array and its
    n - 1 next shifts: no character is looked up by its place in a string,
    which only a walk from its start finds."""
    k = F.char_length(s) - n + 1
    shifts = F.arrays_zip(*[F.slice(chars, j + 1, k).alias(f"c{j}") for j in range(n)])
    return F.when(k > 0, F.transform(shifts, lambda x: F.concat(*[x[f"c{j}"] for j in range(n)]))) \
        .otherwise(F.array().cast("array<string>"))


def clipped_matches(hyp_grams: Column, ref_grams: Column) -> Column:
    """sum over distinct n-grams g of min(count_hyp(g), count_ref(g)).

    Sort-merge inside the row: tag both lists, sort (by ``sort_array``, whose
    order is compiled, not by a lambda), walk once with ``aggregate``.
    O(k log k) per segment, all in the JVM."""
    tagged = F.concat(F.transform(hyp_grams, lambda g: F.struct(g.alias("g"), F.lit(1).alias("h"))),
                      F.transform(ref_grams, lambda g: F.struct(g.alias("g"), F.lit(0).alias("h"))))
    zero = F.struct(F.lit(None).cast("string").alias("p"), F.lit(0).cast("long").alias("ch"),
                    F.lit(0).cast("long").alias("cr"), F.lit(0).cast("long").alias("acc"))

    def step(s, x):
        same = F.coalesce(x["g"] == s["p"], F.lit(False))
        return F.when(same, F.struct(s["p"].alias("p"), (s["ch"] + x["h"]).alias("ch"),
                                     (s["cr"] + 1 - x["h"]).alias("cr"), s["acc"].alias("acc"))) \
            .otherwise(F.struct(x["g"].alias("p"), x["h"].cast("long").alias("ch"),
                                (1 - x["h"]).cast("long").alias("cr"),
                                (s["acc"] + F.least(s["ch"], s["cr"])).alias("acc")))

    return F.aggregate(F.sort_array(tagged), zero, step, lambda s: s["acc"] + F.least(s["ch"], s["cr"]))


# 13a tokenizer of the common BLEU tool (public rules).  Fixed values.
TOK13A_REPLACE = [("<skipped>", ""), ("-\n", ""), ("\n", " "),
                  ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
TOK13A_REGEX = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]


def tokenize_13a(c) -> Column:
    s = F.col(c) if isinstance(c, str) else c
    for a, b in TOK13A_REPLACE:
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.concat(F.lit(" "), s, F.lit(" "))
    for pat, rep in TOK13A_REGEX:
        # more blanks around a blank would change no token: blanks are left alone
        s = F.regexp_replace(s, pat.replace(r" -\&", r"!-\&"), rep)
    return words(s)


BLEU_ORDER = 4
CHRF_ORDER = 6
CHRF_BETA = 2


def bleu_segment_stats(h_toks: str, r_toks: str) -> list[Column]:
    """Statistics from two token-array columns (tokenise in an earlier
    projection so the regex chain runs once per row)."""
    h, r = F.col(h_toks), F.col(r_toks)
    out = [F.size(h).cast("long").alias("sys_len"), F.size(r).cast("long").alias("ref_len")]
    for n in range(1, BLEU_ORDER + 1):
        out.append(F.greatest(F.size(h) - n + 1, F.lit(0)).cast("long").alias(f"total_{n}"))
        out.append(clipped_matches(_word_grams(h, n), _word_grams(r, n)).alias(f"match_{n}"))
    return out


def bleu_from_stats(prefix: str = "") -> Column:
    """Corpus BLEU (exp smoothing, brevity penalty, 0-100) from summed stats."""
    c = lambda name: F.col(prefix + name)
    any_match = sum((c(f"match_{n}") > 0).cast("int") for n in range(1, BLEU_ORDER + 1)) > 0
    zero_so_far = F.lit(0)
    logs = []
    for n in range(1, BLEU_ORDER + 1):
        tot, m = c(f"total_{n}").cast("double"), c(f"match_{n}").cast("double")
        zero_so_far = zero_so_far + (c(f"match_{n}") == 0).cast("int")
        prec = F.when(tot == 0, F.lit(0.0)) \
            .when(m == 0, 100.0 / (F.pow(F.lit(2.0), zero_so_far) * tot)) \
            .otherwise(100.0 * m / tot)
        logs.append(F.when(prec == 0, F.lit(-9999999999.0)).otherwise(F.log(prec)))
    sys_len, ref_len = c("sys_len").cast("double"), c("ref_len").cast("double")
    bp = F.when(sys_len >= ref_len, F.lit(1.0)).when(sys_len == 0, F.lit(0.0)) \
        .otherwise(F.exp(1.0 - ref_len / sys_len))
    score = bp * F.exp(sum(logs) / BLEU_ORDER)
    return F.when(any_match, score).otherwise(F.lit(0.0))


def _bleu_udf_stats(h_toks: str, r_toks: str) -> list:
    from ..functions.ngrams import word_ngram_stats
    a = word_ngram_stats(F.col(h_toks), F.col(r_toks))
    names = ["sys_len", "ref_len"] + [f"{x}_{n}" for n in range(1, BLEU_ORDER + 1) for x in ("total", "match")]
    return [a, names]


def _chrf_udf_stats(h: str, r: str) -> list:
    from ..functions.ngrams import char_ngram_stats
    a = char_ngram_stats(F.col(h), F.col(r))
    names = [f"{x}_{n}" for n in range(1, CHRF_ORDER + 1) for x in ("hyp", "ref", "match")]
    return [a, names]


def _expand(df: DataFrame, keys, arr: Column, names: list[str], prefix: str = "") -> DataFrame:
    tmp = df.select(*keys, arr.alias("__s"))
    return tmp.select(*keys, *[F.col("__s")[i].alias(prefix + n) for i, n in enumerate(names)])


def bleu(seg: DataFrame, hyp: str = "hyp", ref: str = "ref", keys=(), method: str = "udf") -> DataFrame:
    """Corpus BLEU per group of ``keys``.

    ``method="udf"`` counts n-grams per segment in an Arrow UDF (default);
    ``method="native"`` uses the in-row sort-merge built-in expression."""
    toks = seg.select(*_cols(keys), tokenize_13a(hyp).alias("__h"), tokenize_13a(ref).alias("__r"))
    if method == "udf":
        arr, names = _bleu_udf_stats("__h", "__r")
        stats = _expand(toks, _cols(keys), arr, names)
    else:
        stats = toks.select(*_cols(keys), *bleu_segment_stats("__h", "__r"))
    names = [c for c in stats.columns if c not in _cols(keys)]
    agg = stats.groupBy(*_cols(keys)).agg(*[F.sum(n).cast("long").alias(n) for n in names])
    return agg.select(*_cols(keys), "sys_len", "ref_len", F.round(bleu_from_stats(), 6).alias("bleu"))


def _no_ws(c: str) -> Column:
    return remove_whitespace(c)


def chrf_segment_stats(h_chars: str, r_chars: str, h_array: str, r_array: str) -> list[Column]:
    """Statistics from two whitespace-free string columns and the arrays of
    their characters (cut in an earlier projection, once for all orders)."""
    h, r = F.col(h_chars), F.col(r_chars)
    out = []
    for n in range(1, CHRF_ORDER + 1):
        out.append(F.greatest(F.char_length(h) - n + 1, F.lit(0)).cast("long").alias(f"hyp_{n}"))
        out.append(F.greatest(F.char_length(r) - n + 1, F.lit(0)).cast("long").alias(f"ref_{n}"))
        out.append(clipped_matches(_char_grams(h, F.col(h_array), n), _char_grams(r, F.col(r_array), n)).alias(f"match_{n}"))
    return out


def chrf_from_stats(prefix: str = "") -> Column:
    """chrF (beta 2, char order 6, no word n-grams) from summed statistics:
    average precision and recall over orders where both sides have n-grams."""
    eff = F.lit(0)
    sp, sr = F.lit(0.0), F.lit(0.0)
    for n in range(1, CHRF_ORDER + 1):
        h, r = F.col(f"{prefix}hyp_{n}"), F.col(f"{prefix}ref_{n}")
        m = F.col(f"{prefix}match_{n}").cast("double")
        ok = (h > 0) & (r > 0)
        eff = eff + ok.cast("int")
        sp = sp + F.when(ok, m / h).otherwise(0.0)
        sr = sr + F.when(ok, m / r).otherwise(0.0)
    p = F.when(eff == 0, F.lit(0.0)).otherwise(sp / eff)
    r = F.when(eff == 0, F.lit(0.0)).otherwise(sr / eff)
    f2 = CHRF_BETA ** 2
    return F.when(p + r > 0, 100.0 * (1 + f2) * p * r / (f2 * p + r)).otherwise(F.lit(0.0))


def chrf(seg: DataFrame, hyp: str = "hyp", ref: str = "ref", keys=(), method: str = "udf") -> DataFrame:
    """Corpus chrF per group of ``keys``."""
    chars = seg.select(*_cols(keys), _no_ws(hyp).alias("__h"), _no_ws(ref).alias("__r"))
    if method == "udf":
        arr, names = _chrf_udf_stats("__h", "__r")
        stats = _expand(chars, _cols(keys), arr, names)
    else:
        cut = chars.withColumns({"__ha": F.split("__h", ""), "__ra": F.split("__r", "")})
        stats = cut.select(*_cols(keys), *chrf_segment_stats("__h", "__r", "__ha", "__ra"))
    names = [c for c in stats.columns if c not in _cols(keys)]
    agg = stats.groupBy(*_cols(keys)).agg(*[F.sum(n).cast("long").alias(n) for n in names])
    return agg.select(*_cols(keys), F.round(chrf_from_stats(), 6).alias("chrf"))


def metrics_by_task(seg: DataFrame, hyp: str = "hyp", ref: str = "ref", keys=("task",)) -> DataFrame:
    """BLEU and chrF once per task, from one pass of statistics."""
    k = _cols(keys)
    pre = seg.select(*k, tokenize_13a(hyp).alias("__h"), tokenize_13a(ref).alias("__r"),
                     _no_ws(hyp).alias("__hc"), _no_ws(ref).alias("__rc"))
    barr, bnames = _bleu_udf_stats("__h", "__r")
    carr, cnames = _chrf_udf_stats("__hc", "__rc")
    tmp = pre.select(*k, barr.alias("__b"), carr.alias("__c"))
    stats = tmp.select(*k, *[F.col("__b")[i].alias("b_" + n) for i, n in enumerate(bnames)],
                       *[F.col("__c")[i].alias("c_" + n) for i, n in enumerate(cnames)])
    names = [c for c in stats.columns if c not in k]
    agg = stats.groupBy(*k).agg(*[F.sum(n).cast("long").alias(n) for n in names])
    return agg.select(*k, F.col("b_sys_len").alias("sys_len"), F.col("b_ref_len").alias("ref_len"),
                      F.round(bleu_from_stats("b_"), 6).alias("bleu"),
                      F.round(chrf_from_stats("c_"), 6).alias("chrf"))


def ter(seg: DataFrame, hyp: str = "hyp", ref: str = "ref", keys=()) -> DataFrame:
    """A10: translation edit rate = sum(edits incl. shifts) / sum(ref words)
    x 100, per group.  Shift search runs per segment in an Arrow UDF."""
    from ..functions.ter import ter_stats
    k = _cols(keys)
    st = seg.select(*k, ter_stats(F.col(hyp), F.col(ref)).alias("__t"))
    agg = st.groupBy(*k).agg(F.sum(F.col("__t")[0]).cast("long").alias("edits"),
                             F.sum(F.col("__t")[1]).cast("long").alias("ref_words"))
    score = F.when(F.col("ref_words") > 0, 100.0 * F.col("edits") / F.col("ref_words")) \
        .otherwise(F.when(F.col("edits") > 0, F.lit(100.0)).otherwise(F.lit(0.0)))
    return agg.withColumn("ter", F.round(score, 6))


def evaluate(seg: DataFrame, hyp: str = "hyp", ref: str = "ref", keys=("system",)) -> DataFrame:
    """Accuracy, mean edit distance, WER, BLEU and chrF per group, from
    one projection of per-segment statistics and one aggregation."""
    k = _cols(keys)
    pre = seg.select(*k, (F.col(hyp) == F.col(ref)).cast("long").alias("__eq"),
                     char_edit_distance(hyp, ref).cast("long").alias("__ed"),
                     wer_words(hyp).alias("__hw"), wer_words(ref).alias("__rw"),
                     tokenize_13a(hyp).alias("__h"), tokenize_13a(ref).alias("__r"),
                     _no_ws(hyp).alias("__hc"), _no_ws(ref).alias("__rc"))
    pre = pre.withColumn("__we", word_edit_distance("__hw", "__rw"))
    barr, bnames = _bleu_udf_stats("__h", "__r")
    carr, cnames = _chrf_udf_stats("__hc", "__rc")
    st = pre.select(*k, "__eq", "__ed", "__we", F.size("__rw").cast("long").alias("__nr"),
                    barr.alias("__b"), carr.alias("__c"))
    st = st.select(*k, "__eq", "__ed", "__we", "__nr",
                   *[F.col("__b")[i].alias("b_" + n) for i, n in enumerate(bnames)],
                   *[F.col("__c")[i].alias("c_" + n) for i, n in enumerate(cnames)])
    sums = [c for c in st.columns if c not in k]
    agg = st.groupBy(*k).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).cast("long").alias(c) for c in sums])
    div = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b)), 6)
    return agg.select(*k, "n", F.col("__eq").alias("n_correct"), div("__eq", "n").alias("accuracy"),
                      F.col("__ed").alias("total_distance"), div("__ed", "n").alias("mean_distance"),
                      F.col("__we").alias("edits"), F.col("__nr").alias("ref_words"), div("__we", "__nr").alias("wer"),
                      F.col("b_sys_len").alias("sys_len"), F.col("b_ref_len").alias("ref_len"),
                      F.round(bleu_from_stats("b_"), 6).alias("bleu"), F.round(chrf_from_stats("c_"), 6).alias("chrf"))


# ---------------------------------------------------------------------------
# LM metrics
# ---------------------------------------------------------------------------
def perplexity(df: DataFrame, loss: str = "loss", keys=()) -> DataFrame:
    """exp(mean loss); overflow gives +Infinity, as in the reference."""
    return df.groupBy(*_cols(keys)).agg(F.count(F.lit(1)).alias("n"),
                                        F.exp(F.avg(loss)).alias("perplexity"))


def token_accuracy(df: DataFrame, pred: str, label: str, keys=()) -> DataFrame:
    """Next-token accuracy over shifted arrays; every position counts."""
    n = F.greatest(F.size(label) - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(pred, 1, F.greatest(n, F.lit(1))).alias("p"),
                         F.slice(label, 2, F.greatest(n, F.lit(1))).alias("l"))
    pairs = F.when(n > 0, pairs)
    correct = F.coalesce(F.size(F.filter(pairs, lambda x: x["p"] == x["l"])), F.lit(0))
    return df.groupBy(*_cols(keys)).agg(
        F.sum(n).cast("long").alias("n_positions"),
        F.sum(correct).cast("long").alias("n_correct"),
    ).withColumn("accuracy", F.round(F.try_divide(F.col("n_correct").cast("double"), F.col("n_positions")), 6))


# ---------------------------------------------------------------------------
# significance
# ---------------------------------------------------------------------------
COIN_BITS = 60  # coins drawn from one md5: its first 15 hex digits


def coin_word(seed: int, seg: Column, block: Column) -> Column:
    """60 portable random bits for (seed, segment, block of 60 trials): the
    first 15 hex digits of md5('seed-seg-block') as a BIGINT.  Identical in
    any engine with md5, so the test has an exact SQL oracle."""
    key = F.concat_ws("-", F.lit(str(seed)), seg.cast("string"), block.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def _swapped_sums(rows: DataFrame, width: int, trials: int, seed: int) -> DataFrame:
    """``rows(seg string, a array<double>, b array<double>)`` -> a row per
    trial with the summed differences ``b - a`` of the segments it swaps.

    Folded by numpy inside each task: a slice of segments gives a matrix of
    coins, whose product with the differences is added to one (trials x
    width) table; only that table leaves the task."""
    import numpy as np
    import pandas as pd

    from ..functions.coins import coins

    def fold(batches):
        total = np.zeros((width, trials))
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at:at + 256]
                diff = np.stack(part["b"].to_numpy()) - np.stack(part["a"].to_numpy())
                some = np.flatnonzero(diff.any(axis=0))  # such as the reference's counts, which no swap changes, add nothing
                if len(some):
                    total[some] += diff[:, some].T @ coins(part["seg"], trials, seed).astype(np.float64)
        yield pd.DataFrame({"trial": np.arange(1, trials + 1), **{f"d{i}": total[i] for i in range(width)}})

    cols = [f"d{i}" for i in range(width)]
    # small rows, dear work (a hash for every 60 trials): dealt evenly, not coalesced by size
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = rows.mapInPandas(fold, "trial int, " + ", ".join(f"{c} double" for c in cols))
    return parts.groupBy("trial").agg(*[F.sum(c).alias(c) for c in cols])


def significance(segments: DataFrame, names: list[str], score, a: str = "a", b: str = "b", seg: str = "seg_id",
                 trials: int = 10000, seed: int = 12345, rounded: int | None = None) -> DataFrame:
    """A15 on any metric of summed statistics: paired approximate randomisation.

    ``segments`` has a row per segment with the statistics of both systems
    as arrays ``a`` and ``b`` in the order of ``names``; ``score(prefix)`` is
    the metric over summed columns ``prefix + name``.  In trial t segment s
    swaps its two vectors when bit (t-1) mod 60 of coin_word(seed, s, (t-1)
    div 60) is set; the trial statistic is |score(A') - score(B')|, the
    observed one |score(A) - score(B)|, and p = (#trials with a statistic >=
    the observed one + 1) / (trials + 1).  Sums of whole numbers are exact
    below 2^53.  ``rounded`` rounds ``observed`` in the result."""
    rows = segments.select(F.col(seg).cast("string").alias("seg"), F.col(a).cast("array<double>").alias("a"),
                           F.col(b).cast("array<double>").alias("b"))
    sums = rows.agg(*[F.sum(F.col(x)[i]).alias(f"{x}_{n}") for x in "ab" for i, n in enumerate(names)])
    observed = sums.select(F.abs(score("a_") - score("b_")).alias("o"), *sums.columns)
    whole = observed.select(F.struct(*observed.columns)).scalar()  # scalar subquery
    per = _swapped_sums(rows, len(names), trials, seed).withColumn("__t", whole)
    per = per.select("__t", *[(F.col(f"__t.a_{n}") + F.col(f"d{i}")).alias(f"a_{n}") for i, n in enumerate(names)],
                     *[(F.col(f"__t.b_{n}") - F.col(f"d{i}")).alias(f"b_{n}") for i, n in enumerate(names)])
    per = per.select(F.col("__t.o").alias("observed"), F.abs(score("a_") - score("b_")).alias("d"))
    shown = F.max("observed") if rounded is None else F.round(F.max("observed"), rounded)
    return per.agg(F.lit(trials).cast("long").alias("trials"), shown.alias("observed"),
                   F.sum((F.col("d") >= F.col("observed") - 1e-9).cast("long")).alias("n_extreme")) \
        .withColumn("p_value", F.round((F.col("n_extreme") + 1) / F.lit(trials + 1), 6))


def paired_randomization(stats: DataFrame, a: str, b: str, seg: str = "seg_id",
                         trials: int = 10000, seed: int = 12345) -> DataFrame:
    """A15 on an additive statistic: one number per segment and system."""
    rows = stats.select(F.col(seg).alias("seg"), F.array(F.col(a)).alias("a"), F.array(F.col(b)).alias("b"))
    return significance(rows, ["sum"], lambda p: F.col(p + "sum"), seg="seg", trials=trials, seed=seed)


def _system_stats(seg: DataFrame, hyp_a: str, hyp_b: str, ref: str, key: str, prepare, stats) -> tuple[DataFrame, list[str]]:
    """Statistic arrays of two systems against one reference."""
    pre = seg.select(F.col(key).alias("seg"), *[prepare(c).alias(n) for c, n in ((hyp_a, "__x"), (hyp_b, "__y"), (ref, "__r"))])
    (x, names), (y, _) = stats("__x", "__r"), stats("__y", "__r")
    return pre.select("seg", x.alias("a"), y.alias("b")), names


def significance_bleu(seg: DataFrame, hyp_a: str = "hyp_a", hyp_b: str = "hyp_b", ref: str = "ref", key: str = "seg_id",
                      trials: int = 10000, seed: int = 12345) -> DataFrame:
    """A15 on BLEU."""
    rows, names = _system_stats(seg, hyp_a, hyp_b, ref, key, tokenize_13a, _bleu_udf_stats)
    return significance(rows, names, bleu_from_stats, seg="seg", trials=trials, seed=seed, rounded=6)


def significance_chrf(seg: DataFrame, hyp_a: str = "hyp_a", hyp_b: str = "hyp_b", ref: str = "ref", key: str = "seg_id",
                      trials: int = 10000, seed: int = 12345) -> DataFrame:
    """A15 on chrF."""
    rows, names = _system_stats(seg, hyp_a, hyp_b, ref, key, _no_ws, _chrf_udf_stats)
    return significance(rows, names, chrf_from_stats, seg="seg", trials=trials, seed=seed, rounded=6)


def _ter_from_stats(p: str) -> Column:
    return F.when(F.col(p + "ref") > 0, 100.0 * F.col(p + "edits") / F.col(p + "ref")).otherwise(
        F.when(F.col(p + "edits") > 0, F.lit(100.0)).otherwise(F.lit(0.0)))


def significance_ter(seg: DataFrame, hyp_a: str = "hyp_a", hyp_b: str = "hyp_b", ref: str = "ref", key: str = "seg_id",
                     trials: int = 10000, seed: int = 12345) -> DataFrame:
    """A15 on TER."""
    from ..functions.ter import ter_stats
    from ..session import materialize
    rows = seg.select(F.col(key).alias("seg"), ter_stats(F.col(hyp_a), F.col(ref)).alias("a"), ter_stats(F.col(hyp_b), F.col(ref)).alias("b"))
    rows = materialize(rows, "segments")  # read for the totals and for the trials, searched once
    return significance(rows, ["edits", "ref"], _ter_from_stats, seg="seg", trials=trials, seed=seed, rounded=6)


#: systems that one comparison holds: all pairs of them are tested
MAX_SYSTEMS = 20


def compare_systems(seg: DataFrame, hyp: str = "hyp", ref: str = "ref", system: str = "system", key: str = "seg_id",
                    metrics=("bleu", "chrf", "ter"), trials: int = 10000, seed: int = 12345) -> DataFrame:
    """X8 with A15: every pair of systems on every metric, from one fold.

    ``seg`` has a row for each system and segment.  Rows (metric, system_a,
    system_b, score_a, score_b, trials, observed, n_extreme, p_value), system_a
    before system_b.  The coins of a segment and trial serve all pairs and
    metrics, so each test equals :func:`significance` of that pair.  Segments
    that a system lacks are left out for all; a segment given twice for a
    system is an error."""
    from ..functions.ter import ter_stats
    names = [r[0] for r in seg.select(system).where(F.col(system).isNotNull()).distinct().orderBy(system).limit(MAX_SYSTEMS + 1).collect()]
    if len(names) > MAX_SYSTEMS:
        raise ValueError(f"more than {MAX_SYSTEMS} systems")
    pre = seg.where(F.col(system).isNotNull()).select(
        F.col(key).cast("string").alias("seg"), F.col(system).alias("__s"), tokenize_13a(hyp).alias("__h"), tokenize_13a(ref).alias("__r"),
        _no_ws(hyp).alias("__hc"), _no_ws(ref).alias("__rc"), F.col(hyp).alias("__ht"), F.col(ref).alias("__rt"))
    of = {"bleu": (*_bleu_udf_stats("__h", "__r"), bleu_from_stats), "chrf": (*_chrf_udf_stats("__hc", "__rc"), chrf_from_stats),
          "ter": (ter_stats(F.col("__ht"), F.col("__rt")), ["edits", "ref"], _ter_from_stats)}
    if len(names) < 2:
        return seg.sparkSession.createDataFrame([], "metric string, system_a string, system_b string, score_a double, score_b double, "
                                                    "trials long, observed double, n_extreme long, p_value double")
    used = [(m, *of[m]) for m in metrics]
    stats = pre.select("seg", "__s", F.concat(*[F.transform(c, lambda x: x.cast("double")) for _, c, _, _ in used]).alias("v"))
    per = stats.groupBy("seg").agg(*[F.collect_list(F.when(F.col("__s") == n, F.col("v"))).alias(f"s{i}") for i, n in enumerate(names)])
    twice = F.greatest(*[F.size(f"s{i}") for i in range(len(names))]) > 1
    per = per.where(F.least(*[F.size(f"s{i}") for i in range(len(names))]) >= 1)
    per = per.select("seg", *[F.when(twice, F.raise_error(F.lit("a segment is there twice for a system")).cast("array<double>")).otherwise(F.col(f"s{i}")[0]).alias(f"s{i}")
                              for i in range(len(names))])
    from ..session import materialize
    per = materialize(per, "systems")
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    flat = [(m, n) for m, _, cols, _ in used for n in cols]
    # differences from the first system; those of other pairs are theirs, exact for whole numbers
    rows = per.select("seg", F.concat(*["s0"] * (len(names) - 1)).alias("a"), F.concat(*[f"s{i}" for i in range(1, len(names))]).alias("b"))
    total = per.agg(*[F.sum(F.col(f"s{i}")[k]).alias(f"t{i}_{m}_{n}") for i in range(len(names)) for k, (m, n) in enumerate(flat)])
    whole = total.select(F.struct(*total.columns)).scalar()
    trial = _swapped_sums(rows, (len(names) - 1) * len(flat), trials, seed).withColumn("__t", whole)
    sums = {}
    swapped = lambda i, k: F.col(f"d{(i - 1) * len(flat) + k}")
    for q, (i, j) in enumerate(pairs):
        for k, (m, n) in enumerate(flat):
            d = swapped(j, k) - swapped(i, k) if i else swapped(j, k)
            sums |= {f"a{q}_{m}_{n}": F.col(f"__t.t{i}_{m}_{n}") + d, f"b{q}_{m}_{n}": F.col(f"__t.t{j}_{m}_{n}") - d}
    trial = trial.select(*[F.col(f"__t.{c}").alias(c) for c in total.columns], *[e.alias(c) for c, e in sums.items()])
    tests = [F.struct(F.lit(m).alias("metric"), F.lit(names[i]).alias("system_a"), F.lit(names[j]).alias("system_b"),
                      score(f"t{i}_{m}_").alias("score_a"), score(f"t{j}_{m}_").alias("score_b"),
                      F.abs(score(f"a{q}_{m}_") - score(f"b{q}_{m}_")).alias("d")) for q, (i, j) in enumerate(pairs) for m, _, _, score in used]
    each = trial.select(F.explode(F.array(*tests)).alias("x")).select("x.*").withColumn("observed", F.abs(F.col("score_a") - F.col("score_b")))
    out = each.groupBy("metric", "system_a", "system_b").agg(
        F.round(F.max("score_a"), 6).alias("score_a"), F.round(F.max("score_b"), 6).alias("score_b"), F.lit(trials).cast("long").alias("trials"),
        F.round(F.max("observed"), 6).alias("observed"), F.sum((F.col("d") >= F.col("observed") - 1e-9).cast("long")).alias("n_extreme"))
    return out.withColumn("p_value", F.round((F.col("n_extreme") + 1) / F.lit(trials + 1), 6))
