"""Sentence-pair filters.

Cheap native predicates always run before the Arrow UDF (Catalyst does not
know the UDF's cost): ``filter_similarity`` rejects on exact length bounds
first, so the LCS kernel only sees pairs that can still pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import indel_ratio
from ..functions.text import squeeze_spaces
from ..session import pin


def clean_pairs(df: DataFrame, min_len: int, max_len: int, ratio: float = 9.0,
                src: str = "source", tgt: str = "target", max_word_len: int | None = None) -> DataFrame:
    """corpus cleaning in the manner of the Moses ``clean-corpus-n`` script.

    Whitespace is squeezed, pairs with an empty side are dropped (F5), both
    sides must have between ``min_len`` and ``max_len`` words, and neither
    side may be more than ``ratio`` times longer (in words) than the other.
    The squeezed text is returned.
    """
    out = pin(df, **{src: squeeze_spaces(src), tgt: squeeze_spaces(tgt)}).select(*df.columns)
    ns = F.size(F.split(F.col(src), " ", -1))
    nt = F.size(F.split(F.col(tgt), " ", -1))
    cond = ((F.col(src) != "") & (F.col(tgt) != "")
            & ns.between(min_len, max_len) & nt.between(min_len, max_len)
            & (ns <= nt * F.lit(ratio)) & (nt <= ns * F.lit(ratio)))
    if max_word_len is not None:
        longest = lambda c: F.array_max(F.transform(F.split(F.col(c), " ", -1), lambda w: F.length(w)))
        cond = cond & (longest(src) <= max_word_len) & (longest(tgt) <= max_word_len)
    return out.where(cond)


def drop_empty(df: DataFrame, src: str = "source", tgt: str = "target") -> DataFrame:
    """drop pairs with an empty side."""
    return df.where((F.col(src) != "") & (F.col(tgt) != ""))


def similarity_prefilter(a: Column, b: Column, lo: float, hi: float) -> Column:
    """Exact native rejections of ``lo <= indel_ratio(a, b) <= hi``:
    the length bound 2*min(m,n)/(m+n) < lo, and equal strings (ratio 1.0)
    when hi < 1."""
    m, n = F.char_length(a), F.char_length(b)
    keep = F.lit(True)
    if lo > 0:
        keep = keep & ~((m + n > 0) & (2.0 * F.least(m, n) < F.lit(lo) * (m + n)))
    if hi < 1:
        keep = keep & (a != b)
    return keep


def filter_similarity(df: DataFrame, lo: float = 0.25, hi: float = 0.99, src: str = "source",
                      tgt: str = "target", ratio_col: str | None = "ratio") -> DataFrame:
    """keep pairs whose lower-cased Indel ratio lies in [lo, hi]."""
    a, b = F.lower(F.col(src)), F.lower(F.col(tgt))
    pre = df.where(similarity_prefilter(a, b, lo, hi))
    name = ratio_col or "__ratio"
    # the band is applied to the pinned result, else the filter would run the UDF once more
    scored = pin(pre.withColumn(name, indel_ratio(a, b)), **{name: F.col(name)})
    out = scored.where(F.col(name).between(lo, hi))
    return out if ratio_col else out.drop(name)


def filter_language(df: DataFrame, labels: DataFrame, expected: str = "__label__es",
                    keys=("doc_id", "line_no"), label_col: str = "label") -> DataFrame:
    """keep pairs whose source-side language label equals ``expected``.

    The labels (one per source line) are joined by position; pushing the
    ``label = expected`` predicate into the label side keeps the join small.
    """
    lab = labels.where(F.col(label_col) == expected).select(*keys)
    return df.join(lab, list(keys), "left_semi")


def filter_max_tokens(df: DataFrame, n: int = 100, src_ids: str = "src_ids",
                      tgt_ids: str = "tgt_ids") -> DataFrame:
    """drop pairs with more than ``n`` tokens on either side."""
    # the bounds are put on the pinned ids, else an encoder would run for them once more, on the lines without a partner too
    ids = pin(df, **{c: F.col(c) for c in (src_ids, tgt_ids)}).select(*df.columns)
    return ids.where((F.size(src_ids) <= n) & (F.size(tgt_ids) <= n))
