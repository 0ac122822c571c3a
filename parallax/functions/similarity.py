"""String similarity: Indel ratio (U1), character and word edit distance.

* ``indel_ratio`` is 2*LCS/(m+n) (1.0 when both strings are empty), the
  "ratio" of the common Levenshtein libraries: insertions and deletions cost
  1, a substitution costs 2.  Spark has no LCS expression, so it runs as an
  Arrow (pandas) UDF: a bit-parallel LCS over bit sets of as many 64-bit
  words as the shorter string needs, vectorised with numpy over slices of
  the Arrow batch whose size is bounded.
* Character edit distance is Spark's built-in ``levenshtein``.
* Word edit distance maps the distinct words of one pair to single code
  points and reuses the built-in ``levenshtein``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._col import as_col
from .text import JAVA_WS_CLASS, py_strip


# --------------------------------------------------------------------------
# pure-Python kernels (also used by tests as the brute-force reference)
# --------------------------------------------------------------------------
def lcs_length(a, b) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if len(a) == 0 or len(b) == 0:
        return 0
    if len(a) < len(b):
        a, b = b, a
    masks: dict = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & masks.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - bin(s).count("1")


def indel_ratio_py(a: str, b: str) -> float:
    total = len(a) + len(b)
    if total == 0:
        return 1.0
    return 2.0 * lcs_length(a, b) / total


def match_bits(a) -> dict:
    """For each symbol of a sequence the set of its places, as bits."""
    peq: dict = {}
    for i, x in enumerate(a):
        peq[x] = peq.get(x, 0) | (1 << i)
    return peq


def edit_distance(a, b) -> int:
    """Levenshtein distance (unit costs) over any two sequences, bit-parallel."""
    if len(a) < len(b):
        a, b = b, a
    return edits_to(match_bits(a), len(a), b)


def edits_to(peq: dict, m: int, b) -> int:
    """Levenshtein distance of ``b`` to the sequence of ``m`` symbols whose places are ``peq``."""
    if m == 0 or len(b) == 0:
        return max(m, len(b))
    full = (1 << m) - 1
    top = 1 << (m - 1)
    pv, mv, score = full, 0, m
    for y in b:
        eq = peq.get(y, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) & full) ^ pv) | eq
        ph = (mv | ~(xh | pv)) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ((ph << 1) | 1) & full
        mh = (mh << 1) & full
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
    return score


# --------------------------------------------------------------------------
# vectorised LCS
# --------------------------------------------------------------------------
#: most 64-bit words of match tables, and most code points of the other side, held at once (or one pair's)
TABLE_WORDS, SLICE_CHARS = 1 << 21, 1 << 21
#: longest shorter side of the pairs that run together; Python's whole numbers hold the bits of longer ones
LANE = 64


def _codes(strings) -> np.ndarray:
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _lcs_slice(short, long, ls: np.ndarray, ll: np.ndarray) -> np.ndarray:
    """LCS of a slice of pairs; ``short`` sides become bit sets."""
    n, words = len(short), (int(ls.max()) + 63) // 64
    alphabet, code = np.unique(_codes(short), return_inverse=True)
    k = len(alphabet) + 1  # the last symbol matches nothing
    row = np.repeat(np.arange(n), ls)
    at = np.arange(len(code)) - np.repeat(np.cumsum(ls) - ls, ls)
    table = np.zeros(n * k * words, np.uint64)
    np.add.at(table, (row * k + code) * words + at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
    table = table.reshape(n * k, words)
    other = _codes(long)
    where = np.minimum(np.searchsorted(alphabet, other), len(alphabet) - 1)
    symbol = np.where(alphabet[where] == other, where, k - 1)
    grid = np.full((int(ll.max()), n), k - 1, np.int64)
    grid[np.arange(len(other)) - np.repeat(np.cumsum(ll) - ll, ll), np.repeat(np.arange(n), ll)] = symbol
    grid += np.arange(n) * k
    bits = np.clip(ls[:, None] - 64 * np.arange(words), 0, 64).astype(np.uint64)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    full = np.where(bits == 64, ones, (np.uint64(1) << (bits % np.uint64(64))) - np.uint64(1))
    full, state = full.T.copy(), full.T.copy()
    with np.errstate(over="ignore"):
        for line in grid:
            match = table[line].T
            carry = np.zeros(n, np.uint64)
            for w in range(words):
                s, m = state[w], match[w]
                total = s + (s & m)
                more = total + carry
                carry = ((total < s) | (more < total)).astype(np.uint64)
                state[w] = (more | (s & ~m)) & full[w]
    return ls - np.bitwise_count(state).sum(axis=0).astype(np.int64)


def lcs_lengths(a: pd.Series, b: pd.Series) -> np.ndarray:
    """LCS lengths of a batch; pairs of like size run together, each pair of more than ``LANE`` code points a side by itself."""
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a.fillna("").tolist(), b.fillna("").tolist())]
    ls = np.fromiter((len(x) for x, _ in pairs), np.int64, len(pairs))
    ll = np.fromiter((len(y) for _, y in pairs), np.int64, len(pairs))
    out = np.zeros(len(pairs), np.int64)
    for i in np.flatnonzero(ls > LANE).tolist():
        out[i] = lcs_length(*pairs[i])
    order = np.argsort(ll, kind="stable")
    order = order[(ls[order] > 0) & (ls[order] <= LANE)]
    at = 0
    while at < len(order):
        stop, chars, letters = at, 0, set()
        while stop < len(order):
            i = order[stop]
            more = letters | set(pairs[i][0])
            rows = stop + 1 - at
            if rows > 1 and (rows * (len(more) + 1) * ((ls[i] + 63) // 64) > TABLE_WORDS or rows * ll[i] > SLICE_CHARS):
                break
            letters, stop = more, stop + 1
        some = order[at:stop]
        out[some] = _lcs_slice([pairs[i][0] for i in some], [pairs[i][1] for i in some], ls[some], ll[some])
        at = stop
    return out


@F.pandas_udf(T.DoubleType())
def _indel_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    a = a.fillna("")
    b = b.fillna("")
    total = a.str.len().to_numpy(dtype=np.float64) + b.str.len().to_numpy(dtype=np.float64)
    lcs = lcs_lengths(a, b).astype(np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.where(total == 0, 1.0, 2.0 * lcs / np.where(total == 0, 1.0, total))
    return pd.Series(r)


@F.pandas_udf(T.LongType())
def _lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(lcs_lengths(a, b))


def indel_ratio(a, b) -> Column:
    """2*LCS/(m+n); 1.0 when both are empty.  Arrow UDF."""
    return _indel_ratio_udf(as_col(a), as_col(b))


def lcs(a, b) -> Column:
    return _lcs_udf(as_col(a), as_col(b))


def indel_upper_bound(a, b) -> Column:
    """Exact upper bound of indel_ratio from lengths alone: 2*min/(m+n)."""
    m, n = F.char_length(as_col(a)), F.char_length(as_col(b))
    return F.when(m + n == 0, F.lit(1.0)).otherwise(2.0 * F.least(m, n) / (m + n))


# --------------------------------------------------------------------------
# edit distances
# --------------------------------------------------------------------------
def char_edit_distance(a, b) -> Column:
    """Levenshtein distance over characters (built-in)."""
    return F.levenshtein(as_col(a), as_col(b))


def wer_words(c) -> Column:
    """Words as the usual WER tool splits them: runs of 2+ whitespace become
    one space, both ends stripped, split on ' ', empty items dropped."""
    s = py_strip(F.regexp_replace(as_col(c), JAVA_WS_CLASS + "{2,}", " "))
    return F.filter(F.split(s, " ", -1), lambda w: w != "")


def _code_point(i: Column) -> Column:
    """The character numbered ``i`` (from 1), for any number of words: code
    points from U+0100 on, without the surrogate range."""
    c = i + F.lit(0xFF)
    c = F.when(c >= 0xD800, c + 0x800).otherwise(c)
    return F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")


def word_edit_distance(hyp_words: str, ref_words: str) -> Column:
    """Word-level Levenshtein distance between two array<string> columns: the
    pair's distinct words become single characters for the built-in
    ``levenshtein``."""
    hw, rw = F.col(hyp_words), F.col(ref_words)
    vocab = F.array_distinct(F.concat(hw, rw))
    text = lambda ws: F.array_join(F.transform(ws, lambda w: _code_point(F.array_position(vocab, w))), "")
    return F.levenshtein(text(hw), text(rw)).cast("long")
