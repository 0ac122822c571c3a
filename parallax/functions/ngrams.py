"""Per-segment n-gram statistics as Arrow UDFs.

BLEU and chrF need, per segment and n-gram order, the clipped match count
sum_g min(count_hyp(g), count_ref(g)).  Counting inside the row keeps the
work local to the task that holds the segment: nothing is exploded into
rows and nothing is shuffled except the final per-group sums.  Tokenisation
(regexes) stays in the JVM; only the counting runs in Python.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _clipped(h, r, n: int) -> int:
    if len(h) < n or len(r) < n:
        return 0
    if n == 1:
        hc, rc = Counter(h), Counter(r)
    else:
        hc = Counter(zip(*[h[i:] for i in range(n)]))
        rc = Counter(zip(*[r[i:] for i in range(n)]))
    if len(rc) < len(hc):
        hc, rc = rc, hc
    return sum(min(c, rc[g]) for g, c in hc.items() if g in rc)


def _char_clipped(h: str, r: str, n: int) -> int:
    if len(h) < n or len(r) < n:
        return 0
    hc = Counter(h[i:i + n] for i in range(len(h) - n + 1))
    rc = Counter(r[i:i + n] for i in range(len(r) - n + 1))
    if len(rc) < len(hc):
        hc, rc = rc, hc
    return sum(min(c, rc[g]) for g, c in hc.items() if g in rc)


def word_ngram_stats_py(h, r, order: int = 4) -> list[int]:
    """[sys_len, ref_len, total_1, match_1, ..., total_k, match_k]."""
    h, r = list(h), list(r)
    out = [len(h), len(r)]
    for n in range(1, order + 1):
        out += [max(len(h) - n + 1, 0), _clipped(h, r, n)]
    return out


def char_ngram_stats_py(h: str, r: str, order: int = 6) -> list[int]:
    """[hyp_1, ref_1, match_1, ..., hyp_k, ref_k, match_k]."""
    out = []
    for n in range(1, order + 1):
        out += [max(len(h) - n + 1, 0), max(len(r) - n + 1, 0), _char_clipped(h, r, n)]
    return out


# ---------------------------------------------------------------------------
# batch-vectorised statistics: all segments of an Arrow batch at once
# ---------------------------------------------------------------------------
import numpy as np


def _segment_index(lens: np.ndarray):
    seg = np.repeat(np.arange(len(lens)), lens)
    pos = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    return seg, pos


def match_counts(h_ids: np.ndarray, h_lens: np.ndarray, r_ids: np.ndarray, r_lens: np.ndarray,
                 order: int) -> np.ndarray:
    """Clipped n-gram matches (n = 1..order) for every segment of a batch.

    ``*_ids`` are the concatenated dense symbol ids of all segments.  An
    n-gram code is built from the (n-1)-gram code and the next symbol.  Where
    a segment's number, a code and the side fit in 63 bits, keys are sorted
    and the runs of equal n-grams counted; else codes are re-densified with a
    hash factorisation, so that they never overflow, and keys (segment, code)
    are counted per side.  The minimum is summed per segment.  Codes that
    straddle two segments are computed but masked out."""
    n = len(h_lens)
    out = np.zeros((n, order), dtype=np.int64)
    if n == 0:
        return out
    h_seg, h_pos = _segment_index(h_lens)
    r_seg, r_pos = _segment_index(r_lens)
    h_ids = h_ids.astype(np.int64)
    r_ids = r_ids.astype(np.int64)
    vocab = int(max(h_ids.max(initial=-1), r_ids.max(initial=-1))) + 1
    bits = max(vocab.bit_length(), 1)
    # small alphabets: an n-gram code packs into one int64 (with the segment and the side)
    if bits * order + n.bit_length() + 1 <= 62:
        return _match_sorted(h_ids, h_seg, h_lens[h_seg] - h_pos, r_ids, r_seg, r_lens[r_seg] - r_pos, bits, out)
    ch, cr = h_ids, r_ids
    for k in range(order):
        if k:
            ch = ch[:-1] * vocab + h_ids[k:]
            cr = cr[:-1] * vocab + r_ids[k:]
            codes, _ = pd.factorize(np.concatenate([ch, cr]))
            ch, cr = codes[:len(ch)].astype(np.int64), codes[len(ch):].astype(np.int64)
        vh = h_pos[:len(ch)] + k < h_lens[h_seg[:len(ch)]]
        vr = r_pos[:len(cr)] + k < r_lens[r_seg[:len(cr)]]
        width = int(max(ch.max(initial=-1), cr.max(initial=-1))) + 1
        kh = h_seg[:len(ch)][vh] * width + ch[vh]
        kr = r_seg[:len(cr)][vr] * width + cr[vr]
        if len(kh) == 0 or len(kr) == 0:
            continue
        g, uniq = pd.factorize(np.concatenate([kh, kr]))
        cnt_h = np.bincount(g[:len(kh)], minlength=len(uniq))
        cnt_r = np.bincount(g[len(kh):], minlength=len(uniq))
        both = np.minimum(cnt_h, cnt_r)
        out[:, k] = np.bincount(uniq // width, weights=both, minlength=n).astype(np.int64)
    return out


def _match_sorted(h_ids, h_seg, h_left, r_ids, r_seg, r_left, bits: int, out: np.ndarray) -> np.ndarray:
    """``match_counts`` by sorting; ``*_left`` is the number of symbols from each one to its segment's end."""
    n, order = out.shape
    seg_h, seg_r = h_seg << (bits * order + 1), r_seg << (bits * order + 1)
    ch, cr = h_ids, r_ids
    for k in range(order):
        if k:
            ch = (ch[:-1] << bits) | h_ids[k:]
            cr = (cr[:-1] << bits) | r_ids[k:]
        keys = np.concatenate([(seg_h[:len(ch)] | (ch << 1))[h_left[:len(ch)] > k],
                               (seg_r[:len(cr)] | (cr << 1) | 1)[r_left[:len(cr)] > k]])
        if len(keys) == 0:
            break
        keys.sort()
        # runs of one n-gram of one side; that of the reference follows that of the hypothesis
        ends = np.flatnonzero(np.append(keys[1:] != keys[:-1], True))
        size, run = np.diff(ends, prepend=-1), keys[ends]
        at = np.flatnonzero(run[1:] ^ run[:-1] == 1)
        out[:, k] = np.bincount(run[at] >> (bits * order + 1), weights=np.minimum(size[at], size[at + 1]), minlength=n)
    return out


def word_ngram_stats_batch(h_lists: pa.ListArray, r_lists: pa.ListArray, order: int = 4) -> np.ndarray:
    h_lens, r_lens = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (h_lists, r_lists))
    tokens = pa.chunked_array([h_lists.flatten(), r_lists.flatten()]).combine_chunks()
    codes = tokens.dictionary_encode().indices.to_numpy(zero_copy_only=False)  # no token becomes a Python string
    nh = int(h_lens.sum())
    m = match_counts(codes[:nh], h_lens, codes[nh:], r_lens, order)
    cols = [h_lens, r_lens]
    for k in range(order):
        cols += [np.maximum(h_lens - k, 0), m[:, k]]
    return np.stack(cols, axis=1)


def char_ngram_stats_batch(h_strs, r_strs, order: int = 6) -> np.ndarray:
    h_lens = np.fromiter((len(x) for x in h_strs), dtype=np.int64, count=len(h_strs))
    r_lens = np.fromiter((len(x) for x in r_strs), dtype=np.int64, count=len(r_strs))
    cps = np.frombuffer(("".join(h_strs) + "".join(r_strs)).encode("utf-32-le"), dtype=np.uint32)
    codes = pd.factorize(cps)[0] if len(cps) else np.empty(0, dtype=np.int64)
    nh = int(h_lens.sum())
    m = match_counts(np.asarray(codes[:nh]), h_lens, np.asarray(codes[nh:]), r_lens, order)
    cols = []
    for k in range(order):
        cols += [np.maximum(h_lens - k, 0), np.maximum(r_lens - k, 0), m[:, k]]
    return np.stack(cols, axis=1)


#: symbols of both sides that are counted at once (or one segment's); each takes some 200 bytes
SLICE_SYMBOLS = 1 << 16


def _in_slices(stats, h, r, lens) -> list[np.ndarray]:
    """Statistics of a batch, in slices of bounded total length (``lens``: both sides' symbols)."""
    out, at, size = [], 0, 0
    for i, more in enumerate([*lens, 0]):
        if i > at and (i == len(h) or size + more > SLICE_SYMBOLS):
            out.append(stats(h[at:i], r[at:i]))
            at, size = i, 0
        size += more
    return out


@F.arrow_udf(T.ArrayType(T.LongType()))
def word_ngram_stats(h: pa.Array, r: pa.Array) -> pa.Array:
    lens = pc.add(*(pc.fill_null(pc.list_value_length(x), 0) for x in (h, r))).to_pylist()
    parts = _in_slices(word_ngram_stats_batch, h, r, lens)
    flat = np.concatenate(parts) if parts else np.empty((0, 1), dtype=np.int64)
    return pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1], flat.ravel())


@F.pandas_udf(T.ArrayType(T.LongType()))
def char_ngram_stats(h: pd.Series, r: pd.Series) -> pd.Series:
    h, r = [x or "" for x in h], [x or "" for x in r]
    parts = _in_slices(char_ngram_stats_batch, h, r, [len(a) + len(b) for a, b in zip(h, r)])
    return pd.Series([x for part in parts for x in part], dtype=object)
