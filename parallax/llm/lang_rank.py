"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent letter n-grams (one to
three letters, words padded by blanks), most frequent first.  A document's own
list is compared with every profile by the out-of-place distance: the sum of
rank differences, an n-gram that the profile lacks counting as the profile's
length.  The nearest language wins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._common import bound_batches, free_prefix

#: n-grams kept in a profile, and so the most that one can be out of place
PROFILE = 400
#: expected number of documents a language's profile is learned from
SAMPLE_PER_LANG = 1500
#: characters counted at once; longer texts are cut at blanks
PIECE = 1 << 20
_BITS = 18  # letters lie below 2**18
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE:
        end = text.find(" ", at + PIECE)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def _keys(piece: str) -> np.ndarray:
    codes = np.frombuffer(piece.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_is_letter()[codes], codes, 0).astype(np.int64)
    codes = np.concatenate(([0], codes, [0]))
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
    one = codes[codes != 0]
    two = (codes[:-1] << _BITS | codes[1:]) + (1 << 60)
    inner = codes[1:-1] != 0
    three = ((codes[:-2] << _BITS | codes[1:-1]) << _BITS | codes[2:])[inner] + (2 << 60)
    return np.concatenate((one, two, three))


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-gram keys of the whole text and their counts; empty without letters."""
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for piece in _pieces(text):
        k = _keys(piece)
        if not len(k):  # no letter
            continue
        k.sort()
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        n = np.diff(np.append(first, len(k)))
        k = k[first]
        if len(keys):
            k, inverse = np.unique(np.concatenate((keys, k)), return_inverse=True)
            n = np.bincount(inverse, np.concatenate((counts, n))).astype(np.int64)
        keys, counts = k, n
    return keys, counts


def ranked(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The ``size`` most frequent keys, most frequent first, ties by key."""
    if len(keys) > 4 * size:  # all that reach the count of rank `size`, then order those
        least = np.partition(counts, -size)[-size]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))[:size]]


def _unit(column: Column, seed: int) -> Column:
    """A reproducible number in [0, 1) from a column's value."""
    return (F.pmod(F.xxhash64(F.lit(seed), column), F.lit(1 << 52)) / F.lit(float(1 << 52)))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id",
          per_lang: int = SAMPLE_PER_LANG, size: int = PROFILE, seed: int = 10) -> dict[str, list[int]]:
    """Profiles from labelled rows: ``{language: n-gram keys by rank}``.

    Rows without text, label or id teach nothing.  Each language learns from
    rows chosen by the hash of their id, ``per_lang`` expected (all, if
    fewer).  The labels' counts and the profiles (``size`` keys a language)
    are what reaches the driver."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(id_col).alias("id")).where(
        "lang is not null and text is not null and id is not null")
    share = {r["lang"]: per_lang / r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return {}
    wanted = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
    sample = rows.where(_unit(F.col("id"), seed) < wanted[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, group in batch.groupby("lang"):
                parts = [ngram_counts(t) for t in group["text"]]
                keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.bincount(inverse, np.concatenate([n for _, n in parts])) if len(keys) else np.empty(0)
                yield pd.DataFrame({"lang": name, "key": keys, "n": n.astype(np.int64)})

    counts = sample.mapInPandas(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "key")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).collect()
    profiles: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["key"])
    return profiles


class Ranker:
    """Compares texts with the profiles; small (languages x profile size) and picklable."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.size, self.langs = size, sorted(profiles)
        self.keys = np.unique(np.array([k for p in profiles.values() for k in p], np.int64))
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), -1, np.int32)  # last row: in no profile
        for j, name in enumerate(self.langs):
            self.ranks[np.searchsorted(self.keys, profiles[name]), j] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs:
            return "und", 0.0
        own = ranked(*ngram_counts(text), self.size)
        if not len(own):
            return "und", 0.0
        at = np.searchsorted(self.keys, own)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != own)] = len(self.keys)
        ranks = self.ranks[at]
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own), dtype=np.int32)[:, None]))
        total = away.sum(axis=0)
        best = int(total.argmin())
        return self.langs[best], 1.0 - float(total[best]) / (self.size * len(own))


def predict_udf(profiles: dict[str, list[int]], size: int = PROFILE):
    """Column function text -> ``struct(lang_pred string, score double)``."""
    ranker = Ranker(profiles, size)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([ranker.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict


def held_out(id_col: str) -> Column:
    """Rows kept from learning: crc32 of the id as text is divisible by 5 (null id: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id",
             per_lang: int = SAMPLE_PER_LANG, size: int = PROFILE) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score`` (replacing columns of these names).

    Learns from rows that are not held out, predicts every row from its whole
    text alone.  A null text, a text without letters, or no labelled row at
    all gives ``und`` with score 0.  Ties go to the language that sorts
    first; repeated rows each get the same answer; an empty table gives an
    empty one."""
    profiles = learn(docs.where(~held_out(id_col)), text, lang, id_col, per_lang, size)
    found = predict_udf(profiles, size)(F.col(text))
    out = docs.drop("held_out", "lang_pred", "score")
    p = f"{free_prefix(out)}found"
    return (out.withColumn(p, found).withColumn("held_out", held_out(id_col))
            .withColumn("lang_pred", F.col(p)["lang_pred"]).withColumn("score", F.col(p)["score"]).drop(p))
