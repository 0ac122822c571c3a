"""Subword pieces (P12): encoding with a given piece vocabulary, BPE or unigram.

The vocabulary is a model file of pieces with scores, read through Spark and
broadcast; nothing is trained.  A text is cut where a blank begins a run of
blanks, which no piece crosses, so that every stretch is encoded by itself
and the stretches a worker has met are looked up."""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._col import as_col

#: stretches that a worker keeps
MEMO = 200_000
#: characters of a stretch that is merged without a heap
SHORT = 64
#: largest vocabulary file, which is broadcast
MAX_BYTES = 64 << 20
#: what a character without a piece costs in a lattice, below the lowest score
UNKNOWN_PENALTY = 10.0

# fixed values of the file format: kinds of pieces, kinds of models, the sign for a blank
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
BLANK = "▁"


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield key >> 3, raw[at:at + size]
            at += size
        elif kind == 2:
            size = number()
            yield key >> 3, raw[at:at + size]
            at += size
        else:
            raise ValueError(f"wire type {kind} in a piece model")


class PieceModel(NamedTuple):
    """Pieces with their ids and scores; ``kind`` is ``BPE`` or ``UNIGRAM``."""

    ids: dict[str, int]
    scores: dict[str, float]
    kind: int
    unknown: int
    byte_ids: tuple[int, ...] | None
    dummy_prefix: bool
    squeeze: bool

    @staticmethod
    def parse(raw: bytes) -> PieceModel:
        pieces, kind, fallback, prefix, squeeze = [], UNIGRAM, False, True, True
        for no, value in _fields(raw):
            if no == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
                pieces.append((piece[1].decode("utf-8", "surrogateescape"), struct.unpack("<f", piece[2])[0], piece[3]))
            elif no == 2:
                trainer = dict(_fields(value))
                kind, fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            elif no == 3:
                rules = dict(_fields(value))
                if rules.get(2):
                    raise ValueError("a piece model with a character map: only texts that are taken as they are can be encoded")
                prefix, squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
        if kind not in (BPE, UNIGRAM):
            raise ValueError(f"piece models are BPE or unigram, this one is of kind {kind}")
        usable = {p: i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER_DEFINED)}
        unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN), 0)
        of_byte = {p: i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        bytes_ = tuple(of_byte[f"<0x{b:02X}>"] for b in range(256)) if fallback else None
        return PieceModel(usable, {p: pieces[i][1] for p, i in usable.items()}, kind, unknown, bytes_, prefix, squeeze)

    @staticmethod
    def read(spark: SparkSession, path: str) -> PieceModel:
        """The model in a file that Spark reads, at most ``MAX_BYTES`` long."""
        files = spark.read.format("binaryFile").load(path)
        size = files.select("length").first()[0]
        if size > MAX_BYTES:
            raise ValueError(f"{path} has {size} bytes; a vocabulary of at most {MAX_BYTES} is broadcast")
        return PieceModel.parse(bytes(files.select("content").first()[0]))


def merge_short(text: str, scores: dict[str, float]) -> list[str]:
    """What :func:`merge_pieces` gives, by a search of all neighbours for each join: faster for a few characters."""
    none = float("-inf")
    score = scores.get
    parts = list(text)
    made = [score(a + b, none) for a, b in zip(parts, parts[1:])]
    while made:
        best = max(made)
        if best == none:
            break
        i = made.index(best)
        parts[i] += parts.pop(i + 1)
        del made[i]
        if i:
            made[i - 1] = score(parts[i - 1] + parts[i], none)
        if i < len(made):
            made[i] = score(parts[i] + parts[i + 1], none)
    return parts


def merge_pieces(text: str, scores: dict[str, float]) -> list[str]:
    """BPE: the neighbours that make the piece of the highest score are joined, the first ones of equals, until none do."""
    if len(text) <= SHORT:
        return merge_short(text, scores)
    parts: list[str | None] = list(text)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < len(parts):
            joined = parts[i] + parts[j]
            score = scores.get(joined)
            if score is not None:
                heapq.heappush(heap, (-score, i, j, joined))

    for i in range(len(parts) - 1):
        offer(i, i + 1)
    while heap:
        _, i, j, joined = heapq.heappop(heap)
        if parts[i] is None or after[i] != j or parts[j] is None or parts[i] + parts[j] != joined:
            continue  # one of the two has been joined since
        parts[i], parts[j] = joined, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        offer(before[i], i)
        offer(i, after[i])
    return [p for p in parts if p is not None]


def best_path(text: str, scores: dict[str, float], longest: int, unknown: float) -> list[str]:
    """Unigram: the cut of the text with the highest sum of scores; a character that is no piece costs ``unknown``."""
    best, came = [0.0] + [float("-inf")] * len(text), [0] * (len(text) + 1)
    for i in range(len(text)):
        single = False
        for j in range(i + 1, min(i + longest, len(text)) + 1):
            score = scores.get(text[i:j])
            if score is not None:
                single |= j == i + 1
                if best[i] + score > best[j]:
                    best[j], came[j] = best[i] + score, i
        if not single and best[i] + unknown > best[i + 1]:
            best[i + 1], came[i + 1] = best[i] + unknown, i
    out, j = [], len(text)
    while j:
        out.append(text[came[j]:j])
        j = came[j]
    return out[::-1]


class Encoder:
    """Text -> ids of one model, with a memo of the stretches met."""

    def __init__(self, model: PieceModel) -> None:
        self.model, self.memo = model, {}
        self.longest = max(map(len, model.ids), default=1)
        self.penalty = min(model.scores.values(), default=0.0) - UNKNOWN_PENALTY
        inside = any(BLANK in p.lstrip(BLANK) for p in model.ids)
        self.stretch = re.compile("(?s).+" if inside else f"(?s){BLANK}+[^{BLANK}]*|[^{BLANK}]+")

    def _ids(self, stretch: str) -> list[int]:
        m = self.model
        parts = merge_pieces(stretch, m.scores) if m.kind == BPE else best_path(stretch, m.scores, self.longest, self.penalty)
        out = []
        for p in parts:
            known = m.ids.get(p)
            if known is not None:
                out.append(known)
            elif m.byte_ids:
                out.extend(m.byte_ids[b] for b in p.encode("utf-8", "surrogatepass"))
            else:
                out.append(m.unknown)
        return out

    def __call__(self, text: str) -> list[int]:
        m = self.model
        if m.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return []
        text = (BLANK if m.dummy_prefix else "") + text.replace(" ", BLANK)
        out: list[int] = []
        for stretch in self.stretch.findall(text):
            ids = self.memo.get(stretch)
            if ids is None:
                ids = self._ids(stretch)
                if len(stretch) <= 64:
                    if len(self.memo) >= MEMO:
                        self.memo.clear()
                    self.memo[stretch] = ids
            out += ids
        if not m.byte_ids:  # unknown characters in a row are one token
            out = [x for i, x in enumerate(out) if x != m.unknown or not i or out[i - 1] != m.unknown]
        return out


def piece_encoder(spark: SparkSession, model: PieceModel | str):
    """A column function text -> ids with the pieces of ``model`` (or of the file it names); null text has no ids."""
    sent = spark.sparkContext.broadcast(PieceModel.read(spark, model) if isinstance(model, str) else model)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(sent.value)  # once a task
        for texts in batches:
            yield pd.Series([encoder(t or "") for t in texts], dtype=object)

    def ids(c) -> Column:
        return encode(as_col(c))

    return ids
