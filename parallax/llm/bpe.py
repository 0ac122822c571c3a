"""Byte-level BPE by two tiers.

A minimal perfect hash over the vocabulary resolves pre-tokens that are
tokens themselves; the others are merged by a heap over linked bytes."""

from __future__ import annotations

import base64
import heapq
import pickle
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import pin
from ._common import bound_batches, free_prefix

#: pre-tokens resolved at once, and the most that a worker remembers (in each of two generations)
PIECES, MEMO = 200_000, 250_000
#: longer pre-tokens are not remembered
MEMO_BYTES = 64
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray, d: np.ndarray | np.uint64) -> np.ndarray:
    x = h ^ (d * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Hash and displace: every key of the set has its own slot among as many slots.

    A bucket of one key holds its slot directly (negative), another one the
    displacement that sends its keys to free slots."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        n = self.n = len(keys)
        self.buckets = max(1, n // per_bucket)
        h = self.hashes(keys)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, np.int64)
        free = np.ones(n, bool)
        sizes = np.diff(starts)
        for b in np.argsort(-sizes, kind="stable"):
            own = h[order[starts[b]:starts[b + 1]]]
            if len(own) < 2:
                break
            at = 1
            while True:
                tries = np.arange(at, at + 64, dtype=np.uint64)
                slots = (_mix(own[None, :], tries[:, None]) % np.uint64(n)).astype(np.int64)
                good = free[slots].all(axis=1)
                if len(own) > 1:
                    s = np.sort(slots, axis=1)
                    good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                hit = np.flatnonzero(good)
                if len(hit):
                    self.shift[b] = at + hit[0]
                    free[slots[hit[0]]] = False
                    break
                at += 64
        alone = np.flatnonzero(sizes == 1)
        self.shift[alone] = -1 - np.flatnonzero(free)[:len(alone)]

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        digest = xxhash.xxh64_intdigest
        return np.fromiter((digest(k) for k in keys), np.uint64, len(keys))

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """A slot for each key; right only for keys of the set, so the caller compares."""
        h = self.hashes(keys)
        shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        moved = (_mix(h, np.maximum(shift, 0).astype(np.uint64)) % np.uint64(self.n)).astype(np.int64)
        return np.where(shift < 0, -1 - shift, moved)


#: ids fit in so many bits; a pair of ids is one whole number, as is a heap entry (rank, place)
_ID, _PLACE = 20, 40
_NONE = 1 << _ID


def merge(piece: bytes, byte_id: list[int], pair_rank: dict[int, int]) -> list[int]:
    """Repeatedly merge the adjacent pair of lowest rank, the leftmost first.

    Bytes form a linked list; a heap holds the ranks of adjacent pairs, and an
    entry counts only while it is the rank of the pair at its place."""
    n = len(piece)
    ids = [byte_id[c] for c in piece]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    now = [pair_rank.get(a << _ID | b, _NONE) for a, b in zip(ids, ids[1:])]
    now.append(_NONE)
    heap = [r << _PLACE | i for i, r in enumerate(now) if r != _NONE]
    heapq.heapify(heap)
    pop, push, rank = heapq.heappop, heapq.heappush, pair_rank.get
    while heap:
        entry = pop(heap)
        r = entry >> _PLACE
        i = entry & ((1 << _PLACE) - 1)
        if now[i] != r:
            continue  # one side has been merged since
        j = after[i]
        k = after[i] = after[j]
        ids[i], ids[j], now[j] = r, -1, _NONE
        if k < n:
            before[k] = i
            t = now[i] = rank(r << _ID | ids[k], _NONE)
            if t != _NONE:
                push(heap, t << _PLACE | i)
        else:
            now[i] = _NONE
        h = before[i]
        if h >= 0:
            t = now[h] = rank(ids[h] << _ID | r, _NONE)
            if t != _NONE:
                push(heap, t << _PLACE | h)
    return [x for x in ids if x >= 0]


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """(left id, right id) -> id of the token that both make."""
    out = {}
    for token, r in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                out[a << _ID | b] = r
    return out


class Codec:
    """Encodes and decodes with a rank file's vocabulary (bytes -> rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        tokens = list(ranks)
        self.hash = PerfectHash(tokens)
        slot = self.hash.slots(tokens)
        self.slot_token: list[bytes] = [b""] * len(tokens)
        self.slot_rank = np.zeros(len(tokens), np.uint32)
        for s, t in zip(slot.tolist(), tokens):
            self.slot_token[s], self.slot_rank[s] = t, ranks[t]
        self.by_rank = {r: t for t, r in ranks.items()}
        self.byte_id = [ranks[bytes([c])] for c in range(256)]
        self.pair_rank = pair_ranks(ranks)
        self._start()

    def _start(self) -> None:
        self.find = regex.compile(self.pattern).finditer
        self.find_all = regex.compile(self.pattern).findall
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("find", "find_all", "memo", "older")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def _resolve(self, pieces: set[str]) -> dict[str, bytes]:
        """Packed ids of distinct pre-tokens: the hash tier, then the merge tier."""
        texts = list(pieces)
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        out = {}
        slots = self.hash.slots(raw)
        packed = self.slot_rank[slots].astype("<u4").tobytes()
        for i, (t, b, s) in enumerate(zip(texts, raw, slots.tolist())):
            if self.slot_token[s] == b:
                out[t] = packed[4 * i:4 * i + 4]
            else:
                ids = merge(b, self.byte_id, self.pair_rank)
                out[t] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def _pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) < 4 * PIECES:
            yield self.find_all(text)
            return
        found = (m.group() for m in self.find(text))
        while some := list(islice(found, PIECES)):
            yield some

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        out = []
        for pieces in self._pieces(text or ""):
            try:
                out.append(b"".join([self.memo[p] for p in pieces]))
                continue
            except KeyError:
                pass
            new = set(pieces).difference(self.memo)
            if len(self.memo) + len(new) > MEMO:  # two generations: what is in use moves to the younger one
                self.memo, self.older = {}, self.memo
                new = set(pieces)
            known = {p: self.older[p] for p in new if p in self.older}
            known.update(self._resolve(new.difference(known)))
            if len(known) > MEMO or any(len(p) > MEMO_BYTES for p in known):
                keep = {p: b for p, b in list(known.items())[:MEMO] if len(p) <= MEMO_BYTES}
                known.update((p, self.memo[p]) for p in set(pieces).difference(known))
                out.append(b"".join([known[p] for p in pieces]))
                self.memo.update(keep)
            else:
                self.memo.update(known)
                out.append(b"".join([self.memo[p] for p in pieces]))
        return b"".join(out)

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes that packed ids stand for."""
        token = self.by_rank
        return b"".join([token[i] for i in np.frombuffer(ids or b"", "<u4").tolist()])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """The worker's codec, kept with its memo from task to task."""
    if shared.value["id"] not in _codecs:
        _codecs.clear()
        _codecs[shared.value["id"]] = pickle.loads(shared.value["codec"])
    return _codecs[shared.value["id"]]


def recode(docs: DataFrame, tokenizer: Tokenizer, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and, decoded from them, ``decoded`` (replacing such columns).

    The ids are pinned between the two, so that encoding runs once."""
    ids = docs.drop("ids", "decoded").withColumn("ids", tokenizer.encode(F.col(text)))
    return pin(ids, ids=F.col("ids")).withColumn("decoded", tokenizer.decode(F.col("ids")))


def recode_together(docs: DataFrame, tokenizer: Tokenizer, text: str = "text") -> DataFrame:
    """:func:`recode` in one worker a task instead of two, for jobs that have little memory to spare."""
    rows = docs.drop("ids", "decoded")
    both = f"{free_prefix(rows)}both"
    made = pin(rows, **{both: tokenizer.recode(F.col(text))})
    return made.select(*rows.columns, F.col(both)["ids"].alias("ids"), F.col(both)["decoded"].alias("decoded"))


class Tokenizer:
    """Column functions over a vocabulary that is read once on the driver and broadcast (about 2 MB for 50k tokens).

    ``encode(text)`` gives the ids packed as little-endian unsigned 32-bit
    integers (binary); null and empty texts give no ids.  ``decode(ids)``
    gives the bytes (binary), exactly those that were encoded."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        bound_batches(spark)
        codec = pickle.dumps(Codec(load_ranks(path), pattern))
        shared = spark.sparkContext.broadcast({"id": xxhash.xxh64_intdigest(codec), "codec": codec})

        @F.pandas_udf("binary")
        def encode(texts: pd.Series) -> pd.Series:
            codec = _codec(shared)
            return pd.Series([codec.encode(t) for t in texts], dtype=object)

        @F.pandas_udf("binary")
        def decode(ids: pd.Series) -> pd.Series:
            codec = _codec(shared)
            return pd.Series([codec.decode(x) for x in ids], dtype=object)

        @F.pandas_udf("ids binary, decoded binary")
        def recode(texts: pd.Series) -> pd.DataFrame:
            codec = _codec(shared)
            ids = [codec.encode(t) for t in texts]
            return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([codec.decode(x) for x in ids], dtype=object)})

        self._encode, self._decode, self._recode = encode, decode, recode

    def encode(self, text: Column) -> Column:
        return self._encode(text)

    def decode(self, ids: Column) -> Column:
        return self._decode(ids)

    def recode(self, text: Column) -> Column:
        """``encode``'s ids and what ``decode`` makes of them, as a struct."""
        return self._recode(text)


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
