"""Phrase collocation mining: counted level by level with tries of Apriori-safe candidates.

A phrase of k words can only be frequent if its parts of k - 1 words are.
For each k the texts are read three times: once to add up the hashes of the
phrases whose parts may be frequent, once to collect the distinct phrases
whose hashes are frequent (the candidates), and once for each broadcast of
tries, to count the candidates exactly: all word starts of a text that the
trie may know advance through a double-array trie at once, byte by byte,
accepting states are bincounted and the counts of all shards summed.  Hashes
are shuffled with their counts, so what is added up grows with the input as
the text does; of the frequent ones a filter of bounded size is broadcast,
whose errors only add candidates.  Each hash has an owner, one class of
documents that hands its phrase on.  The finds of the frequent phrases must
add up to the places of the frequent hashes: where so many are missing that a
phrase of an owner's hash may be frequent, all classes hand on all phrases."""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import broadcast_if_small
from . import double_array
from ._common import batch_limits, remove, save

#: bits of a hash's bucket, and bytes of the largest filter, as a power of two
BITS = 25
#: bytes of the candidates of one trie; its arrays take about ten times that
TRIE_BYTES = 4 << 20
#: bytes of the tries broadcast for one pass over the texts
PASS_BYTES = 48 << 20
#: bytes of what the driver fetches and broadcasts at once
PART_BYTES = 4 << 20
#: text of one language handled at once
SLICE = 1 << 20
#: distinct words or phrases that a task holds before it hands them on
HELD = 300_000
#: classes of documents: a candidate is collected from those of one class only
CLASSES = 128
#: bits of the hash that tell a phrase from the others of its bucket
PRINT = 32
#: parts that keys are dealt in, as a power of two, and bits of the filter that a key sets
CHUNKS, PROBES = 12, 4
#: keys that a task holds before it hands them on, and the highest count of one cell
KEYS, MOST = 1 << 22, 4095
#: phrases of a trie whose counts a row holds
CHUNK = 1 << 15

_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_PIECE_END = re.compile(rb"[.,;:!?\n-\r]")
_GAP = re.compile(rb"[ \t.,;:!?\n-\r]")
_FOLD = bytes(10 if c in _PIECE_ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_STOP = np.zeros(256, bool)
_STOP[[10, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64; kept by the worker."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.multiply.accumulate(np.full(n, x, np.uint64)) for x in (_ODD, np.uint64(pow(int(_ODD), -1, 1 << 64)))]
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of folded text: starts, ends, hashes, and which ones the next word follows in the same piece."""

    def __init__(self, text: np.ndarray, seed: int) -> None:
        self.text = text
        gap = _STOP[text]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1  # text begins and ends with a gap
        self.start, self.end = edge[::2], edge[1::2]
        powers, back = _powers(len(text))
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
        self.hash = _mix((sums[self.end] - sums[self.start]) * back[self.start] + np.uint64(seed))
        self.joined = (text[self.end[:-1]] == 32) & (self.start[1:] == self.end[:-1] + 1) if len(self.start) else np.zeros(0, bool)

    def whole(self, k: int) -> np.ndarray:
        """First words of all phrases of k words."""
        n = max(len(self.start) - k + 1, 0)
        ok = np.ones(n, bool)
        for i in range(k - 1):
            ok &= self.joined[i:i + n]
        return np.flatnonzero(ok)

    def phrase_hash(self, first: np.ndarray, k: int) -> np.ndarray:
        h = self.hash[first]
        for i in range(1, k):
            h = _mix(h * np.uint64(3) + self.hash[first + i])
        return h


def _seed(lang: bytes) -> int:
    h = 14695981039346656037
    for c in lang:
        h = (h ^ c) * 1099511628211 % (1 << 64)
    return h


def _fold(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased text between newlines, with ends of pieces as newlines, and which bytes make all spaces single."""
    text = np.frombuffer(b"\n" + raw.translate(_FOLD) + b"\n", np.uint8)
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != 32) | (text[:-1] != 32)
    return text, keep


def _back(raw: bytes, least: int, at: int, words: int) -> int:
    """Where the last ``words`` words before ``at`` begin, ``least`` at the lowest."""
    for _ in range(words):
        while at > least and raw[at - 1] in b" \t":
            at -= 1
        at = max(raw.rfind(b" ", least, at) + 1, raw.rfind(b"\t", least, at) + 1, least)
    return at


def _slices(raw: bytes, k: int) -> Iterator[bytes]:
    """Parts of a text of about ``SLICE`` bytes, in which each phrase of k words lies once.

    Cut at ends of pieces, or at blanks where a piece is that long: then the
    next part begins with the last k - 1 words again."""
    at = 0
    while len(raw) - at > 2 * SLICE:
        end = _PIECE_END.search(raw, at + SLICE, at + 2 * SLICE)
        seek = at + 2 * SLICE
        while end is None:
            end = _GAP.search(raw, seek)
            if end is None:
                yield raw[at:]
                return
            if raw[end.start()] in b" \t" and _back(raw, at, end.start(), k - 1) == at:
                seek, end = end.end(), None
        yield raw[at:end.start()]
        at = _back(raw, at, end.start(), k - 1) if raw[end.start()] in b" \t" else end.end()
    yield raw[at:]


class _Held:
    """Texts of one language, and for each the class of its document."""

    def __init__(self) -> None:
        self.parts, self.classes, self.size = [], [], 0

    def add(self, part: bytes, kind: int) -> None:
        self.parts.append(part)
        self.classes.append(kind)
        self.size += len(part) + 1

    def fold(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Folded text, where the documents begin in it, and their classes."""
        text, keep = _fold(b"\n".join(self.parts))
        begin = np.cumsum([1] + [len(p) + 1 for p in self.parts[:-1]])
        return text[keep], np.concatenate([[0], np.cumsum(keep)])[begin], np.array(self.classes, np.int64)


def _texts(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Folded text by language, several documents together, from batches ``(lang, text)`` of bytes;
    with it the places where documents begin and their classes, which hang on their text alone."""
    held: dict[bytes, _Held] = {}
    size = 0
    for batch in batches:
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = raw.as_py()
            kind = zlib.crc32(raw) % CLASSES
            for part in _slices(raw, k):
                now = held.setdefault(lang, _Held())
                now.add(part, kind)
                size += len(part) + 1
                if now.size >= SLICE:
                    size -= now.size
                    yield lang, *held.pop(lang).fold()
            if len(held) > 1000 or size > 8 * SLICE:
                for each, now in held.items():
                    yield each, *now.fold()
                held, size = {}, 0
    for each, now in held.items():
        yield each, *now.fold()


def _counted(lang: list[bytes], phrase: list[bytes], n: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.binary()), pa.array(phrase, pa.binary()), pa.array(n, pa.int64())], ["lang", "phrase", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[bytes, Counter] = {}

    def drain() -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            yield _counted([lang] * len(c), list(c), list(c.values()))
        counts.clear()

    for lang, text, _, _ in _texts(batches, 1):
        counts.setdefault(lang, Counter()).update(text.tobytes().split())
        if sum(map(len, counts.values())) > HELD:
            yield from drain()
    yield from drain()


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _print(h: np.ndarray, bits: int) -> np.ndarray:
    """The bits of the hash after those of the bucket."""
    return ((h >> np.uint64(64 - bits - PRINT)) & np.uint64((1 << PRINT) - 1)).astype(np.int64)


def _keys(h: np.ndarray, bits: int) -> np.ndarray:
    """What a hash is counted by: bucket and fingerprint."""
    return (_bucket(h, bits).astype(np.uint64) << np.uint64(PRINT)) | _print(h, bits).astype(np.uint64)


def _part_keys(h: np.ndarray, bits: int) -> np.ndarray:
    """What the hash of a phrase's part is looked up by: as many bits."""
    return h >> np.uint64(64 - bits - PRINT)


class _Filter:
    """Tests keys, or keys and classes, by ``PROBES`` bits in the part of their chunk; lets some others through."""

    def __init__(self, packed: dict[int, bytes], bits: int) -> None:
        size = np.array([len(packed.get(c, b"")) for c in range(1 << CHUNKS)])
        self.bits = bits
        self.first = np.where(size > 0, 1 + np.cumsum(size) - size, 0)  # byte 0 holds nothing
        self.flags = np.frombuffer(b"".join([b"\0", *(packed[c] for c in sorted(packed))]), np.uint8)
        self.size = (8 * size).astype(np.uint64)

    def test(self, key: np.ndarray, kind: np.ndarray | int = 0) -> np.ndarray:
        left = np.arange(len(key))
        chunk = (key >> np.uint64(self.bits + PRINT - CHUNKS)).astype(np.int64)
        mixed = _probe(key, kind)
        for i in range(PROBES):
            at = ((mixed >> np.uint64(16 * i)) & np.uint64(0xFFFF)) * self.size[chunk] >> np.uint64(16)
            good = _flags_at(self.flags[self.first[chunk] + (at >> np.uint64(3)).astype(np.int64)], at)
            left, chunk, mixed = left[good], chunk[good], mixed[good]
        out = np.zeros(len(key), bool)
        out[left] = True
        return out


def _probe(key: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
    return _mix(key * np.uint64(CLASSES) + np.asarray(kind).astype(np.uint64) + _ODD)


def _flags_at(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (flags >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _filter_of(key: np.ndarray, kind: np.ndarray | int, most: int) -> bytes:
    """The bits of a chunk's keys: 16 for each, as far as ``most`` bytes reach."""
    flags = np.zeros(max(8, min(2 * len(key), most)), np.uint8)
    mixed = _probe(key, kind)
    for i in range(PROBES):
        at = ((mixed >> np.uint64(16 * i)) & np.uint64(0xFFFF)) * np.uint64(8 * len(flags)) >> np.uint64(16)
        np.bitwise_or.at(flags, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return flags.tobytes()


def _possible(words: Words, k: int, parts: _Filter) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the phrases of k words whose parts of k - 1 words may be frequent."""
    first = words.whole(k)
    if k == 2:
        good = parts.test(_part_keys(words.hash, parts.bits))
        first = first[good[first] & good[first + 1]]
    else:
        first = first[parts.test(_part_keys(words.phrase_hash(first, k - 1), parts.bits))]
        first = first[parts.test(_part_keys(words.phrase_hash(first + 1, k - 1), parts.bits))]
    return first, words.phrase_hash(first, k)


_KEYED = "chunk long, cells binary"


class _Tally:
    """Keys with their classes, as one number each, handed on in order with their counts."""

    def __init__(self, bits: int) -> None:
        self.local = np.uint64(bits + PRINT - CHUNKS)
        self.parts, self.held = [], 0

    def add(self, key: np.ndarray, kind: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(key * np.uint64(CLASSES) + kind.astype(np.uint64))
        self.held += len(key)
        if self.held >= KEYS:
            yield from self.drain()

    def drain(self) -> Iterator[pa.RecordBatch]:
        """Rows of a chunk's cells: the key's other bits, how often it was there, the lowest class."""
        if not self.held:
            return
        whole = np.concatenate(self.parts)
        self.parts, self.held = [], 0
        whole.sort()
        key = whole // np.uint64(CLASSES)
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.diff(np.append(new, len(key)))
        key, kind = key[new], whole[new] % np.uint64(CLASSES)
        del whole
        more = -(-n // MOST)  # a count that one cell does not hold takes several
        if (more > 1).any():
            last = np.cumsum(more) - 1
            key, kind, left = np.repeat(key, more), np.repeat(kind, more), n - (more - 1) * MOST
            n = np.full(len(key), MOST)
            n[last] = left
        cells = ((key & ((np.uint64(1) << self.local) - np.uint64(1))) * np.uint64(MOST + 1) + n.astype(np.uint64)) * np.uint64(CLASSES) + kind
        chunk = (key >> self.local).astype(np.int64)
        begin = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])).tolist()
        for at in range(0, len(begin), 256):
            some = [*begin[at:at + 257], len(cells)][:257]
            yield pa.RecordBatch.from_arrays([pa.array(chunk[some[:-1]]), pa.array([cells[a:b].tobytes() for a, b in zip(some, some[1:])], pa.binary())], ["chunk", "cells"])


def _sum_keys(least: int, bits: int):
    """Rows of a chunk next to each other -> ``(chunk, places, owned, known)`` of the keys that are there ``least`` times or
    more: how often they are, and the filters of them with their owners and of them alone."""
    most, local = max(8, (1 << bits) >> CHUNKS), np.uint64(bits + PRINT - CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            cells = np.frombuffer(b"".join(held), np.uint64).copy()
            cells.sort()
            kind, n, key = cells % np.uint64(CLASSES), cells // np.uint64(CLASSES) % np.uint64(MOST + 1), cells // np.uint64(CLASSES * (MOST + 1))
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            total = np.add.reduceat(n, new)
            often = total >= least
            key = (np.uint64(now) << local) | key[new][often]
            if len(key):
                owned = _filter_of(key, np.minimum.reduceat(kind, new)[often], most)
                yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([int(total[often].sum())]), pa.array([owned], pa.binary()),
                                                  pa.array([_filter_of(key, 0, most)], pa.binary())], ["chunk", "places", "owned", "known"])

        for batch in batches:
            for chunk, cells in zip(*[c.to_pylist() for c in batch.columns]):
                if chunk != now:
                    if now is not None:
                        yield from done()
                    now, held = chunk, []
                held.append(cells)
        if now is not None:
            yield from done()

    return run


class _Parts:
    """A value that is broadcast in parts, so that the driver never holds all of it."""

    def __init__(self, sent: list[Broadcast], join: Callable) -> None:
        self.sent, self.join = sent, join

    @property
    def value(self):
        return self.join(b.value for b in self.sent)

    def destroy(self) -> None:
        for b in self.sent:
            b.destroy()


def _join_chunks(parts: Iterator[dict[int, bytes]]) -> dict[int, bytes]:
    return {chunk: cells for part in parts for chunk, cells in part.items()}


def _join_arrays(parts: Iterator[bytes]) -> bytes:
    return b"".join(map(zlib.decompress, parts))


def _frequent(rows: DataFrame, least: int, bits: int, gone: list[str]) -> DataFrame:
    """The filters of the keys that are there ``least`` times, saved."""
    summed = rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_sum_keys(least, bits), "chunk long, places long, owned binary, known binary")
    packed, path = save(summed, "keys")
    gone.append(path)
    return packed


def _sent(packed: DataFrame, cells: str, part_bytes: int) -> _Parts:
    """A filter: 2 ** bits bytes at most, whatever the input."""
    sent = []
    for chunks in _groups(sorted(packed.select("chunk", F.octet_length(cells)).collect()), part_bytes):
        part = packed.where(F.col("chunk").between(chunks[0], chunks[-1])).select("chunk", cells).collect()
        sent.append(packed.sparkSession.sparkContext.broadcast({r["chunk"]: bytes(r[cells]) for r in part}))
        del part
    return _Parts(sent, _join_chunks)


def _frequent_keys(bits: int):
    """Phrases ``(lang, phrase)`` -> their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(bits)
        for batch in batches:
            by: dict[bytes, list[bytes]] = {}
            for lang, phrase in zip(*[c.to_pylist() for c in batch.columns]):
                by.setdefault(lang, []).append(phrase)
            for lang, phrases in by.items():
                words = Words(np.frombuffer(b"\n" + b"\n".join(phrases) + b"\n", np.uint8), _seed(lang))
                k = phrases[0].count(b" ") + 1
                key = _part_keys(words.phrase_hash(words.whole(k), k), bits)
                yield from tally.add(key, np.zeros(len(key), np.int64))
        yield from tally.drain()

    return run


def _bucket_counts(k: int, parts, bits: int):
    """Counts of the keys of the phrases whose parts may be frequent, and of each key the lowest class of documents that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, good = _Tally(bits), _Filter(parts.value, bits)
        for lang, text, begin, classes in _texts(batches, k):
            words = Words(text, _seed(lang))
            first, h = _possible(words, k, good)
            yield from tally.add(_keys(h, bits), classes[np.searchsorted(begin, words.start[first], "right") - 1])
        yield from tally.drain()

    return run


def _candidates(k: int, parts, often, bits: int, everywhere: bool = False):
    """Phrases ``(lang, phrase)`` of k words whose parts and whose keys may be frequent.

    A phrase comes from the documents of its key's owner only, so that few
    tasks hand on the same one, or ``everywhere`` from all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, set[bytes]] = {}
        good, frequent = _Filter(parts.value, bits), _Filter(often.value, bits)
        for lang, text, begin, classes in _texts(batches, k):
            words = Words(text, _seed(lang))
            first, h = _possible(words, k, good)
            first = first[frequent.test(_keys(h, bits), 0 if everywhere else classes[np.searchsorted(begin, words.start[first], "right") - 1])]
            raw = text.tobytes()
            known = seen.setdefault(lang, set())
            new = {raw[a:b] for a, b in zip(words.start[first].tolist(), words.end[first + k - 1].tolist())} - known
            if new:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(new), pa.binary()), pa.array(list(new), pa.binary())], ["lang", "phrase"])
            known |= new
            if sum(map(len, seen.values())) > HELD:
                seen.clear()

    return run


def _prefix(lang: bytes) -> bytes:
    """What the keys of a language begin with: no other newline than its last byte."""
    return lang.replace(b"\\", b"\\\\").replace(b"\n", b"\\n") + b"\n"


_TRIES = "trie string, number long, lang binary, phrase binary, part long, size long, arrays binary, ranges binary"


def _ranges(lang: list[bytes], phrase: list[bytes]) -> bytes:
    """For each language the lowest and the highest eight bytes that its phrases may begin with, whatever follows them."""
    out: dict[bytes, tuple[bytes, bytes]] = {}
    for a, b in zip(lang, phrase):
        low, high = b[:8].ljust(8, b"\0"), b[:8].ljust(8, b"\xff")
        was = out.get(a, (low, high))
        out[a] = min(was[0], low), max(was[1], high)
    return pickle.dumps({a: tuple(int.from_bytes(x, "big") for x in both) for a, both in out.items()})


def _build_tries(trie_bytes: int, part_bytes: int):
    """Ascending ``(lang, phrase)`` -> the tries, a row for each packed part of ``size`` bytes, and a row for each phrase with its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid
        from pyspark import TaskContext
        name = f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"

        def rows(lang: list, phrase: list, part: int) -> Iterator[pa.RecordBatch]:
            keys = [_prefix(a) + b for a, b in zip(lang, phrase)]
            order = sorted(range(len(keys)), key=keys.__getitem__)
            trie = double_array.build([keys[i] for i in order])
            arrays = b"".join(a.astype("<i4").tobytes() for a in trie)
            n, trie_id = len(keys), f"{name}-{part}"

            def batch(number, lang, phrase, piece, size, packed, ranges):
                kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                cols = [pa.array(x, kind) for x, kind in zip(([trie_id] * len(number), number, lang, phrase, piece, size, packed, ranges), kinds)]
                return pa.RecordBatch.from_arrays(cols, ["trie", "number", "lang", "phrase", "part", "size", "arrays", "ranges"])

            for piece, at in enumerate(range(0, len(arrays), part_bytes)):
                raw = arrays[at:at + part_bytes]
                yield batch([None], [None], [None], [piece], [len(raw)], [zlib.compress(raw, 1)], [None if piece else _ranges(lang, phrase)])
            for at in range(0, n, 10_000):
                some = order[at:at + 10_000]
                none = [None] * len(some)
                yield batch(list(range(at, at + len(some))), [lang[i] for i in some], [phrase[i] for i in some], none, none, none, none)

        lang, phrase, size, part = [], [], 0, 0
        for b in batches:
            for x, y in zip(*[c.to_pylist() for c in b.columns]):
                lang.append(x)
                phrase.append(y)
                size += len(x) + len(y) + 1
                if size >= trie_bytes:
                    yield from rows(lang, phrase, part)
                    lang, phrase, size, part = [], [], 0, part + 1
        if phrase:
            yield from rows(lang, phrase, part)

    return run


def _trie_of(arrays: bytes) -> double_array.Trie:
    return double_array.Trie(*np.frombuffer(arrays, "<i4").reshape(3, -1))


_COUNTS = "trie string, chunk long, wide long, cells binary"


def _count_phrases(tries, k: int):
    """Finds of every phrase of the tries ``[(id, broadcast arrays, ranges)]`` in a task's texts.

    A trie is walked from the words whose next eight bytes lie in its range.

    A row holds the counts of ``CHUNK`` phrases: places, then numbers of ``wide`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = [(name, _trie_of(arrays.value), ranges) for name, arrays, ranges in tries]
        counts = [np.zeros(int(t.accept.max()) + 1, np.int64) for _, t, _ in built]
        for lang, text, _, _ in _texts(batches, k):
            gap = _STOP[text]
            starts = (np.flatnonzero(gap[:-1] & ~gap[1:]) + 1).astype(np.int32)
            padded = np.concatenate([text, np.zeros(8, np.uint8)])
            begin = np.ndarray(len(text), ">u8", padded, strides=(1,))[starts].astype(np.uint64)
            for (_, trie, ranges), total in zip(built, counts):
                if lang in ranges:
                    low, high = map(np.uint64, ranges[lang])
                    found = np.bincount(double_array.match(trie, trie.walk(_prefix(lang)), text, starts[(begin >= low) & (begin <= high)], _STOP))
                    total[:len(found)] += found
        for (name, _, _), total in zip(built, counts):
            for chunk in range(-(-len(total) // CHUNK)):
                part = total[chunk * CHUNK:(chunk + 1) * CHUNK]
                at = np.flatnonzero(part)
                if len(at):
                    wide = 2 if part.max() < 1 << 16 else 8
                    cells = at.astype("<u2").tobytes() + part[at].astype(f"<i{wide}" if wide == 8 else "<u2").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([chunk]), pa.array([wide]), pa.array([cells], pa.binary())],
                                                     ["trie", "chunk", "wide", "cells"])

    return run


def _sum_counts(least: int):
    """Rows of a chunk next to each other -> ``(trie, number, n)`` of the phrases found at least ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(CHUNK, np.int64)

        def done() -> pa.RecordBatch:
            at = np.flatnonzero(total >= least)
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(at), pa.string()), pa.array(at + now[1] * CHUNK, pa.int64()), pa.array(total[at], pa.int64())],
                                              ["trie", "number", "n"])

        for batch in batches:
            for trie, chunk, wide, cells in zip(*[c.to_pylist() for c in batch.columns]):
                if (trie, chunk) != now:
                    if now is not None:
                        yield done()
                    now = trie, chunk
                    total[:] = 0
                n = len(cells) // (2 + wide)
                total[np.frombuffer(cells, "<u2", n)] += np.frombuffer(cells, "<u2" if wide == 2 else "<i8", n, 2 * n)
        if now is not None:
            yield done()

    return run


def _groups(sizes: list, limit: int) -> Iterator[list]:
    """What ``(name, bytes)`` name, in groups of at most ``limit`` bytes (or one)."""
    group, size = [], 0
    for name, n in sizes:
        if group and size + n > limit:
            yield group
            group, size = [], 0
        group.append(name)
        size += n
    if group:
        yield group


def _finds(spark: SparkSession, texts: DataFrame, found: DataFrame, k: int, min_count: int, trie_bytes: int, pass_bytes: int,
           part_bytes: int, gone: list[str]) -> tuple[DataFrame, int]:
    """``(lang, phrase, n)`` of the candidates found ``min_count`` times or more, and their finds."""
    total = found.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    spread = max(1, -(-total // trie_bytes))
    dealt = found.repartitionByRange(spread, "lang", "phrase").sortWithinPartitions("lang", "phrase") if spread > 1 else found.coalesce(1).sort("lang", "phrase")
    tries, path = save(dealt.mapInArrow(_build_tries(trie_bytes, part_bytes), _TRIES), "tries")
    gone.append(path)
    built = tries.where("arrays is not null")
    counts = None

    def piece(trie: str, part: int) -> Broadcast:
        return spark.sparkContext.broadcast(bytes(built.where((F.col("trie") == trie) & (F.col("part") == part)).select("arrays").collect()[0][0]))

    heads = sorted(built.groupBy("trie").agg(F.sum("size").alias("size"), F.count("*").alias("parts")).collect())
    parts = {r["trie"]: r["parts"] for r in heads}
    ranges = {r["trie"]: pickle.loads(bytes(r["ranges"])) for r in built.where("ranges is not null").select("trie", "ranges").collect()}
    for ids in _groups([(r["trie"], r["size"]) for r in heads], pass_bytes):
        sent = [(i, _Parts([piece(i, p) for p in range(parts[i])], _join_arrays), ranges[i]) for i in ids]
        finds = texts.mapInArrow(_count_phrases(sent, k), _COUNTS).repartition("trie", "chunk").sortWithinPartitions("trie", "chunk")
        some, path = save(finds.mapInArrow(_sum_counts(min_count), "trie string, number long, n long"), "finds")
        for _, arrays, _ in sent:
            arrays.destroy()
        gone.append(path)
        counts = some if counts is None else counts.unionByName(some)
    phrases = tries.where("number is not null").select("trie", "number", "lang", "phrase")
    if counts is None:
        return phrases.select("lang", "phrase", F.lit(0).cast("long").alias("n")).where("n > 0"), 0
    return phrases.join(counts, ["trie", "number"]).select("lang", "phrase", "n"), counts.agg(F.sum("n")).first()[0] or 0


def _level(spark: SparkSession, texts: DataFrame, below: DataFrame, k: int, min_count: int, bits: int, trie_bytes: int,
           pass_bytes: int, part_bytes: int) -> tuple[DataFrame, str]:
    """``(lang, phrase, n)`` of the frequent phrases of k words, given those of k - 1, saved."""
    gone: list[str] = []
    parts = _sent(_frequent(below.select("lang", "phrase").mapInArrow(_frequent_keys(bits), _KEYED), 1, bits, gone), "known", part_bytes)
    keys = _frequent(texts.mapInArrow(_bucket_counts(k, parts, bits), _KEYED), min_count, bits, gone)
    places = keys.agg(F.sum("places")).first()[0] or 0

    def collected(everywhere: bool) -> DataFrame:
        often = _sent(keys, "known" if everywhere else "owned", part_bytes)
        rows = texts.mapInArrow(_candidates(k, parts, often, bits, everywhere), "lang binary, phrase binary")
        got, path = save(rows.distinct(), "candidates")
        often.destroy()
        gone.append(path)
        return got

    found = collected(False)
    frequent, finds = _finds(spark, texts, found, k, min_count, trie_bytes, pass_bytes, part_bytes, gone)
    if places - finds >= min_count:
        rest = collected(True).join(found, ["lang", "phrase"], "left_anti")
        frequent = frequent.unionByName(_finds(spark, texts, rest, k, min_count, trie_bytes, pass_bytes, part_bytes, gone)[0])
    out, path = save(frequent, f"frequent{k}")
    parts.destroy()
    remove(spark, *gone)
    return out, path


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = 3, min_count: int = 10, bits: int = BITS,
                     trie_bytes: int = TRIE_BYTES, pass_bytes: int = PASS_BYTES, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, k, f)`` of the phrases of 1 to ``max_words`` words found ``min_count`` times or more, and ``(lang, n)``, all words.

    The broadcasts do not grow with the input: filters of at most
    ``2 ** bits`` bytes and tries of ``pass_bytes`` (or one trie); more
    candidates mean more passes over the texts.  The driver fetches and
    broadcasts them in parts of ``part_bytes``."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).cast("binary").alias("lang"),
                        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    with batch_limits(spark):
        words, path = save(texts.mapInArrow(_count_words, "lang binary, phrase binary, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "words")
        totals, _ = save(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        level, low = save(words.where(F.col("n") >= min_count), "frequent1")
        remove(spark, path)
        levels, paths = [level], [low]
        for k in range(2, max_words + 1):
            level, path = _level(spark, texts, level, k, min_count, bits, trie_bytes, pass_bytes, part_bytes)
            levels.append(level)
            paths.append(path)
    out = None
    for k, level in enumerate(levels, 1):
        part = level.select(F.col("lang").cast("string").alias("lang"), F.col("phrase").cast("string").alias("phrase"), F.lit(k).alias("k"), F.col("n").alias("f"))
        out = part if out is None else out.unionByName(part)
    out, _ = save(out, "frequent")
    remove(spark, *paths)
    return out, totals.select(F.col("lang").cast("string").alias("lang"), "n")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = 3, min_count: int = 10, covered: int = 50, top: int = 2000,
         **sizes) -> DataFrame:
    """The first ``top`` collocations of each language: ``(lang, rank, phrase, a, l, r, n, score)``.

    Words are what blanks and tabs part inside a piece, pieces what
    ``.,;:!?`` and line ends part, A-Z lower-cased.  A phrase of 2 to
    ``max_words`` words found a >= ``min_count`` times scores
    floor(1000000 a a / (l r)) at its weakest cut into a left part found l
    times and a right part found r times; of equal cuts the first counts.  It
    is dropped if it lies in a longer phrase found at least ``covered``
    percent as often.  Ranks go by score, then a, both descending, then the
    phrase by its bytes.  A null language is ``und``, together with a
    language of that name; a null text is empty; repeated rows count each
    time; an empty table gives no rows.  Other columns are not read.  All
    numbers are exact as long as counts stay below 10 ** 13."""
    known, totals = frequent_phrases(docs, text, lang, max_words, min_count, **sizes)
    words = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    long_ = known.where("k > 1").withColumn("words", words)
    cut = long_.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), "k")
    cut = cut.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    of = known.select("lang", "phrase", "f")
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(broadcast_if_small(of.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))), ["lang", side])
    a = F.col("a").cast("decimal(13,0)")
    lr = F.col("l").cast("decimal(13,0)") * F.col("r").cast("decimal(13,0)")
    cut = cut.withColumn("num", (a * a * F.lit(1_000_000).cast("decimal(7,0)"))).withColumn("den", lr).withColumn("score", F.expr("num div den"))
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("weakest"))
    inner = (long_.where("k > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
             .withColumn("from", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
             .select("lang", part(F.col("from"), F.col("size")).alias("phrase"), "f")
             .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    left = (scored.join(inner, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered))
            .select("lang", "phrase", "a", "weakest.l", "weakest.r", "weakest.score"))
    # a language of any size is ranked in ranges: rows of a range, and how many lie before it
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    ranged, _ = save(left.repartitionByRange("lang", *order).withColumn("range", F.spark_partition_id()), "ranked")
    sizes = ranged.groupBy("lang", "range").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = sizes.select("lang", "range", before.alias("before")).where(F.col("before") < top)
    within = F.row_number().over(Window.partitionBy("lang", "range").orderBy(*order))
    first = (ranged.join(ahead, ["lang", "range"]).withColumn("rank", within + F.col("before")).where(F.col("rank") <= top))
    return first.join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
