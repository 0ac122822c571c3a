"""Translation edit rate of a segment: edit distance in a band, and block shifts.

The definition is the usual one of the tercom family: phrases of up to
``MAX_SIZE`` words move over up to ``MAX_DIST`` words, a segment looks at
about ``MAX_CANDIDATES`` moves in all, and the edit distance stays within
``BEAM`` cells of the diagonal.  A move changes only the words between its old
and its new place, so all moves of a round are scored together from stored
rows: those before the place going forward, those after it going backward.
Segments of like length go through their rows side by side.  Memory and time
of a row are the band's, whatever the segment's length."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .similarity import edits_to, match_bits

# fixed values of the metric
MAX_SIZE = 10
MAX_DIST = 50
MAX_CANDIDATES = 1000
BEAM = 25

#: segments whose rows are computed side by side, and the cells that they hold together
GROUP = 1024
GROUP_CELLS = 1 << 21
#: cells of the moves' rows that are computed at once
ROW_CELLS = 1 << 16
#: cells of a row that one whole number's bits hold, and the memory of such a row in cells
BIT_CELLS, BIT_ROW = 53, 16
#: 64-bit words of the places of one segment's words
PLACE_WORDS = 1 << 19

_FAR = 1 << 24
_SKIP, _ADD = 2, 3


class Move(NamedTuple):
    size: int
    start: int
    target: int

    def region(self, n: int) -> tuple[int, int, int, int, int]:
        """First place and number of the words that change, and their new words: the first ``cut`` from the place
        ``head`` on, the others from ``tail`` on."""
        size, a, t = self
        if t < a:
            return t, a + size - t, size, a, t
        end = t if t > a + size else min(n, t + size)
        return a, end - a, end - a - size, a + size, a

    def apply(self, words: list) -> list:
        first, length, cut, head, tail = self.region(len(words))
        return words[:first] + words[head:head + cut] + words[tail:tail + length - cut] + words[first + length:]


def _widths(n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reference words a hypothesis word, and half the width of the band."""
    ratio = m / n
    return ratio, np.where(ratio / 2 <= BEAM, BEAM, np.ceil(ratio / 2 + BEAM)).astype(np.int64)


class _Shape:
    """Segments side by side, the longest hypothesis first, so that those with a row i are the first ones.  The cells
    of row i (hypothesis words read) that count: columns ``low[s, i]`` to ``high[s, i]``."""

    def __init__(self, hyps: list[list[int]], refs: list[list[int]]) -> None:
        self.n, self.m = (np.array([len(x) for x in side]) for side in (hyps, refs))
        ratio, half = _widths(self.n, self.m)
        tall, each = int(self.n[0]), np.arange(len(hyps))
        diag = np.floor(np.arange(tall + 1) * ratio[:, None]).astype(np.int64)
        self.low, self.high = np.maximum(diag - half[:, None], 0), np.minimum(diag + half[:, None] - 1, self.m[:, None])
        self.low[:, 0], self.high[:, 0] = 0, np.maximum(self.high[:, 0], self.high[:, 1])
        self.high[each, self.n] = self.m
        self.real = np.arange(tall + 1) <= self.n[:, None]
        self.low[~self.real] = self.high[~self.real] = 0
        self.wide = int((self.high - self.low).max()) + 1
        self.live = np.searchsorted(-self.n, -np.arange(tall + 1), "right")  # segments that have a row i


_ALL, _ONE = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(1)
_REVERSED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1), axis=1, bitorder="little").ravel()


def _reversed(x: np.ndarray) -> np.ndarray:
    """Bit b of every number as bit 63 - b."""
    return np.ascontiguousarray(_REVERSED[x.view(np.uint8).reshape(-1, 8)][:, ::-1]).view(np.uint64).reshape(x.shape)


def _up_to(cell: np.ndarray) -> np.ndarray:
    """The bits of cells 1 to ``cell``."""
    return (np.uint64(2) << cell.astype(np.uint64)) - np.uint64(2)


def _summed(plus: np.ndarray, minus: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """How far cell ``cell`` lies above cell 0."""
    some = _up_to(cell)
    return np.bitwise_count(plus & some).astype(np.int64) - np.bitwise_count(minus & some)


class _Bands(_Shape):
    """Segments whose rows fit into whole numbers: bits ``plus`` and ``minus`` of a cell say that it lies one above or
    below the cell before, ``base`` is the first cell.

    A row follows from the one before by Myers' step.  The cell before the
    band's first one is taken as one more than its diagonal, cells after the
    last row's end as rising by one each without a match: neither is ever on a
    best way that does not exist in the band.  Arrays are by (row, segment);
    both ways, from the begin and, with both sides turned round, from the end,
    are followed together."""

    def __init__(self, hyps: list[list[int]], refs: list[list[int]]) -> None:
        super().__init__(hyps, refs)
        n_seg, tall, each = len(hyps), len(self.live), np.arange(len(hyps))
        self.low, self.high = np.ascontiguousarray(self.low.T), np.ascontiguousarray(self.high.T)
        self.turned = np.maximum(self.n - np.arange(tall)[:, None], 0)  # the row i words before the end
        low, high = self._two(self.low, self.m - self.high[self.turned, each]), self._two(self.high, self.m - self.low[self.turned, each])
        real = self._two(self.real.T, self.real.T)[1:]
        step, edge = np.zeros_like(low), np.zeros_like(low)  # cells that the band moves on, the cell after the last row's end
        step[1:], edge[1:] = np.where(real, np.diff(low, axis=0), 0), np.where(real, high[:-1] - low[1:] + 1, 0)
        stays = (step == 0).astype(np.uint64)
        after = _ALL << edge.astype(np.uint64)
        # the shift, whether there is none, the cells that it does not fill, those that a match may lead to
        self.steps = step.astype(np.uint64), stays, after, ~(after << _ONE) & ~stays
        self.far = int(step.max(initial=0)) > 1
        col_h, col_r = (np.arange(int(x.sum())) - np.repeat(np.cumsum(x) - x, x) for x in (self.n, self.m))
        seg_h, seg_r = (np.repeat(each, x) for x in (self.n, self.m))
        flat_h, flat_r = (np.fromiter(chain.from_iterable(side), np.int64, len(seg)) for side, seg in ((hyps, seg_h), (refs, seg_r)))
        known = np.zeros(n_seg, np.int64)
        np.maximum.at(known, seg_r, flat_r + 1)
        first, self.row = np.cumsum(known) - known + 1, int(self.m.max()) // 64 + 2  # the places of a segment's word 0; 0 is a word without places
        words = int(known.sum()) + 1
        self.places = np.zeros(2 * words * self.row, np.uint64)  # the columns of each word as bits, counted from the begin, then from the end
        own = flat_r >= 0
        seg_r, col_r, at = seg_r[own], col_r[own], (first[seg_r[own]] + flat_r[own]) * self.row
        for more, column in ((0, col_r + 1), (words * self.row, self.m[seg_r] - col_r)):
            np.bitwise_or.at(self.places, at + more + column // 64, _ONE << (column % 64).astype(np.uint64))
        self.hyp = np.zeros((tall - 1, n_seg), np.int64)
        self.hyp[col_h, seg_h] = np.where(flat_h < 0, 0, first[seg_h] + flat_h) * self.row
        self.match = np.zeros(low.shape, np.uint64)
        self.match[1:] = self._matches(self._two(self.hyp, self.hyp[self.turned[1:], each] + words * self.row), low[1:]) & self.steps[3][1:]

    def _two(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The arrays of both ways, a segment's side by side."""
        return np.stack([begin, end], axis=2).reshape(len(begin), -1)

    def _matches(self, word: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The columns from ``low`` on that hold ``word``."""
        at, bit = word + (low >> 6), (low & 63).astype(np.uint64)
        return (np.take(self.places, at) >> bit) | ((np.take(self.places, at + 1) << _ONE) << (np.uint64(63) - bit))

    def forward(self, plus, minus, match, step, stays, after):
        """The next row of each, then the cells that their diagonal step leaves as they are and those that a left out word leads to."""
        plus = ((plus >> step) | after) & ~stays
        minus = (minus >> step) & ~after | stays
        zero = (((match & plus) + plus) ^ plus) | match | minus
        skip = minus | ~(zero | plus)
        up = (skip << _ONE) | _ONE
        return ((plus & zero) << _ONE) | ~(zero | up), up & zero, zero, skip

    def all_forward(self):
        """All rows both ways, and the cells that a match, that any diagonal step, and that anything but an added word
        leads to."""
        plus, minus = np.full(self.match.shape, _ALL), np.zeros(self.match.shape, np.uint64)
        zero, skip = np.zeros_like(minus), np.zeros_like(minus)
        steps = self.steps[:3]
        for i, k in enumerate((2 * self.live).tolist()):
            if i:
                plus[i, :k], minus[i, :k], zero[i, :k], skip[i, :k] = self.forward(plus[i - 1, :k], minus[i - 1, :k], self.match[i, :k], *(x[i, :k] for x in steps))
        rise = self.steps[1] + _ONE + (plus & _ONE) - (minus & _ONE)
        rise[0] = 0
        rise = rise.view(np.int64)
        if self.far:
            rise[1:] += _summed(plus[:-1], minus[:-1], np.maximum(self.steps[0][1:].view(np.int64) - 1, 0))
        self.both = plus, minus, np.cumsum(rise, axis=0)
        after = self.steps[2][:, ::2]
        match = self.match[:, ::2]
        cross = match | (~zero[:, ::2] & ~(after << _ONE))
        return [np.ascontiguousarray(x[:, ::2]) for x in self.both], (match, cross, cross | (skip[:, ::2] & ~after))

    def ends(self, ahead) -> list[int]:
        """The edit distances."""
        each = np.arange(len(self.n))
        plus, minus, base = (x[self.n, each] for x in ahead)
        return (base + _summed(plus, minus, self.m - self.low[self.n, each])).tolist()

    def all_backward(self):
        """What each cell still costs to the end: the rows from there, turned round."""
        plus, minus, base = (x[:, 1::2][self.turned, np.arange(len(self.n))] for x in self.both)
        last = self.high - self.low
        off = (62 - last).astype(np.uint64)
        return _reversed(minus) >> off, _reversed(plus) >> off, base + _summed(plus, minus, last)

    def scores(self, seg: np.ndarray, regions: np.ndarray, ahead, behind) -> np.ndarray:
        """The edit distance of segments ``seg`` after moves with the given regions."""
        out, n_seg = np.empty(len(seg), np.int64), len(self.n)
        order = np.argsort(-regions[:, 1], kind="stable")
        steps, lows, hyp = [np.ascontiguousarray(x[:, ::2]).ravel() for x in self.steps], self.low.ravel(), self.hyp.ravel()
        for part in (order[i:i + ROW_CELLS] for i in range(0, len(order), ROW_CELLS)):
            s, (first, length, cut, head, tail) = seg[part], regions[part].T
            at, base = first * n_seg + s, np.zeros(len(part), np.uint64)
            plus, minus, begun = (np.take(x.ravel(), at) for x in ahead)
            head, tail = head * n_seg + s, (tail - cut) * n_seg + s
            for t, live in enumerate(np.searchsorted(-length, -np.arange(int(length[0])), "left").tolist()):
                here = at[:live]
                here += n_seg
                match = self._matches(np.take(hyp, np.where(t < cut[:live], head[:live], tail[:live]) + t * n_seg), np.take(lows, here))
                step, stays, after, meets = (np.take(x, here) for x in steps)
                old = plus[:live], minus[:live]
                if self.far:
                    base[:live] += _summed(*old, np.maximum(step.view(np.int64) - 1, 0)).view(np.uint64)
                now = self.forward(*old, match & meets, step, stays, after)
                plus[:live], minus[:live] = now[:2]
                base[:live] += stays + _ONE + (now[0] & _ONE) - (now[1] & _ONE)
            b_plus, b_minus, b_base = (np.take(x.ravel(), at) for x in behind)
            some = _up_to(np.take((self.high - self.low).ravel(), at))
            rise = [np.unpackbits((x & some).view(np.uint8).reshape(-1, 8), axis=1, count=64, bitorder="little").view(np.int8) for x in (plus, minus, b_plus, b_minus)]
            rise = rise[0] - rise[1] + rise[2] - rise[3]
            out[part] = begun + base.view(np.int64) + b_base + np.add.accumulate(rise, axis=1, dtype=np.int8).min(axis=1)
        return out

    def traces(self, ways) -> list[tuple[list[int], list[bool], list[bool]]]:
        """:func:`_trace` of every segment, a row of all at a time."""
        n_seg = len(self.n)
        column, right = np.zeros((len(self.live) + 1, n_seg), np.int64), np.zeros(self.low.shape, bool)  # column 0 before row 0
        column[self.n + 1, np.arange(n_seg)] = self.m
        for i in range(len(self.live) - 1, 0, -1):
            k = int(self.live[i])
            low = self.low[i, :k]
            left = ways[2][i, :k] & ((np.uint64(2) << (column[i + 1, :k] - low).astype(np.uint64)) - _ONE)
            top = np.frexp(left.astype(np.float64))[1] - 1  # words up to there are added
            bit = top.astype(np.uint64)
            right[i, :k] = ways[0][i, :k] >> bit & _ONE
            column[i, :k] = low + top - (ways[1][i, :k] >> bit & _ONE).astype(np.int64)
        added = np.where(self.real, np.diff(column, axis=0).T, 0)
        align = np.repeat(np.broadcast_to(np.arange(-1, len(self.live) - 1), added.shape)[self.real], added[self.real])
        start = np.cumsum(self.m) - self.m
        good = right[1:].T
        ref_wrong = np.ones(len(align), bool)
        ref_wrong[(column[1:-1].T + start[:, None])[good]] = False
        hyp_wrong = ~good[self.real[:, 1:]]
        align, ref_wrong, hyp_wrong = align.tolist(), ref_wrong.tolist(), hyp_wrong.tolist()
        cut = zip((np.cumsum(self.n) - self.n).tolist(), self.n.tolist(), start.tolist(), self.m.tolist())
        return [(align[b:b + m], ref_wrong[b:b + m], hyp_wrong[a:a + n]) for a, n, b, m in cut]


class _WideBands(_Shape):
    """Segments of any band and length; rows hold their cells."""

    def __init__(self, hyps: list[list[int]], refs: list[list[int]]) -> None:
        super().__init__(hyps, refs)
        self.cell, self.cell32 = np.arange(self.wide), np.arange(self.wide, dtype=np.int32)
        self.step = int(np.where(self.real[:, 1:], np.diff(self.low), 0).max(initial=0)) + 2
        self.hyp = np.full((len(hyps), int(self.n[0])), -3)
        self.ref = np.full((len(refs), int(self.m.max()) + self.wide + 2), -1)  # the word read on entering column j
        for s, (h, r) in enumerate(zip(hyps, refs)):
            self.hyp[s, :len(h)], self.ref[s, 1:len(r) + 1] = h, r

    def ends(self, ahead: np.ndarray) -> list[int]:
        each = np.arange(len(self.n))
        return ahead[each, self.n, self.m - self.low[each, self.n]].tolist()

    def forward(self, rows: np.ndarray, seg: np.ndarray, to: np.ndarray, words: np.ndarray, ways: np.ndarray | None = None) -> np.ndarray:
        """Rows ``to`` of segments ``seg`` from the rows before them, reading one word each; ``ways`` takes the last step to each cell."""
        low = self.low[seg, to]
        held = np.full((len(rows), self.wide + self.step + 1), _FAR, np.int32)
        held[:, 1:self.wide + 1] = rows
        at = (np.arange(len(rows)) * held.shape[1] + low - self.low[seg, to - 1])[:, None] + self.cell
        read = np.take(self.ref, (seg * self.ref.shape[1] + low)[:, None] + self.cell)
        wrong = read != words[:, None]
        both = np.take(held, at) + wrong
        at += 1
        skip = np.take(held, at) + 1
        best = np.minimum(both, skip)
        out = self.cell > (self.high[seg, to] - low)[:, None]
        best[out] = _FAR
        best -= self.cell32
        np.minimum.accumulate(best, axis=1, out=best)
        best += self.cell32
        best[out] = _FAR
        if ways is not None:
            ways[:] = np.where(best == both, wrong, np.where(best == skip, _SKIP, _ADD))
        return best

    def all_forward(self) -> tuple[np.ndarray, np.ndarray]:
        """All rows, and the last step to each cell: ``_SKIP`` a hypothesis word, ``_ADD`` a reference word, or both,
        whether they differ."""
        rows = np.full((len(self.n), len(self.live), self.wide), _FAR, np.int32)
        ways = np.full(rows.shape, _ADD, np.int8)
        rows[:, 0] = np.where(self.cell <= self.high[:, :1], self.cell, _FAR)
        seg = np.arange(len(self.n))
        for i in range(1, len(self.live)):
            k = int(self.live[i])
            rows[:k, i] = self.forward(rows[:k, i - 1], seg[:k], np.full(k, i), self.hyp[:k, i - 1], ways[:k, i])
        return rows, ways

    def all_backward(self) -> np.ndarray:
        """What each cell still costs to the end."""
        rows = np.full((len(self.n), len(self.live), self.wide), _FAR, np.int32)
        each = np.arange(len(self.n))
        left = (self.m - self.low[each, self.n])[:, None] - self.cell
        rows[each, self.n] = np.where(left >= 0, left, _FAR)
        back = self.cell32[::-1]
        for i in range(len(self.live) - 1, 0, -1):
            k = int(self.live[i])
            low = self.low[:k, i - 1]
            held = np.full((k, self.wide + self.step + 1), _FAR, np.int32)
            held[:, self.step:self.step + self.wide] = rows[:k, i]
            at = (each[:k] * held.shape[1] + self.step - (self.low[:k, i] - low))[:, None] + self.cell
            read = np.take(self.ref, (each[:k] * self.ref.shape[1] + low + 1)[:, None] + self.cell)
            best = np.take(held, at) + 1
            at += 1
            np.minimum(best, np.take(held, at) + (read != self.hyp[:k, i - 1, None]), out=best)
            out = self.cell > (self.high[:k, i - 1] - low)[:, None]
            best[out] = _FAR
            best = np.minimum.accumulate((best - back)[:, ::-1], axis=1)[:, ::-1] + back
            best[out] = _FAR
            rows[:k, i - 1] = best
        return rows

    def scores(self, seg: np.ndarray, regions: np.ndarray, ahead: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """The edit distance of segments ``seg`` after moves with the given regions."""
        out = np.empty(len(seg), np.int64)
        order = np.argsort(-regions[:, 1], kind="stable")
        most = max(1, ROW_CELLS // self.wide)
        for part in (order[i:i + most] for i in range(0, len(order), most)):
            s, (first, length, cut, head, tail) = seg[part], regions[part].T
            rows = ahead[s, first]
            for t in range(int(length[0])):
                live = int(np.searchsorted(-length, -t, "left"))
                words = self.hyp[s[:live], np.where(t < cut[:live], head[:live] + t, tail[:live] + t - cut[:live])]
                rows[:live] = self.forward(rows[:live], s[:live], first[:live] + t + 1, words)
            out[part] = (rows + behind[s, first + length]).min(axis=1)
        return out

    def traces(self, ways: np.ndarray) -> list[tuple[list[int], list[bool], list[bool]]]:
        """:func:`_trace` of every segment, a step of all at a time."""
        align = np.zeros((len(self.m), int(self.m.max())), np.int64)
        ref_wrong, hyp_wrong = np.zeros(align.shape, bool), np.zeros((len(self.m), len(self.live)), bool)
        s, i, j = np.arange(len(self.m)), self.n.copy(), self.m.copy()
        while len(s):
            way = np.where(i > 0, ways[s, i, np.where(i > 0, j - self.low[s, i], 0)], _ADD)
            i, j = i - (way != _ADD), j - (way != _SKIP)
            hyp_wrong[s, i] |= (way == 1) | (way == _SKIP)
            x = way != _SKIP
            align[s[x], j[x]] = np.where(way == _ADD, i - 1, i)[x]
            ref_wrong[s[x], j[x]] = way[x] > 0
            on = (i > 0) | (j > 0)
            if not on.all():
                s, i, j = s[on], i[on], j[on]
        return [(align[k, :m].tolist(), ref_wrong[k, :m].tolist(), hyp_wrong[k, :n].tolist()) for k, (n, m) in enumerate(zip(self.n.tolist(), self.m.tolist()))]


def _trace(cost, sub, n: int, m: int) -> tuple[list[int], list[bool], list[bool]]:
    """For each reference word the hypothesis place it meets, and which words of either side are wrong."""
    align, ref_wrong, hyp_wrong = [0] * m, [False] * m, [False] * n
    i, j = n, m
    while i or j:
        if i and j and cost(i, j) == cost(i - 1, j - 1) + sub(i - 1, j - 1):
            i, j = i - 1, j - 1
            align[j] = i
            ref_wrong[j] = hyp_wrong[i] = bool(sub(i, j))
        elif i and cost(i, j) == cost(i - 1, j) + 1:
            i -= 1
            hyp_wrong[i] = True
        else:
            j -= 1
            align[j], ref_wrong[j] = i - 1, True
    return align, ref_wrong, hyp_wrong


def _moves(hyp: list[int], ref: list[int], places: dict[int, list[int]], align: list[int], ref_wrong: list[bool], hyp_wrong: list[bool],
           seen: int) -> Iterator[list[Move]]:
    """The moves of each common phrase that is wrong on both sides, next to the words its reference place meets."""
    for start, word in enumerate(hyp):
        for at in places.get(word, ()) if word >= 0 else ():
            if abs(at - start) > MAX_DIST:
                continue
            hyp_bad = ref_bad = False
            for size in range(1, min(MAX_SIZE, len(hyp) - start, len(ref) - at) + 1):
                if hyp[start + size - 1] != ref[at + size - 1]:
                    break
                hyp_bad |= hyp_wrong[start + size - 1]
                ref_bad |= ref_wrong[at + size - 1]
                if not hyp_bad or not ref_bad or start <= align[at] < start + size:
                    continue
                targets: list[int] = []
                for near in range(at - 1, min(at + size, len(ref))):
                    target = align[near] + 1 if near >= 0 else 0
                    if not targets or targets[-1] != target:
                        targets.append(target)
                yield [Move(size, start, t) for t in targets]
                seen += len(targets)
                if seen >= MAX_CANDIDATES:
                    return


def _best(moves: list[Move], scores: list[int]) -> tuple[int, Move]:
    """The lowest score; of equals the longest phrase, then the earliest start, then the earliest target."""
    score, size, start, target = min((s, -m.size, m.start, m.target) for s, m in zip(scores, moves))
    return score, Move(-size, start, target)


def _round_short(hyp: list[int], ref: list[int], bits) -> tuple[int, object, object]:
    """Distance, trace and scorer where the band holds every cell."""
    rows = [list(range(len(ref) + 1))]
    for word in hyp:
        last, row = rows[-1], [rows[-1][0] + 1]
        for j, r in enumerate(ref, 1):
            row.append(min(last[j - 1] + (word != r), last[j] + 1, row[-1] + 1))
        rows.append(row)
    trace = _trace(lambda i, j: rows[i][j], lambda i, j: hyp[i] != ref[j], len(hyp), len(ref))
    return rows[-1][-1], trace, lambda moves: [edits_to(bits, len(ref), m.apply(hyp)) for m in moves]


class _Search:
    """The state of one segment's search."""

    def __init__(self, hyp_words, ref_words) -> None:
        number = {w: i for i, w in enumerate(set(hyp_words).intersection(ref_words))}
        # words of one side only have no number
        self.ref = [number.get(w, -1) for w in ref_words]
        self.hyp = [number.get(w, -2) for w in hyp_words]
        self.places: dict[int, list[int]] = {}
        for i, w in enumerate(self.ref):
            if w >= 0:
                self.places.setdefault(w, []).append(i)
        self.shifts = self.seen = 0
        n, m = len(self.hyp), len(self.ref)
        self.wide = int(min(2 * _widths(np.array(n), np.array(m))[1], m + 1))
        self.bits = m <= BEAM * n and self.wide <= BIT_CELLS and len(number) * (m // 64 + 2) <= PLACE_WORDS

    def moves(self, distance: int, trace) -> list[Move]:
        """What to score in this round; nothing when the search ends here."""
        self.distance = distance
        found = [m for group in _moves(self.hyp, self.ref, self.places, *trace, self.seen) for m in group]
        self.seen += len(found)
        return list(dict.fromkeys(found)) if self.seen < MAX_CANDIDATES else []

    def go_on(self, moves: list[Move], scores: list[int]) -> bool:
        """Makes the best move, if it lowers the distance; whether words are still wrong then."""
        after, move = _best(moves, scores)
        if after >= self.distance:
            return False
        self.hyp, self.shifts, self.distance = move.apply(self.hyp), self.shifts + 1, after
        return self.hyp != self.ref


def _search_short(x: _Search) -> None:
    bits = match_bits(x.ref)
    while True:
        distance, trace, score = _round_short(x.hyp, x.ref, bits)
        moves = x.moves(distance, trace)
        if not moves or not x.go_on(moves, score(moves)):
            return


def _round_long(group: list[_Search]) -> list[_Search]:
    """One round of segments side by side; those that go on."""
    bands = (_Bands if group[0].bits else _WideBands)([x.hyp for x in group], [x.ref for x in group])
    ahead, ways = bands.all_forward()
    found = [x.moves(d, trace) for x, d, trace in zip(group, bands.ends(ahead), bands.traces(ways))]
    if not any(found):
        return []
    sizes = [len(f) for f in found]
    regions = np.array([m.region(len(x.hyp)) for x, f in zip(group, found) for m in f])
    scores = bands.scores(np.repeat(np.arange(len(group)), sizes), regions, ahead, bands.all_backward()).tolist()
    ends = np.cumsum(sizes).tolist()
    return [x for x, f, end in zip(group, found, ends) if f and x.go_on(f, scores[end - len(f):end])]


def _side_by_side(found: list[_Search]) -> Iterator[list[_Search]]:
    """Segments of like band and length, as many as ``GROUP`` and ``GROUP_CELLS`` allow (always one)."""
    group: list[_Search] = []
    widest = tall = 0
    for x in sorted(found, key=lambda x: (x.bits, 0 if x.bits else x.wide // BEAM, -len(x.hyp))):
        wide, rows = BIT_ROW if x.bits else x.wide, len(x.hyp) + 1
        widest, tall = max(widest, wide), max(tall, rows)
        if group and (len(group) == GROUP or x.bits != group[0].bits or (len(group) + 1) * widest * tall > GROUP_CELLS):
            yield group
            group, widest, tall = [], wide, rows
        group.append(x)
    if group:
        yield group


def ter_edits_of(pairs, short: int = BEAM) -> list[tuple[int, int]]:
    """(edits, reference length) of each segment ``(hypothesis words, reference words)``: shifts, and the edit distance
    after them.

    Each round makes the move that lowers the distance most; the search ends
    when none does, or when ``MAX_CANDIDATES`` moves have been looked at
    (those of the round in which that happens are not made).  Rounds of
    segments longer than ``short`` are computed side by side."""
    out: list = []
    long = []
    for hyp, ref in pairs:
        if not hyp or not ref or hyp == ref:
            out.append((0 if hyp == ref else max(len(hyp), len(ref)), len(ref)))
            continue
        out.append(_Search(hyp, ref))
        out[-1].distance = 0
        if max(len(hyp), len(ref)) <= short:
            _search_short(out[-1])
        else:
            long.append(out[-1])
    while long:
        long = [x for group in _side_by_side(long) for x in _round_long(sorted(group, key=lambda x: -len(x.hyp)))]
    return [(x.shifts + x.distance, len(x.ref)) if isinstance(x, _Search) else x for x in out]


def ter_edits(hyp_words, ref_words, short: int = BEAM) -> tuple[int, int]:
    """:func:`ter_edits_of` one segment."""
    return ter_edits_of([(list(hyp_words), list(ref_words))], short)[0]


def ter_words(s: str) -> list[str]:
    """TER's default normalisation: lower case, whitespace split."""
    return s.lower().split() if s else []


@F.pandas_udf(T.ArrayType(T.LongType()))
def ter_stats(h: pd.Series, r: pd.Series) -> pd.Series:
    return pd.Series([list(x) for x in ter_edits_of((ter_words(a or ""), ter_words(b or "")) for a, b in zip(h, r))])
