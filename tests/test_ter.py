"""TER: the banded, batch-scored search against a plain one."""

import random
import time

import pytest

from parallax.functions import ter as T

FAR = 1 << 20


def table(hyp, ref):
    """Edit distances of all beginnings within the band, row by row."""
    n, m = len(hyp), len(ref)
    half = T.BEAM if m / n / 2 <= T.BEAM else -(-(m / n / 2 + T.BEAM) // 1)
    rows = [list(range(m + 1))]
    for i in range(1, n + 1):
        diag = int(i * (m / n) // 1)
        row = [FAR] * (m + 1)
        for j in range(m + 1):
            if j < diag - half or (j > diag + half - 1 and i < n):
                continue
            row[j] = rows[-1][j] + 1
            if j:
                row[j] = min(row[j], row[j - 1] + 1, rows[-1][j - 1] + (hyp[i - 1] != ref[j - 1]))
        rows.append(row)
    return rows


def path(rows, hyp, ref):
    """Met hypothesis place of each reference word and the errors of both sides, from the last cell back."""
    i, j, align, bad_ref, bad_hyp = len(hyp), len(ref), {}, set(), set()
    while i or j:
        same = i and j and hyp[i - 1] == ref[j - 1]
        if i and j and rows[i][j] == rows[i - 1][j - 1] + (not same):
            i, j = i - 1, j - 1
            align[j] = i
            if not same:
                bad_ref.add(j)
                bad_hyp.add(i)
        elif i and rows[i][j] == rows[i - 1][j] + 1:
            i -= 1
            bad_hyp.add(i)
        else:
            j -= 1
            align[j] = i - 1
            bad_ref.add(j)
    return align, bad_ref, bad_hyp


def moved(words, start, size, target):
    rest = words[:start] + words[start + size:]
    block = words[start:start + size]
    if target < start:
        return rest[:target] + block + rest[target:]
    if target > start + size:
        return rest[:target - size] + block + rest[target - size:]
    return rest[:target] + block + rest[target:]


def plain(hyp, ref):
    if not ref or not hyp:
        return max(len(hyp), len(ref)), len(ref)
    shifts = tried = 0
    while True:
        rows = table(hyp, ref)
        align, bad_ref, bad_hyp = path(rows, hyp, ref)
        found = []
        for start in range(len(hyp)):
            for at in range(len(ref)):
                for size in range(1, T.MAX_SIZE + 1):
                    if tried >= T.MAX_CANDIDATES or abs(at - start) > T.MAX_DIST or hyp[start:start + size] != ref[at:at + size] or start + size > len(hyp) \
                            or at + size > len(ref):
                        break
                    if not bad_hyp & set(range(start, start + size)) or not bad_ref & set(range(at, at + size)) or start <= align[at] < start + size:
                        continue
                    last = None
                    for near in range(at - 1, min(at + size, len(ref))):
                        target = align[near] + 1 if near >= 0 else 0
                        if target != last:
                            last = target
                            tried += 1
                            new = moved(hyp, start, size, target)
                            found.append((table(new, ref)[-1][-1], -size, start, target, new))
        if tried >= T.MAX_CANDIDATES or not found or min(found)[0] >= rows[-1][-1]:
            return shifts + rows[-1][-1], len(ref)
        hyp, shifts = min(found)[4], shifts + 1


@pytest.mark.parametrize("words,longest,runs", [("ab", 6, 150), ("abcdef", 14, 120), ("abcdefghijklmnopq", 24, 60)])
def test_against_the_plain_search(words, longest, runs):
    rng = random.Random(longest)
    for _ in range(runs):
        hyp, ref = ([rng.choice(words) for _ in range(rng.randint(0, longest))] for _ in range(2))
        assert T.ter_edits(hyp, ref) == T.ter_edits(hyp, ref, short=0) == plain(hyp, ref), (hyp, ref)


@pytest.mark.parametrize("n,m", [(60, 60), (40, 90), (90, 40), (3, 120), (120, 3), (1, 70), (70, 1)])
def test_long_segments_against_the_plain_search(n, m):
    rng = random.Random(n)
    words = [f"w{i}" for i in range(max(n, m) * 2)]
    for _ in range(2):
        ref = [rng.choice(words) for _ in range(m)]
        hyp = (ref * (1 + n // m))[:n]
        for _ in range(4):
            at, to = rng.randrange(n), rng.randrange(n)
            block = hyp[at:at + 4]
            hyp = hyp[:at] + hyp[at + 4:]
            hyp[to:to] = block
            hyp[rng.randrange(n)] = rng.choice(words)
        assert T.ter_edits(hyp, ref) == plain(hyp, ref)


def test_segments_side_by_side(monkeypatch):
    rng = random.Random(7)
    pairs = []
    for _ in range(300):
        n, m = rng.choice([(60, 60), (30, 70), (70, 30), (1, 90), (90, 1), (26, 4), (5, 5), (0, 40), (40, 0)])
        ref = [rng.randrange(rng.choice([3, 30])) for _ in range(m)]
        hyp = ref[:n] + [rng.randrange(30) for _ in range(n - m)]
        if hyp:
            at, to = rng.randrange(len(hyp)), rng.randrange(len(hyp))
            hyp[to:to] = hyp[at:at + 3]
        pairs.append((hyp, ref))
    alone = [T.ter_edits(h, r) for h, r in pairs]
    assert alone[:60] == [plain(h, r) for h, r in pairs[:60]]
    rows = []
    forward = T._Bands.forward
    monkeypatch.setattr(T._Bands, "forward", lambda self, x, *a: rows.append(len(x)) or forward(self, x, *a))
    assert T.ter_edits_of(pairs) == alone
    assert len(rows) * 10 < sum(rows)  # many segments a step
    monkeypatch.setattr(T, "GROUP", 3)
    monkeypatch.setattr(T, "ROW_CELLS", 100)
    assert T.ter_edits_of(pairs) == alone


def test_rows_of_bits_and_rows_of_cells(monkeypatch):
    rng = random.Random(11)
    pairs = []
    for _ in range(400):
        n, m = rng.choice([(rng.randint(26, 90), rng.randint(26, 90)), (rng.randint(1, 5), rng.randint(26, 125)), (rng.randint(26, 150), rng.randint(1, 5))])
        words = rng.choice([2, 20, 200])
        ref = [rng.randrange(words) for _ in range(m)]
        hyp = (ref * (n // m + 1))[:n]
        for _ in range(rng.randint(0, 5)):
            at, to = rng.randrange(n), rng.randrange(n)
            hyp[at:at + 5], hyp[to:to] = [], hyp[at:at + 5]
            hyp[rng.randrange(n)] = rng.randrange(words + 3)
        pairs.append((hyp, ref))
    steps = []
    forward = T._Bands.forward
    monkeypatch.setattr(T._Bands, "forward", lambda self, plus, *a: steps.append(plus.shape) or forward(self, plus, *a))
    bits = T.ter_edits_of(pairs)
    assert steps and all(len(x) == 1 for x in steps)  # a whole number a row, not its cells
    monkeypatch.setattr(T, "PLACE_WORDS", -1)
    steps.clear()
    assert T.ter_edits_of(pairs) == bits and not steps


def test_goldens():
    assert T.ter_edits("a b c d".split(), "c d a b".split()) == (1, 4)
    assert T.ter_edits("a b c".split(), "a b c".split()) == (0, 3)
    assert T.ter_edits([], "a b".split()) == (2, 2)
    assert T.ter_edits("a b".split(), []) == (2, 0)
    assert T.ter_edits([], []) == (0, 0)
    ref = "saudi arabia denied this week information published in the american new york times".split()
    hyp = "this week the saudis denied information published in the new york times".split()
    assert T.ter_edits(hyp, ref) == (4, 13)  # the example of the metric's paper


def test_thousand_words_take_a_moment():
    rng = random.Random(1)
    ref = [f"w{rng.randrange(1000)}" for _ in range(1000)]
    hyp = ref[:]
    rng.shuffle(hyp)
    start = time.perf_counter()
    edits, n = T.ter_edits(hyp, ref)
    assert n == 1000 and 0 < edits <= 1000
    assert time.perf_counter() - start < 3  # 0.1 to 0.3 s on a quiet machine


def test_long_lines_in_spark(spark):
    from parallax.operators import metrics as M
    from parallax.plans import fixtures as fx
    from tests.conftest import SF_SMALL
    rows = fx.pairs_docs(spark, SF_SMALL).select("lang", "source", "target").collect()
    want = {}
    for r in rows:
        e, n = T.ter_edits(T.ter_words(r["source"]), T.ter_words(r["target"]))
        a, b = want.get(r["lang"], (0, 0))
        want[r["lang"]] = a + e, b + n
    got = {r["lang"]: (r["edits"], r["ref_words"]) for r in M.ter(fx.pairs_docs(spark, SF_SMALL), "source", "target", keys=["lang"]).collect()}
    assert got == want and max(len(r["source"].split()) for r in rows) > T.BEAM
