"""Phrase mining against a plain count, and the tries against a dictionary."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from parallax.llm import double_array, phrases


def plain(docs, max_words, min_count, covered, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        known = {p: c for p, c in counts.items() if c >= min_count}
        rows = []
        for p, a in known.items():
            if len(p) < 2:
                continue
            score, _, left, right = min((1_000_000 * a * a // (known[p[:i]] * known[p[i:]]), i, known[p[:i]], known[p[i:]]) for i in range(1, len(p)))
            longer = max((c for q, c in known.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))), default=0)
            if longer * 100 < covered * a:
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def mined(spark, docs, **options):
    df = spark.createDataFrame(docs, "text string, lang string").repartition(3)
    return sorted(tuple(r) for r in phrases.mine(df, bits=16, **options).collect())


def made_up(seed, n, long_words=False):
    rng = random.Random(seed)
    words = ["The", "the", "of", "a", "|", "été", "naïve", "x" * 300 if long_words else "x", "中文", "a\x1cb", " ", "-"]
    docs = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 60)):
            parts.append(rng.choice(words[:rng.randint(1, len(words))]))
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " \x0b"]))
        docs.append(("".join(parts), rng.choice(["en", "en", "de", None, "und", "a\nb", ""])))
    return docs + [(None, "en"), ("", None), ("   ", "fr"), (",,;", "fr")]


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"min_count": 3, "covered": 80, "top": 7}), (3, {"max_words": 4, "min_count": 4}), (4, {"max_words": 2})])
def test_against_plain_counts(spark, seed, options):
    docs = made_up(seed, 60, seed == 3)
    full = {"max_words": 3, "min_count": 10, "covered": 50, "top": 2000} | options
    assert mined(spark, docs, **full) == plain(docs, **full)


def test_many_tries_and_passes_change_nothing(spark):
    docs = made_up(5, 80)
    assert mined(spark, docs, trie_bytes=200, pass_bytes=60_000) == mined(spark, docs)


def test_the_driver_sends_tries_in_small_parts(spark, monkeypatch):
    docs, sent = made_up(5, 80), []
    broadcast = type(spark.sparkContext).broadcast

    def seen(self, value):
        sent.extend([len(value)] if isinstance(value, bytes) else [])
        return broadcast(self, value)

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", seen)
    assert mined(spark, docs, part_bytes=1000) == plain(docs, 3, 10, 50, 2000)
    assert len(sent) > 10 and max(sent) <= 1100


def test_no_rows_and_other_columns(spark):
    empty = spark.createDataFrame([], "text string, lang string, phrase string, n long")
    assert phrases.mine(empty, bits=16).collect() == []
    df = spark.createDataFrame([("a b " * 12, "en", "p", 7, 1.0)], "text string, lang string, phrase string, n long, score double")
    got = phrases.mine(df, bits=16).collect()
    assert {r["phrase"] for r in got} == {"a b a", "b a b"} and got[0]["n"] == 24


def test_session_limits_come_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    phrases.mine(spark.createDataFrame([("a b", "en")], "text string, lang string"), bits=16).collect()
    assert spark.conf.get(key) == before


@pytest.mark.parametrize("text", ["a b. " * 90, "a b " * 100, "ab" * 300, "a b c " + "x" * 500 + " d e f " * 40, " \t" * 300, "a.b " * 120])
@pytest.mark.parametrize("k", [2, 3])
def test_slices_hold_each_phrase_once(monkeypatch, text, k):
    monkeypatch.setattr(phrases, "SLICE", 16)
    parts = list(phrases._slices(text.encode(), k))

    def count(raw):
        text, keep = phrases._fold(raw)
        words = phrases.Words(text[keep], 0)
        first = words.whole(k)
        low = words.text.tobytes()
        return Counter(low[words.start[i]:words.end[i + k - 1]] for i in first)

    assert sum(map(count, parts), Counter()) == count(text.encode())
    assert len(parts) > 1 or len(text.split()) < k or b" " not in text.strip().encode()


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), min_size=1, max_size=80))
def test_trie_holds_its_keys_and_no_others(keys):
    keys = sorted(keys)
    trie = double_array.build(keys)
    assert [int(trie.accept[trie.walk(k)]) for k in keys] == list(range(len(keys)))
    for k in keys:
        for other in (k[:-1], k + b"\x00", k + b"\xff"):
            state = trie.walk(other)
            assert (state >= 0 and trie.accept[state] >= 0) == (other in keys)


def test_match_counts_whole_words():
    trie = double_array.build([b"a b", b"a bc"])
    text = np.frombuffer(b"\na b a bc\na bcd\na b\n", np.uint8)
    stop = np.zeros(256, bool)
    stop[[10, 32]] = True
    starts = np.flatnonzero(stop[text[:-1]] & ~stop[text[1:]]) + 1
    assert sorted(double_array.match(trie, 0, text, starts, stop).tolist()) == [0, 0, 1]


def test_phrases_that_share_a_bucket_are_all_found(spark):
    """Nearly all of 32,768 buckets hold several phrases, most of them from documents of other classes."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(250)]
    docs = [(", ".join(words * 12), "en")]
    docs += [(". ".join(f"{rng.choice(words)} {rng.choice(words)}" for _ in range(600)), "en") for _ in range(60)]
    docs += [(". ".join([f"{rng.choice(words)} {rng.choice(words)} z{i}"] * 12), "en") for i in range(80)]
    options = {"max_words": 3, "min_count": 10, "covered": 101, "top": 2000}
    df = spark.createDataFrame(docs, "text string, lang string").repartition(3)
    assert sorted(tuple(r) for r in phrases.mine(df, bits=15, **options).collect()) == plain(docs, **options)


def test_rare_phrases_do_not_become_candidates_together(spark, monkeypatch):
    """A dozen rare phrases a bucket: each is counted by itself, so that only the frequent ones and a few others are looked up."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    docs = [(". ".join(f"{rng.choice(words)} {rng.choice(words)}" for _ in range(10_000)), "en") for _ in range(40)]
    docs += [(f"{words[i]} {words[-i - 1]}. " * 12, "en") for i in range(50)]
    found = []
    finds = phrases._finds
    monkeypatch.setattr(phrases, "_finds", lambda spark, texts, rows, *a: found.append(rows.count()) or finds(spark, texts, rows, *a))
    options = {"max_words": 2, "min_count": 12, "covered": 50, "top": 2000}
    df = spark.createDataFrame(docs, "text string, lang string").repartition(3)
    assert sorted(tuple(r) for r in phrases.mine(df, bits=15, **options).collect()) == plain(docs, **options)
    assert 50 <= found[0] < 2000 and len(found) == 1


def test_tries_are_walked_from_words_of_their_range_only(spark, monkeypatch):
    rows = spark.createDataFrame([(b"en", x) for x in (b"a b", b"a\x1cb c", b"b a")], "lang binary, phrase binary").coalesce(1)
    built = rows.mapInArrow(phrases._build_tries(1 << 20, 1 << 20), phrases._TRIES).where("arrays is not null").first()
    ranges = phrases.pickle.loads(bytes(built["ranges"]))
    assert ranges == {b"en": (int.from_bytes(b"a\x1cb c\0\0\0", "big"), int.from_bytes(b"b a" + b"\xff" * 5, "big"))}
    walked = []
    match = double_array.match
    monkeypatch.setattr(double_array, "match", lambda trie, root, text, starts, stop: walked.append(len(starts)) or match(trie, root, text, starts, stop))
    tries = [("t", type("Sent", (), {"value": phrases.zlib.decompress(bytes(built["arrays"]))}), ranges)]
    text = phrases._counted([b"en"], [b"A b a b, zz a\x1cb c 0 b a"], [0]).select(["lang", "phrase"])
    rows = list(phrases._count_phrases(tries, 2)(iter([text])))
    assert walked == [6]  # not zz, c, 0 and the last a
    cells = np.frombuffer(rows[0].column("cells")[0].as_py(), "<u2")
    assert dict(zip(cells[:3].tolist(), cells[3:].tolist())) == {0: 1, 1: 2, 2: 2}


def test_owners_with_the_same_fingerprint_are_collected_everywhere(spark, monkeypatch):
    """No fingerprints: the missing finds show that phrases were left out."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(250)]
    docs = [(", ".join(words * 12), "en")]
    docs += [(". ".join(f"{rng.choice(words)} {rng.choice(words)}" for _ in range(600)), "en") for _ in range(60)]
    docs += [(". ".join([f"{rng.choice(words)} {rng.choice(words)}"] * 12), "en") for _ in range(80)]
    rounds = []

    def blind(name, *args):
        def run(batches):
            from parallax.llm import phrases as here  # the worker's own
            seen, here._print = here._print, lambda h, bits: np.zeros(len(h), np.int64)
            yield from getattr(here, name)(*args)(batches)
            here._print = seen
        return run

    monkeypatch.setattr(phrases, "_candidates", lambda *args: rounds.append(args[-1]) or blind("_candidates", *args))
    monkeypatch.setattr(phrases, "_bucket_counts", lambda *args: blind("_bucket_counts", *args))
    options = {"max_words": 2, "min_count": 10, "covered": 101, "top": 2000}
    df = spark.createDataFrame(docs, "text string, lang string").repartition(3)
    assert sorted(tuple(r) for r in phrases.mine(df, bits=15, **options).collect()) == plain(docs, **options)
    assert rounds == [False, True]


def test_a_language_name_with_a_newline_is_no_other_language(spark):
    docs = [("b\nx y. " * 12, "a"), ("x y. " * 12, "a\nb"), ("c d. " * 12, "a\\nb")]
    options = {"max_words": 2, "min_count": 10, "covered": 50, "top": 2000}
    assert mined(spark, docs, **options) == plain(docs, **options)
