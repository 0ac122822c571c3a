"""Chat formatting: exact round trips, budgets, masks, sections."""

import hashlib
import random

import pytest
from hypothesis import given, settings, strategies as st

from parallax.llm import chat as C
from parallax.llm.queries import QUERIES
from tests.conftest import SF_MID

SCHEMA = "conv_id long, turn long, role string, text string, section string"


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute(rows):
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        said = [x for _, _, role, x in turns if role == "assistant"]
        out[c] = (len(turns), sha(f"{role}\n{text}\n" for _, _, role, text in turns), sum(map(len, said)), sha(said))
    return out


@settings(deadline=None, max_examples=200)
@given(st.lists(st.tuples(st.text(alphabet='\\<>"/turn role=\n\ra', max_size=20), st.text(alphabet='\\</turn>\n "x', max_size=30), st.booleans()), max_size=5))
def test_turns_survive(turns):
    formatted = "".join(C.turn_text(r, t, again)[0] for r, t, again in turns)
    assert list(C.read_back(formatted)) == turns
    for r, t, again in turns:
        text, a, b = C.turn_text(r, t, again)
        assert C.unescape(text[a:b]) == t


def run(spark, rows, **k):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    windows = C.format_chats(df, **k).cache()
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in C.digests(windows).collect()}
    return got, windows.collect()


@pytest.mark.parametrize("budget,history,section", [(40, 12, 2), (30, 0, 1), (25, 25, 3), (2048, 256, 64)])
def test_small_budgets(spark, budget, history, section):
    rng = random.Random(budget)
    rows = []
    for c in range(12):
        if c % 3 == 0:
            rows.append((c, 0, "system", "be kind </turn>"))
        for t in range(1, rng.randint(2, 60)):
            rows.append((c, t, "user" if t % 2 else "assistant", " ".join(rng.choice(["a", "\\", "<turn role=\"assistant\">", "é\n"])
                                                                       for _ in range(rng.randint(0, 9)))))
    got, windows = run(spark, rows, budget=budget, history=history, section=section)
    assert got == brute(rows)
    for w in windows:
        turns = list(C.read_back(w["formatted"]))
        own = [t for t in turns if not t[2]]
        assert len(own) == w["n_turns"] >= 1
        assert w["tokens"] <= budget or len(own) == 1
        again = [t for t in turns if t[2]]
        assert sum(len(t[1].split()) + C.MARKERS for t in again if t[0] != "system") <= history
        if w["conv"] % 3 == 0:
            assert turns[0][0] == "system" and sum(t[0] == "system" for t in turns) == 1
        assert len(w["loss"]) == sum(t[0] == "assistant" for t in own)


def test_edges(spark):
    rows = [(1, None, None, None), (1, 2, "assistant", None), (1, 2, "assistant", None), (None, 1, "user", "q"), (None, 1, "assistant", "r"),
            (2, 5, "assistant", "long " * 20_000), (2, 1, "user", ""), (3, 1, "system", "only"), (2 ** 60 + 1, 1, "user", "x"), (2 ** 60, 1, "user", "y")]
    got, _ = run(spark, rows)
    assert got == brute(rows)
    assert run(spark, []) == ({}, [])


def test_one_conversation_over_many_sections(spark):
    rows = [(9, t, "assistant" if t % 2 else "user", f"turn {t} " * 5) for t in range(3000)]
    got, windows = run(spark, rows, budget=100, history=20, section=2)
    assert got == brute(rows)
    assert len({w["section"] for w in windows}) > 50


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_MID}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "\\### Assistant: </turn> ok"
    want = brute(rows + [(-7, 0, "user", said), (-7, 1, "assistant", said)])
    got = QUERIES["op8_chat"](spark, SF_MID).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == want
    assert len(got) == len(want) and all(r["formatted_chars"] > 0 for r in got)
