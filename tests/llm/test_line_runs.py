"""Line dedup against brute force: edge cases, levels, skew by one common line."""

import random

import pytest

from parallax.llm import line_runs as R
from parallax.llm.line_runs import LineRuns, dedup_lines

WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(rows, min_chars, min_docs):
    holders = {}
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or len(key(x)) < min_chars or len(holders[key(x)]) < min_docs
                or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def run(spark, rows, parts=4, **k):
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string").repartition(parts)
    out = dedup_lines(df, **k)
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()), key=str)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (6, 3)])
def test_random_documents(spark, batches, fanout):
    rng = random.Random(batches)
    pool = ["Common line", " common LINE\t", "Étude line", "étude line", "rare", "", "x", "É" * 6, "another shared"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in rng.sample(range(1000), 60)]
    rows += [(2000 + i, "Common line\nown %d" % i) for i in range(40)]  # one line in most documents
    got = run(spark, [(i, t, "x") for i, t in rows], min_chars=5, min_docs=3, batches=batches, fanout=fanout)
    assert got == brute(rows, 5, 3)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "\n"), (None, "shared line\nb"), (None, "shared line"), (4, "shared line\nshared line\nq"),
            (5, "shared line\r"), (6, " shared line"), (7, "SHARED LINE"), (7, "SHARED LINE"), (8, "\n".join(["shared line"] * 3000))]
    got = run(spark, [(i, t, None) for i, t in rows], min_chars=5, min_docs=3)
    assert got == brute(rows, 5, 3)


def test_empty(spark):
    assert run(spark, []) == []


def test_levels_compact(spark):
    runs = LineRuns(spark, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(k, 0, 100 - b) for k in range(b, b + 3)], "h1 long, h2 long, doc long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    got = {r["h1"]: r["keeper"] for r in runs.keepers().collect()}
    assert got == {0: 100, 1: 100, 2: 100, 3: 99, 4: 98, 5: 97, 6: 96}


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = dedup_lines(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and R.HASH == ["h1", "h2"]


def test_columns_with_names_of_its_own(spark):
    from parallax.llm import line_runs
    line = "a line that is long enough"
    rows = [(i, f"{line}\nx{i}", i, "v", "c", "a") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _hash long, _version string, __cut string, _all string")
    out = line_runs.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    assert sorted((r["doc_id"], r["n_dropped"], r["_hash"], r["__cut"]) for r in out.collect()) == [(0, 1, 0, "c"), (1, 1, 1, "c"), (2, 1, 2, "c"), (3, 0, 3, "c")]
