"""Indel ratio UDF and the similarity band filter."""

import random

from pyspark.sql import functions as F

from parallax.functions.similarity import indel_ratio, indel_ratio_py, lcs
from parallax.operators.filters import filter_similarity


def test_udf_equals_python(spark):
    rnd = random.Random(5)
    pairs = [("", ""), ("", "a"), ("Hola", "hola"), ("façade", "facade"), ("😀a", "a😀"), ("kitten", "sitting")]
    for _ in range(300):
        n, m = rnd.randint(0, 150), rnd.randint(0, 150)
        pairs.append(("".join(rnd.choice("abcé😀") for _ in range(n)), "".join(rnd.choice("abcé😀") for _ in range(m))))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id long, a string, b string")
    got = df.select("id", indel_ratio("a", "b").alias("r"), lcs("a", "b").alias("l")).collect()
    for row in got:
        a, b = pairs[row.id]
        assert abs(row.r - indel_ratio_py(a, b)) < 1e-12


def test_slices_and_word_boundaries(monkeypatch):
    import pandas as pd

    from parallax.functions import similarity as S
    rnd = random.Random(8)
    make = lambda n: "".join(rnd.choice("abcdé😀") for _ in range(n))
    pairs = [(make(n), make(m)) for n in (0, 1, 63, 64, 65, 127, 128, 129, 300) for m in (0, 1, 64, 65, 200, 700)]
    want = [S.lcs_length(a, b) for a, b in pairs]
    a, b = pd.Series([x for x, _ in pairs]), pd.Series([y for _, y in pairs])
    assert S.lcs_lengths(a, b).tolist() == want
    monkeypatch.setattr(S, "TABLE_WORDS", 50)
    monkeypatch.setattr(S, "SLICE_CHARS", 300)
    assert S.lcs_lengths(a, b).tolist() == want


def test_long_pairs_do_not_widen_the_tables_of_others(monkeypatch):
    """A few long lines among short ones: the table cells stay near what the short pairs need."""
    import pandas as pd

    from parallax.functions import similarity as S
    rnd = random.Random(9)
    make = lambda n: "".join(rnd.choice("abcdé😀") for _ in range(n))
    pairs = [(make(rnd.randint(1, 60)), make(rnd.randint(1, 90))) for _ in range(60)] + [(make(2000), make(1500)), (make(400), make(3000))]
    cells, run = [], S._lcs_slice
    monkeypatch.setattr(S, "_lcs_slice", lambda a, b, n, m: cells.append(len(a) * -(-int(n.max()) // 64) * int(m.max())) or run(a, b, n, m))
    got = S.lcs_lengths(pd.Series([x for x, _ in pairs]), pd.Series([y for _, y in pairs]))
    assert got.tolist() == [S.lcs_length(x, y) for x, y in pairs]
    assert 0 < sum(cells) <= 60 * 90


def test_band_on_whole_lines(spark):
    from parallax.plans import fixtures as fx
    from parallax.plans.registry import QUERIES, load_all
    from tests.conftest import SF_SMALL
    load_all()
    got = {(r.doc_id, r.line_no): r.ratio for r in QUERIES["similarity_band_docs"](spark, SF_SMALL).collect()}
    want = {}
    for r in fx.pairs_docs(spark, SF_SMALL).collect():
        ratio = indel_ratio_py(r.source.lower(), r.target.lower())
        if 0.25 <= ratio <= 0.99:
            want[(r.doc_id, r.line_no)] = round(ratio, 6)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_filtered_preparation(spark):
    """X3 against its steps: variants, text and the band."""
    from parallax.plans.registry import QUERIES, load_all
    from tests.conftest import SF_SMALL
    load_all()
    rows = QUERIES["prepare_filtered"](spark, SF_SMALL).collect()
    by = {}
    for r in rows:
        by.setdefault(r.dataset, {})[(r.corpus, r.doc_id, r.line_no)] = (r.source, r.target)
    assert set(by) == {"original", "filtered", "levenshtein"}
    assert set(by["filtered"]) <= set(by["original"])
    band = {k: v for k, v in by["filtered"].items() if 0.25 <= indel_ratio_py(v[0].lower(), v[1].lower()) <= 0.99}
    assert by["levenshtein"] == band
    assert all(1 <= len(x.split(" ")) <= 80 for v in by["filtered"].values() for x in v)


def test_band_is_exact_with_prefilters(spark):
    rnd = random.Random(9)
    pairs = [("", ""), ("Casa", "casa"), ("a", ""), ("abc", "abd"), ("x" * 3, "y" * 30)]
    for _ in range(400):
        pairs.append(("".join(rnd.choice("abAB") for _ in range(rnd.randint(0, 20))),
                      "".join(rnd.choice("abAB") for _ in range(rnd.randint(0, 20)))))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id long, source string, target string")
    kept = {r.id for r in filter_similarity(df, 0.25, 0.99).collect()}
    brute = {i for i, (a, b) in enumerate(pairs) if 0.25 <= indel_ratio_py(a.lower(), b.lower()) <= 0.99}
    assert kept == brute
    assert 0 not in kept and 1 not in kept and 2 not in kept


def test_prefilter_runs_below_the_udf(spark):
    df = spark.createDataFrame([("a", "b")], "source string, target string")
    plan = filter_similarity(df)._jdf.queryExecution().executedPlan().toString()
    udf_at = plan.find("ArrowEvalPython")
    # the length/equality predicate is evaluated before (below) the Python node
    assert udf_at >= 0
    assert "char_length" in plan[udf_at:] or "length" in plan[udf_at:]
