"""Splits, shuffles, batches, packing: goldens and invariance."""

from pyspark.sql import functions as F

from parallax.functions import tokens as tk
from parallax.operators import corpus as C
from parallax.operators import scan
from parallax.operators.scan import line_positions


def _lines(spark, docs):
    rows = [("c" + str(d % 2), d, i + 1, f"d{d} l{i}") for d, n in enumerate(docs) for i in range(n)]
    return spark.createDataFrame(rows, "corpus string, doc_id long, line_no long, text string")


def test_positions_and_split(spark, monkeypatch):
    ln = _lines(spark, [3, 4, 5, 2, 1, 6])
    pos = {(r.doc_id, r.line_no): r.pos for r in C.with_positions(ln).collect()}
    # corpus c0 = docs 0, 2, 4 (3 + 5 + 1 lines)
    assert pos[(0, 1)] == 1 and pos[(2, 1)] == 4 and pos[(4, 1)] == 9
    monkeypatch.setattr(scan, "ROWS_PER_CHUNK", 1)
    small_chunks = line_positions(ln.repartition(5), ["corpus"])
    assert {(r.doc_id, r.line_no): r.pos for r in small_chunks.collect()} == pos
    docs = ln.groupBy("corpus", "doc_id").agg(F.sort_array(F.collect_list("text")).alias("parts"))
    direct = scan.positioned_lines(docs, ["corpus"], "parts", total="n").collect()
    assert {(r.doc_id, r.line_no): r.pos for r in direct} == pos
    assert {(r.corpus, r.n) for r in direct} == {("c0", 9), ("c1", 12)}
    sp = C.split_head_percent(C.with_positions(ln), 25.0).where("split = 'validation'")
    # c0 has 9 lines -> round_half_even(2.25) = 2; c1 has 12 -> 3
    assert sorted(r.corpus for r in sp.collect()) == ["c0", "c0", "c1", "c1", "c1"]


def test_positions_with_nulls_and_repeated_ids(spark, monkeypatch):
    rows = [("a", 1, ["p", "q"]), ("a", 2, ["r", "s", "t"]), ("a", 2, ["u"]), ("a", 2, ["r", "s", "t"]), ("a", 3, ["v"]),
            ("a", None, ["w", "x"]), ("a", None, ["y"]), (None, 2, ["z", "z"]), (None, 1, ["o"]), (None, None, ["n"]), ("b", 1, None)]
    docs = spark.createDataFrame(rows, "corpus string, doc_id long, parts array<string>")
    lines = [(c, d, i + 1, x) for c, d, parts in rows for i, x in enumerate(parts or [])]
    for size in (4096, 1):
        monkeypatch.setattr(scan, "ROWS_PER_CHUNK", size)
        got = scan.positioned_lines(docs.repartition(3), ["corpus"], "parts", total="n").collect()
        assert sorted(map(str, lines)) == sorted(str((r.corpus, r.doc_id, r.line_no, r.text)) for r in got)
        for c in ("a", None):
            mine = sorted((r for r in got if r.corpus == c), key=lambda r: r.pos)
            assert [r.pos for r in mine] == list(range(1, len(mine) + 1)) and {r.n for r in mine} == {len(mine)}
            keys = [(r.doc_id is None, r.doc_id or 0, r.line_no) for r in mine]
            assert keys == sorted(keys)
    table = spark.createDataFrame([(None, 1), (None, 2), ("x", 1)], "g string, k long")
    chunks = scan.chunk_by_count(table, ["g"], "k")
    assert {(r.g, r.k): r.pos for r in scan.positions(chunks, ["g"], F.col("__by_count"), ["k"]).collect()} == {
        (None, 1): 1, (None, 2): 2, ("x", 1): 1}


def test_half_even_cut(spark):
    ln = _lines(spark, [10])  # 10 lines, 25 % -> 2.5 -> 2
    assert C.split_head_percent(C.with_positions(ln), 25.0).where("split = 'validation'").count() == 2


def test_shuffle_is_a_partition_independent_permutation(spark):
    ln = _lines(spark, [50] * 8)
    a = {(r.doc_id, r.line_no): r.rank for r in C.shuffle_rank(ln, 7, ["doc_id", "line_no"]).collect()}
    b = {(r.doc_id, r.line_no): r.rank for r in C.shuffle_rank(ln.repartition(11), 7, ["doc_id", "line_no"],
                                                                 bucket_hex=1).collect()}
    assert a == b
    for c in ("c0", "c1"):
        ranks = sorted(v for (d, _), v in a.items() if f"c{d % 2}" == c)
        assert ranks == list(range(1, 201))
    other = {(r.doc_id, r.line_no): r.rank for r in C.shuffle_rank(ln, 8, ["doc_id", "line_no"]).collect()}
    assert other != a
    for digits in (1, 4):  # the cut may fall inside a bucket or between two
        some = C.random_subset(ln, 10, 7, ["doc_id", "line_no"], bucket_hex=digits).collect()
        assert {(r.doc_id, r.line_no) for r in some} == {k for k, v in a.items() if v <= 10}
    assert C.random_subset(ln, 500, 7, ["doc_id", "line_no"]).count() == 400
    assert C.sample_rows(ln, 3, 7, ["doc_id", "line_no"]).count() == 3


def test_batches_schedule(spark):
    ln = C.with_positions(_lines(spark, [20]))
    b = C.assign_batches(ln, 6)
    assert sorted(r.batch_id for r in b.groupBy("batch_id").count().collect()) == [0, 1, 2, 3]
    assert C.skip_batches(b, 3).count() == 2
    s = C.training_schedule(ln, 6, accumulation=3, epochs=2).first()
    assert (s.batches, s.updates_per_epoch, s.total_updates) == (4, 2, 4)


def test_pack_blocks_keeps_order(spark):
    rows = [("c", i, list(range(i * 10, i * 10 + (i % 7) + 1))) for i in range(1, 2501)]
    df = spark.createDataFrame(rows, "corpus string, pos long, ids array<int>")
    packed = C.pack_blocks(df.repartition(9), 16, group_rows=1000).collect()
    by_group = {}
    for r in packed:
        by_group.setdefault(r.group_id, []).append((r.block_idx, r.input_ids))
    for g, blocks in by_group.items():
        flat = [t for _, ids in sorted(blocks) for t in ids]
        src = [t for (_, p, ids) in rows if (p - 1) // 1000 == g for t in ids]
        assert flat == src[:len(flat)]
        assert len(src) - len(flat) < 16
        assert all(len(ids) == 16 for _, ids in blocks)
    assert all(r.labels == r.input_ids for r in packed)


def test_expand_prefixes_and_token_arrays(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "x  y")], "line_no long, text string")
    ex = {(r.i, r.line_no): r.prompt for r in C.expand_prefixes(df, 2).collect()}
    assert ex[(3, 1)] == "a b c" and ex[(4, 1)] == "a b c d" and ex[(3, 2)] == "x  y"
    t = spark.createDataFrame([([5, 0, 7],)], "ids array<int>")
    r = t.select(tk.mask_padding("ids", 0).alias("m"), tk.pad_to("ids", 5, 0, multiple_of=4).alias("p"),
                 tk.shift_for_next_token("ids", "ids").alias("s")).first()
    assert r.m == [5, -100, 7] and r.p == [5, 0, 7, 0, 0, 0, 0, 0]
    assert [(x.p, x.l) for x in r.s] == [(5, 0), (0, 7)]
    assert t.select(tk.unmask_labels(tk.mask_padding("ids", 0), 0)).first()[0] == [5, 0, 7]


def test_mixture_upsamples(spark):
    import json
    pairs = spark.createDataFrame([("a", 1, "s", "t"), ("b", 1, "s2", "t2")],
                                  "corpus string, line_no long, source string, target string")
    m = C.manifest_rows(spark, json.dumps({"x": [{"source": "a", "target": "a"}, {"source": "a", "target": "a"}],
                                           "y": [{"source": "b", "target": "b"}]}))
    mix = C.build_mixture(pairs, m)
    assert mix.where("tag = 'x'").count() == 2 and mix.where("tag = 'y'").count() == 1
    u = C.concat_corpora({"p": pairs, "q": pairs})
    assert u.count() == 4
