"""Appends that a rerun does not double, and a cache that does nothing twice."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from parallax.plans import workflows as W
from parallax.sources import tables as T

KEYS = ["src_tag", "tgt_tag", "split"]


def test_runs_replace_themselves(spark, tmp_dir):
    rows = lambda *r: spark.createDataFrame(list(r), "corpus string, line_no long, text string")
    out = f"{tmp_dir}/t"
    T.append_run(rows(("QED", 1, "a"), ("GNOME", 1, "b")), out, "web/1")
    T.append_run(rows(("QED", 1, "c")), out, "books")
    T.append_run(rows(("QED", 1, "a2")), out, "web/1")  # the rerun has no GNOME any more
    got = sorted((r["run"], r["corpus"], r["text"]) for r in T.read_runs(spark, out, rows(("", 0, ""))).collect())
    assert [g[1:] for g in got] == [("QED", "c"), ("QED", "a2")]


def test_prepare_twice_gives_no_double_row(spark, tmp_dir):
    pairs = spark.createDataFrame([("007", 1, "a b c", "x y z"), ("A", 2, "d e f", "u v w"), ("A", 3, "d", "u")], "corpus string, line_no long, source string, target string")
    for _ in range(3):
        got = W.prepare(pairs, f"{tmp_dir}/t", run="r")
    assert sorted((r["corpus"], r["line_no"]) for r in got.collect()) == [("007", 1), ("A", 2)]


def write_files(folder, names, n=20):
    os.makedirs(folder, exist_ok=True)
    for name in names:
        with open(f"{folder}/{name}.txt", "w") as f:
            f.write("".join(f"{name} {i}\n" for i in range(n)))


def test_a_killed_stream_goes_on_without_double_rows(spark, tmp_dir):
    write_files(f"{tmp_dir}/in", "abcd")
    seen = []

    def dies(df, path, run, batch, corpus_col):
        T.append_run(df, path, run, batch, corpus_col)
        seen.append(batch)
        if seen == [0, 1]:
            raise RuntimeError("killed after the batch was written, before it was recorded")

    def stream():
        lines = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(f"{tmp_dir}/in")
        return lines.select(F.lit("c").alias("corpus"), F.col("value").alias("text"))

    start = lambda run="r", ckpt="ck", write=T.append_run: T.append_stream(spark, stream(), f"{tmp_dir}/t", run, f"{tmp_dir}/{ckpt}", write=write)
    with pytest.raises(Exception, match="killed"):
        start(write=dies)
    start(write=dies)
    text = lambda: sorted(r["text"] for r in T.read_runs(spark, f"{tmp_dir}/t").collect())
    want = sorted(f"{n} {i}" for n in "abcd" for i in range(20))
    assert text() == want and seen.count(1) == 2
    start()  # nothing new
    assert text() == want
    start(ckpt="other")  # the same run with a new checkpoint begins anew
    assert text() == want
    start(run="again", ckpt="third")
    assert text() == sorted(want * 2)


@pytest.fixture()
def counted(spark):
    met = spark.sparkContext.accumulator(0)

    def encode(df):
        @F.udf("array<int>")
        def ids(text):
            met.add(1)
            return [len(w) for w in (text or "").split()]

        return df.select(*KEYS, "line_no", ids("text").alias("ids"))

    return met, encode


def raw(spark, rows):
    return spark.createDataFrame(rows, "src_tag string, tgt_tag string, split string, line_no long, text string")


def test_only_what_changed_is_encoded_again(spark, tmp_dir, counted):
    met, encode = counted
    rows = [("es", "an", "train", 1, "uno dos"), ("es", "an", "validation", 1, "uno dos"), ("es", "oc", "train", 1, "a"), ("es", "", "train", 1, "b"),
            ("es", None, "train", 1, None)]
    call = lambda rows, **s: sorted(map(str, T.cache_encoded(raw(spark, rows).repartition(3), f"{tmp_dir}/c", encode, {"max": 5, **s}).collect()))
    first = call(rows)
    assert met.value == 5 and len(first) == 5
    assert call(rows[::-1]) == first and met.value == 5  # nothing is encoded, whatever the order
    changed = rows[:2] + [("es", "oc", "train", 1, "a new line")] + rows[3:]
    got = call(changed)
    assert met.value == 6 and len(got) == 5 and got != first
    assert call(rows) == first and met.value == 6  # the older version is still known
    call(rows, max=9)
    assert met.value == 11  # other settings
    assert len(call(rows[:2], )) == 2 and met.value == 11
    assert call([]) == []


def test_known_versions_read_nothing(spark, tmp_dir, counted):
    met, encode = counted
    write_files(f"{tmp_dir}/in", "a", 4)
    rows = spark.read.text(f"{tmp_dir}/in").select(F.lit("es").alias("src_tag"), F.lit("an").alias("tgt_tag"), F.lit("train").alias("split"),
                                                  F.lit(1).cast("long").alias("line_no"), F.col("value").alias("text"))
    version = T.file_version(spark, f"{tmp_dir}/in")
    versions = spark.createDataFrame([("es", "an", "train", version)], "src_tag string, tgt_tag string, split string, version string")
    once = T.cache_encoded(rows, f"{tmp_dir}/c", encode, {}, versions=versions).count()
    assert once == met.value == 4
    shutil.move(f"{tmp_dir}/in", f"{tmp_dir}/gone")
    assert T.cache_encoded(rows, f"{tmp_dir}/c", encode, {}, versions=versions).count() == 4 and met.value == 4
    write_files(f"{tmp_dir}/in", "ab", 4)
    assert T.file_version(spark, f"{tmp_dir}/in") != version


def test_a_job_that_dies_leaves_nothing_that_is_read(spark, tmp_dir, counted):
    met, encode = counted

    def dies(df):
        return encode(df).withColumn("ids", F.when(F.col("line_no") < 0, F.col("ids")).otherwise(F.raise_error(F.lit("killed")).cast("array<int>")))

    rows = raw(spark, [("es", "an", "train", 1, "x y")])
    with pytest.raises(Exception, match="killed"):
        T.cache_encoded(rows, f"{tmp_dir}/c", dies, {})
    assert [r["ids"] for r in T.cache_encoded(rows, f"{tmp_dir}/c", encode, {}).collect()] == [[1, 1]]
