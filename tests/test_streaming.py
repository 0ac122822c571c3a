"""Streaming = batch for the lazy reader."""

import os

from pyspark.sql import functions as F

from parallax.functions.text import squeeze_spaces
from parallax.sources.text import read_lines
from parallax.streaming.lines import read_lines_stream, run_available


def test_stream_equals_batch(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/in")
    for k in range(4):
        with open(f"{tmp_dir}/in/f{k}.txt", "w") as f:
            f.write("\n".join(f"  linea  {k} {i}  " for i in range(50)) + "\n")

    def clean(df):
        return df.select(squeeze_spaces("text").alias("text")).where(F.col("text") != "")

    streamed = run_available(spark, read_lines_stream(spark, f"{tmp_dir}/in", 1), clean,
                             sink=f"{tmp_dir}/sink", checkpoint=f"{tmp_dir}/ckpt")
    batch = clean(read_lines(spark, f"{tmp_dir}/in"))
    assert sorted(r.text for r in streamed.collect()) == sorted(r.text for r in batch.collect())
    # a restart finds nothing new (the checkpoint remembers the files)
    again = run_available(spark, read_lines_stream(spark, f"{tmp_dir}/in", 1), clean,
                          sink=f"{tmp_dir}/sink", checkpoint=f"{tmp_dir}/ckpt", timeout_s=300)
    assert again.count() == streamed.count()
