"""Streaming text (S9): the lazy-iteration reader as Structured Streaming.

The reference streams a dataset only to avoid materialising it; there is
no event time, watermark or state.  The Spark form is a file stream of text
lines through stateless transforms into a Parquet sink, run with
``trigger(availableNow=True)`` so it processes what is there and stops.
The checkpoint (and the default sink) live in the shared checkpoint folder,
so a restarted query resumes exactly where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import py_strip, strip_bom
from ..session import scratch_path


def read_lines_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Unbounded table of lines (stripped) with their source file."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    df = r.load(path)
    return df.select(F.col("_metadata.file_path").alias("file"),
                     py_strip(strip_bom(F.col("value"))).alias("text"))


def run_available(spark: SparkSession, stream: DataFrame, transform: Callable[[DataFrame], DataFrame],
                  sink: str | None = None, checkpoint: str | None = None, timeout_s: int | None = None) -> DataFrame:
    """Apply a stateless ``transform`` to everything available, append it to
    a Parquet sink, stop, and return the sink as a batch DataFrame.  It runs
    until all is done; ``timeout_s`` sets a limit for callers that want one."""
    sink = sink or scratch_path(spark, "stream-sink")
    checkpoint = checkpoint or scratch_path(spark, "stream-ckpt")
    q = (transform(stream).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    try:
        if timeout_s is None:
            q.awaitTermination()
        elif not q.awaitTermination(timeout_s):
            raise TimeoutError(f"streaming query did not finish within {timeout_s}s")
        if q.exception() is not None:
            raise q.exception()
    finally:
        if q.isActive:
            q.stop()
    return spark.read.parquet(sink)
