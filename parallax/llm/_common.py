"""Small helpers shared by the operators: intermediate tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path


def save(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the folder that ``spark.checkpoint.dir`` names and read it back.

    Cuts the lineage: a lost executor costs a re-read of these files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that no later plan reads."""
    jvm = spark._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` begins with, for columns that an operator adds and drops."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def bound_batches(spark: SparkSession, rows: int = 500, size: int = 4 << 20) -> None:
    """Send texts to Python in batches of at most ``rows`` rows and ``size`` bytes (or one row).

    Sets the session's Arrow batch limits, unless they are lower already:
    with long texts the default of 10,000 rows does not bound memory."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key, None)
        digits = (now or "").lower().removesuffix("b")
        if not digits.isdigit() or not 0 < int(digits) <= most:
            spark.conf.set(key, str(most))


@contextmanager
def batch_limits(spark: SparkSession, rows: int = 500, size: int = 4 << 20) -> Iterator[None]:
    """:func:`bound_batches` for the jobs that run inside the block; the session's own limits come back after it."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(k, None) for k in keys]
    bound_batches(spark, rows, size)
    try:
        yield
    finally:
        for k, v in zip(keys, before):
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
