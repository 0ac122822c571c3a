"""Tables that are written again without doubling or redoing work: appends by
run (K3, S9) and a cache of encoded rows (K5)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def file_version(spark: SparkSession, *paths: str) -> str:
    """A fingerprint of files by path, length and time of change; no file is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select("path", "length", "modificationTime")
    one = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    row = listed.agg(F.count(F.lit(1)).alias("n"), F.sum(one).alias("h")).first()
    return f"{row['n']}-{row['h']}"


# ---------------------------------------------------------------------------
# K3: appends by run
# ---------------------------------------------------------------------------
def run_folder(path: str, run: str) -> str:
    return f"{path.rstrip('/')}/run={quote(run, safe='')}"


def append_run(df: DataFrame, path: str, run: str, batch: int = 0, corpus_col: str = "corpus") -> None:
    """Add ``df`` to the table at ``path`` as ``batch`` of ``run``, by corpus.

    The same run and batch written again replace what they wrote before, so a
    repeated or restarted job gives no double row; other runs stay."""
    df.write.partitionBy(corpus_col).mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{run_folder(path, run)}/batch={int(batch)}")


def read_runs(spark: SparkSession, path: str, columns: DataFrame | None = None) -> DataFrame:
    """The whole table with its ``run`` and ``batch``; ``columns`` gives the types, those of partition columns included."""
    reader = spark.read
    if columns is not None:
        kinds = ", ".join(f"`{n}` {t}" for n, t in columns.dtypes)
        reader = reader.schema(f"{kinds}, run string, batch long")
    return reader.parquet(path)


def append_stream(spark: SparkSession, stream: DataFrame, path: str, run: str, checkpoint: str, corpus_col: str = "corpus",
                  transform: Callable[[DataFrame], DataFrame] | None = None, write: Callable = append_run) -> None:
    """Append everything a stream has, micro-batch by micro-batch, exactly once.

    A batch that was written but not yet recorded when the job died is
    written again under its number and replaces itself.  A run whose
    checkpoint is new begins anew: what an earlier one of that name has
    written goes first."""
    if not exists(spark, f"{checkpoint}/offsets"):
        delete(spark, run_folder(path, run))
    out = transform(stream) if transform else stream
    query = (out.writeStream.foreachBatch(lambda df, no: write(df, path, run, no, corpus_col))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    try:
        query.awaitTermination()
    finally:
        if query.isActive:
            query.stop()


# ---------------------------------------------------------------------------
# K5: a cache of encoded rows
# ---------------------------------------------------------------------------
def _same(a: str, b: str, keys) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def content_versions(rows: DataFrame, keys) -> DataFrame:
    """``(<keys>, version)``: a fingerprint of each partition's rows, whatever their order."""
    rest = sorted(c for c in rows.columns if c not in keys)
    halves = [F.sum(F.xxhash64(F.lit(i), *[F.struct(F.col(c).isNull(), F.col(c)) for c in rest]).cast("decimal(38,0)")).cast("string") for i in (1, 2)]
    return rows.groupBy(*keys).agg(F.concat_ws("-", F.count(F.lit(1)).cast("string"), *halves).alias("version"))


def cache_encoded(rows: DataFrame, path: str, encode: Callable[[DataFrame], DataFrame], settings: dict,
                  keys=("src_tag", "tgt_tag", "split"), versions: DataFrame | None = None) -> DataFrame:
    """``encode(rows)`` kept at ``path`` by partition, and only encoded where it is not there yet.

    A partition is known by its ``keys`` (with the split, so that train and
    validation never meet), the version of its rows and ``settings`` (encoder,
    lengths: anything JSON holds).  ``versions(<keys>, version)`` says which
    partitions are wanted in which version: then nothing of ``rows`` is read
    where all are kept.  Without it the rows' own content is their version,
    which costs a scan of the columns but no encoding.  ``encode`` keeps the
    key columns.  A partition counts as kept once its line in the commit table
    is there, which is written last: a job that dies leaves nothing that is
    read.  Older versions stay on disk and are not read."""
    spark, keys = rows.sparkSession, list(keys)
    wanted = versions if versions is not None else content_versions(rows, keys)
    print_ = F.sha2(F.concat_ws("|", F.lit(json.dumps(settings, sort_keys=True)), "version"), 256)
    wanted = materialize(wanted.select(*keys, print_.alias("fingerprint")), "cache-wanted")
    kinds = ", ".join(f"`{n}` {t}" for n, t in wanted.dtypes)
    commits, data = f"{path.rstrip('/')}/commits", f"{path.rstrip('/')}/data"
    kept = spark.read.schema(f"{kinds}, folder string").parquet(commits) if exists(spark, commits) else spark.createDataFrame([], f"{kinds}, folder string")
    kept = kept.groupBy(*keys, "fingerprint").agg(F.max("folder").alias("folder"))  # two jobs at once may both have written it
    at = [*keys, "fingerprint"]
    missing = materialize(wanted.alias("w").join(kept.alias("k"), _same("w", "k", at), "left_anti"), "cache-missing")
    if not missing.isEmpty():
        new = rows.alias("r").join(broadcast_if_small(missing).alias("m"), _same("r", "m", keys), "left_semi")
        folder = f"part-{uuid.uuid4().hex}"
        encode(new).write.mode("overwrite").parquet(f"{data}/{folder}")
        missing.withColumn("folder", F.lit(folder)).write.mode("append").parquet(commits)
        kept = spark.read.schema(f"{kinds}, folder string").parquet(commits).groupBy(*at).agg(F.max("folder").alias("folder"))
    use = materialize(wanted.alias("w").join(kept.alias("k"), _same("w", "k", at)).select("w.*", "folder"), "cache-use")
    folders = [r[0] for r in use.select("folder").distinct().collect()]  # a row for each call that encoded something
    out, form = None, encode(rows)  # analysed, not run
    for f in folders:
        held = spark.read.schema(form.schema).parquet(f"{data}/{f}")
        mine = broadcast_if_small(use.where(F.col("folder") == f)).alias("u")
        part = held.alias("h").join(mine, _same("h", "u", keys), "left_semi")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else form.limit(0)
