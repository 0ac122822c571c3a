"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # joins against small derived tables (chunk offsets, per-group totals)
    # become broadcast joins only after AQE has measured the real size
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "parallax", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared
    file system); without it a cluster job cannot share intermediate tables,
    so that is an error.  Only a local session makes its own folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="parallax-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


_scratch_roots: set[str] = set()


def _delete(path: str) -> None:
    from pyspark import SparkContext
    gateway = SparkContext._gateway
    if gateway is not None:
        p = gateway.jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(gateway.jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)


def remove_scratch() -> None:
    """Delete the folders that :func:`scratch_path` handed out (also run when the driver exits)."""
    while _scratch_roots:
        try:
            _delete(_scratch_roots.pop())
        except Exception:  # the driver is going down: a folder that stays is only untidy
            pass


atexit.register(remove_scratch)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder, in this
    application's own sub-folder, which goes when the driver exits."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/parallax-{spark.sparkContext.applicationId}"
    _scratch_roots.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str = "table"):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: the lineage is cut and an expensive upstream (model inference) is
    computed exactly once even when several branches read the result.  A
    lost executor then costs a re-read, not a recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(scan, factor: int = 2):
    """Make sure CPU-bound per-row work can use every core.

    For a *file scan* only (asking a derived frame for its partitions would
    run its exchanges): when it arrives in fewer partitions than ``factor``
    x the cluster's default parallelism (a small table stored as one Parquet
    row group), it is round-robin repartitioned; otherwise it is returned
    unchanged, so on a large input this costs nothing.  Round-robin
    repartitioning sorts first, so a retried task reproduces the same
    split."""
    target = scan.sparkSession.sparkContext.defaultParallelism * factor
    return scan.repartition(target) if scan.rdd.getNumPartitions() < target else scan


def pin(df, **exprs):
    """Evaluate expensive column expressions exactly once.

    A filter over computed columns is pushed below the projection with the
    expressions substituted, so a predicate that mentions a column four
    times would evaluate its (regex-heavy) definition four more times.
    Producing the columns through a generator (``inline`` of a one-element
    array) is a barrier the predicate cannot cross: downstream filters then
    read the computed values."""
    from pyspark.sql import functions as F
    keep = [c for c in df.columns if c not in exprs]
    packed = F.array(F.struct(*[e.alias(n) for n, e in exprs.items()]))
    return df.select(*keep, F.inline(packed))


#: largest table, in bytes of its Parquet files, that is broadcast
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df, max_bytes: int = BROADCAST_BYTES):
    """Broadcast a *materialised* table whose files hold at most
    ``max_bytes`` (the scan's own size statistic, no job); a larger one is
    returned unchanged, so that the join stays a shuffle join with AQE skew
    handling.  Use only on tables read back from storage."""
    from pyspark.sql import functions as F
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= max_bytes else df
