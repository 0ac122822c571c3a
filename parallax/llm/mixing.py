"""Mixing sources to target weights: capped water-filling and seeded repetitions.

DataFrame functions only.  The whole decision is one row per source: how
often every document is taken, and the hash limits below which a document is
taken once more.  Applying it to the documents needs no shuffle of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import MapType

from ._common import free_prefix, remove, save

WORD = r"[^\x20\x09-\x0D]+"
#: hash digits that make a bucket of the prefix scan (16 ** 3 buckets a source)
BUCKET_DIGITS = 3
#: a source table up to this many bytes is broadcast, a larger one is joined by shuffle
BROADCAST_BYTES = 64 << 20
#: largest document that a round takes, as a part of the words still wanted
ROUNDS = (float("inf"), 1 / 8, 1 / 2, 1.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_col: Column, text: Column, seed: int, *others: Column) -> Column:
    """A row's place in its source's order: 16 hex digits of a seeded hash of all that it holds."""
    parts = [F.coalesce(id_col.cast("string"), F.lit("null")), F.coalesce(F.md5(text.cast("binary")), F.lit("null"))]
    if others:
        parts.append(F.xxhash64(*others).cast("string"))
    return F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), *parts)), 1, 16)


def water_fill(sources: DataFrame, weights: list[float], share: float, max_epochs: float) -> DataFrame:
    """``sources(source, source_size)`` -> the same with ``weight`` and ``target``.

    Weights repeat over the sources by code point, null last.  A source is
    clamped at ``max_epochs`` times its size, the excess goes to the others
    by weight until none is above.  In the order in which sources clamp
    (cap / weight), the first one that the level reached by all later ones
    does not clamp gives that level."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = (sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                          (place % len(weights) + 1).cast("int")))
                .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
                .withColumn("clamps_at", F.col("cap") / F.col("weight")))
    whole = Window.partitionBy()
    order = Window.orderBy("clamps_at", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    later = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - before) / later
    filled = weighted.withColumn("level", level)
    reached = F.min(F.when(F.col("level") <= F.col("clamps_at"), F.struct("clamps_at", F.col("source").isNull(), "source", "level"))).over(whole)
    target = F.coalesce(F.least("cap", reached["level"] * F.col("weight")), F.col("cap"))
    return filled.withColumn("target", target).select("source", "source_size", "weight", "target")


def _cut(rows: DataFrame, wants: DataFrame) -> DataFrame:
    """For each source the longest prefix by hash whose sizes sum to at most ``want``, and of the equal
    rows that follow it as many as still fit.

    ``rows(source, h, size)``, ``wants(source, want)`` -> ``(source, limit, lump, times, got)``:
    ``times`` rows of hash ``lump`` are taken beside those up to ``limit``.
    Bucket sums find the bucket where the sum passes ``want``; only rows of
    that bucket are ordered."""
    key = F.substring("h", 1, BUCKET_DIGITS)
    sums = rows.groupBy("source", key.alias("bucket")).agg(F.sum("size").alias("n"))
    over = Window.partitionBy("source").orderBy("bucket")
    filled = (sums.withColumn("upto", F.sum("n").over(over)).withColumnRenamed("source", "s")
              .join(wants, F.col("s").eqNullSafe(F.col("source"))).drop("s"))
    first = filled.groupBy("source", "want").agg(
        F.min(F.when(F.col("upto") > F.col("want"), F.struct("bucket", (F.col("upto") - F.col("n")).alias("before")))).alias("at"),
        F.max("upto").alias("all"))
    first = first.select("source", "want", F.col("at.bucket").alias("bucket"), F.col("at.before").alias("before"), "all")
    inside = (rows.withColumn("bucket", key).withColumnRenamed("source", "s")
              .join(first.where("bucket is not null").select("source", "bucket", "want", "before").withColumnRenamed("bucket", "b"),
                    (F.col("b") == F.col("bucket")) & F.col("s").eqNullSafe(F.col("source")))
              .groupBy("source", "want", "before", "h").agg(F.sum("size").alias("n"), F.max("size").alias("one")))
    inside = inside.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("source").orderBy("h")))
    free = F.col("want") - F.col("upto") + F.col("n")
    past = F.min(F.when(F.col("upto") > F.col("want"), F.struct("h", F.floor(free / F.col("one")).alias("times"), "one")))
    fits = (inside.groupBy("source").agg(F.max(F.when(F.col("upto") <= F.col("want"), F.struct("h", "upto"))).alias("full"), past.alias("past"))
            .select(F.col("source").alias("s"), "full.h", "full.upto", "past"))
    return (first.join(fits, F.col("s").eqNullSafe(F.col("source")), "left")
            .select("source", F.coalesce("h", "bucket", F.lit("g")).alias("limit"),
                    F.coalesce("past.h", F.lit("")).alias("lump"), F.coalesce("past.times", F.lit(0)).alias("times"),
                    (F.coalesce("upto", "before", "all") + F.coalesce(F.col("past.times") * F.col("past.one"), F.lit(0))).cast("double").alias("got")))


def mix_plan(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_epochs: float = 2.0,
             rounds: tuple[float, ...] = ROUNDS) -> DataFrame:
    """``sized(source, h, size)`` -> a row per source with its target and what is taken.

    Every document is taken ``whole`` times; a document is taken once more in
    the first round r whose ``limit`` its hash does not pass and whose
    ``largest`` its size does not pass.  Round 1 takes a prefix of the hash
    order, the next ones fill what is left by documents that are a small part
    of it, then by any that fits.  Of equal rows, which share a hash, the one
    round that reaches them may take ``times`` only; what is left then is less
    than one of them, so no later round meets them again."""
    spark = sized.sparkSession
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = (water_fill(sources, list(weights), share, max_epochs)
            .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
            .withColumn("want", F.col("target") - F.col("whole") * F.col("source_size")))
    plan, path = save(plan, "mix")
    past = F.lit(False)
    for r, part in enumerate(rounds):
        plan = plan.withColumn(f"largest{r}", F.col("want") * F.lit(part) if r else F.lit(float("inf")))
        left = sized.where("size > 0")
        if r:
            done = plan.drop("source_size", "target", "weight", "whole", "want").withColumnRenamed("source", "s")
            left = left.join(done, F.col("s").eqNullSafe(F.col("source"))).where(
                ~past & (F.col("size") <= F.col(f"largest{r}"))).select("source", "h", "size")
        cut = _cut(left, plan.select("source", "want")).select(
            F.col("source").alias("s"), *[F.col(c).alias(f"{c}{r}") for c in ("limit", "lump", "times")], "got")
        plan = (plan.join(cut, F.col("s").eqNullSafe(F.col("source")), "left").drop("s")
                .withColumns({f"limit{r}": F.coalesce(f"limit{r}", F.lit("")), f"lump{r}": F.coalesce(f"lump{r}", F.lit("")),
                              f"times{r}": F.coalesce(f"times{r}", F.lit(0))})
                .withColumn("want", F.col("want") - F.coalesce("got", F.lit(0.0))).drop("got"))
        old = path
        plan, path = save(plan, "mix")
        remove(spark, old)
        past = past | ((F.col("h") <= F.col(f"limit{r}")) & (F.col("size") <= F.col(f"largest{r}")))
    return plan


def repetitions(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=(5, 2, 1),
                share: float = 1.5, max_epochs: float = 2.0, seed: int = 3,
                rounds: tuple[float, ...] = ROUNDS) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``reps`` (replacing such columns).

    ``size`` is the number of words (null text: 0).  Targets share
    ``share`` times all words by weight, at most ``max_epochs`` times a
    source; a document is taken ``reps`` times, ``floor(target / source_size)``
    or once more.  A null source is a source of its own; rows that share an
    id are drawn by all they hold, and of wholly equal rows as many as fit
    are taken once more; sources without words have target 0; an empty table
    stays empty."""
    new = ("size", "source_size", "target", "reps")
    p = free_prefix(docs)
    others = [F.col(f.name) for f in docs.schema.fields if f.name not in (id_col, text, source) and not isinstance(f.dataType, MapType)]
    rows = docs.withColumn(f"{p}h", draw(F.col(id_col), F.col(text), seed, *others)).drop(*new).withColumn("size", word_count(F.col(text)))
    sized, path = save(rows.select(F.col(source).alias("source"), F.col(f"{p}h").alias("h"), "size"), "sized")
    plan = mix_plan(sized, weights, share, max_epochs, rounds)
    plan = plan.select(*[F.col(c).alias(f"{p}{c}") for c in plan.columns])
    size = plan.agg(F.sum(F.coalesce(F.octet_length(f"{p}source"), F.lit(0)) + 80 * len(rounds) + 60).alias("bytes"),
                    F.max(F.greatest(F.lit(0), *[F.col(f"{p}times{r}") for r in range(len(rounds))])).alias("times")).first()
    remove(docs.sparkSession, path)
    plan = F.broadcast(plan) if (size["bytes"] or 0) <= BROADCAST_BYTES else plan
    extra, times = F.lit(False), F.lit(0).cast("long")
    for r in range(len(rounds)):
        extra = extra | ((F.col(f"{p}h") <= F.col(f"{p}limit{r}")) & (F.col("size") <= F.col(f"{p}largest{r}")))
        times = F.when((F.col(f"{p}h") == F.col(f"{p}lump{r}")) & (F.col("size") <= F.col(f"{p}largest{r}")), F.col(f"{p}times{r}")).otherwise(times)
    found = (rows.join(plan, F.col(source).eqNullSafe(F.col(f"{p}source")))
             .withColumns({"source_size": F.col(f"{p}source_size"), "target": F.col(f"{p}target"), f"{p}times": F.when(~extra, times).otherwise(0)})
             .withColumn("reps", F.col(f"{p}whole") + extra.cast("long")))
    columns = [*[c for c in docs.columns if c not in new], *new]
    if not size["times"]:
        return found.select(*columns)
    plain = found.where(F.col(f"{p}times") == 0).select(*columns)
    # equal rows of which some are taken once more: counted, which folds them before the shuffle, and written out again
    maps = {f.name for f in rows.schema.fields if isinstance(f.dataType, MapType)}
    part = found.where(F.col(f"{p}times") > 0).select(*[F.array_sort(F.map_entries(c)).alias(c) if c in maps else F.col(c) for c in columns], f"{p}times")
    part = part.groupBy(*part.columns).agg(F.count(F.lit(1)).alias(f"{p}n"))
    part = part.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{p}n"))).alias(f"{p}i"))
    part = part.withColumn("reps", F.col("reps") + (F.col(f"{p}i") <= F.col(f"{p}times")).cast("long"))
    return plain.unionByName(part.select(*[F.map_from_entries(c).alias(c) if c in maps else F.col(c) for c in columns]))


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as mixed: each row ``reps`` times (see :func:`repetitions`).  Columns of the names that it adds are kept."""
    p = free_prefix(docs)
    taken = {c: f"{p}{c}" for c in ("size", "source_size", "target", "reps") if c in docs.columns}
    mixed = repetitions(docs.withColumnsRenamed(taken), **options)
    every = mixed.select(*[F.col(taken.get(c, c)).alias(c) for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), F.when(F.col("reps") > 0, F.col("reps")))).alias(f"{p}r"))
    return every.drop(f"{p}r")
