"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

A run is a sorted table of 128-bit line hashes with the document that keeps
the line.  Batches arrive from the largest ids to the smallest; each one is
merge-anti-joined with the runs, and what is new is added as a run of its
own.  Whenever a level holds ``fanout`` runs they are compacted into one run
of the next level, so a batch meets a logarithmic number of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ._common import free_prefix, remove, save

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


class LineRuns:
    """Levelled runs of ``(h1, h2, keeper)``, each key in one run only."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[tuple[DataFrame, str]]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run, _ in level]

    def add(self, batch: DataFrame) -> None:
        """``batch(h1, h2, doc)``: keys that no run has are kept by the batch's largest doc."""
        # saved, for the optimizer would move the anti-joins below the aggregation, onto every line of a common key
        new, path = save(batch.groupBy(*HASH).agg(F.max("doc").alias("keeper")), "batch")
        for run in self.runs():
            new = new.join(run.select(*HASH).hint("merge"), HASH, "left_anti")
        self._put(0, new)
        remove(self.spark, path)

    def _put(self, level: int, rows: DataFrame) -> None:
        run = save(rows.repartition(*HASH).sortWithinPartitions(*HASH), f"run{level}")
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            both = old[0][0]
            for other, _ in old[1:]:
                both = both.unionByName(other)
            self._put(level + 1, both)
            remove(self.spark, *[path for _, path in old])

    def keepers(self) -> DataFrame | None:
        out = None
        for run in self.runs():
            out = run if out is None else out.unionByName(run)
        return out


def _sightings(docs: DataFrame, id_col: str, text: str, min_chars: int) -> DataFrame:
    """A row for each long line: hash, document, the text's own hash, position."""
    lines = docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(
        F.col(id_col).alias("doc"), F.xxhash64(text).alias("version"), F.posexplode(lines_of(F.col(text))).alias("pos", "line"))
    key = line_key(F.col("line"))
    return (lines.select("doc", "version", "pos", key.alias("key")).where(F.char_length("key") >= min_chars)
            .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"), "doc", "version", "pos"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3,
                  batches: int = 4, fanout: int = 2) -> DataFrame:
    """``(doc, version, cut)``: sorted positions of the lines that go, for documents that lose any.

    Batches are ranges of ids (approximate quantiles), largest first, so the
    document that first brings a key is the largest one that has it."""
    spark = docs.sparkSession
    seen, seen_path = save(_sightings(docs, id_col, text, min_chars), "lines")
    often = seen.groupBy(*HASH).agg(F.count_distinct("doc").alias("n")).where(F.col("n") >= min_docs).select(*HASH)
    # saved, for a join right above its own aggregation could not split the lines of one very common key
    often, often_path = save(often, "often")
    hot, hot_path = save(seen.join(often, HASH, "left_semi"), "frequent")
    at = [F.lit(i / batches) for i in range(1, batches)] or [F.lit(1.0)]
    cuts = sorted(set(hot.agg(F.percentile_approx("doc", F.array(*at), F.lit(1000))).first()[0] or []))
    runs = LineRuns(spark, fanout)
    keys = hot.select(*HASH, "doc")
    bounds = [None, *cuts, None]
    for low, high in reversed(list(zip(bounds[:-1], bounds[1:]))):
        batch = keys if low is None else keys.where(F.col("doc") > low)
        runs.add(batch if high is None else batch.where(F.col("doc") <= high))
    kept = runs.keepers().select(*HASH, F.col("keeper").alias("doc"))
    gone = hot.join(kept, [*HASH, "doc"], "left_anti")
    cut, _ = save(gone.groupBy("doc", "version").agg(F.sort_array(F.collect_set("pos")).alias("cut")), "cut")
    remove(spark, seen_path, often_path, hot_path, *[path for level in runs.levels for _, path in level])
    return cut


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3,
                batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` with the kept lines as ``text``, plus ``n_lines`` and ``n_dropped`` (replacing such columns).

    A line's key is the line stripped of white space, A-Z lower-cased.  Keys
    of at least ``min_chars`` code points found in at least ``min_docs``
    documents lose their lines everywhere but in the largest id that holds
    them.  A null or empty text is one empty line and becomes an empty text.
    Rows with a null id lose nothing and count for nothing; rows that repeat
    an id count as one document and are cut alike.  An empty table stays
    empty."""
    cut = dropped_lines(docs, id_col, text, min_chars, min_docs, batches, fanout)
    rows = docs.drop("n_lines", "n_dropped")
    p = free_prefix(rows)
    cut = cut.select(*[F.col(c).alias(f"{p}{c}") for c in ("doc", "version", "cut")])
    rows = rows.withColumn(f"{p}hash", F.xxhash64(text))
    rows = rows.join(cut, (rows[id_col] == cut[f"{p}doc"]) & (rows[f"{p}hash"] == cut[f"{p}version"]), "left")
    lines, n = lines_of(F.col(text)), F.coalesce(F.size(f"{p}cut"), F.lit(0))
    # the stretches between cut positions, sliced and joined: linear in lines
    starts = F.concat(F.array(F.lit(0)), F.transform(f"{p}cut", lambda at: at + 1))
    ends = F.concat(F.col(f"{p}cut"), F.array(F.size(f"{p}all")))
    kept = F.flatten(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")),
                                 lambda g: F.slice(F.col(f"{p}all"), g["a"] + 1, g["b"] - g["a"])))
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = rows.withColumn(f"{p}all", lines)
    out = F.when(F.col(f"{p}cut").isNull(), whole).otherwise(F.array_join(kept, "\n"))
    return (rows.withColumn("n_lines", F.size(f"{p}all").cast("long")).withColumn("n_dropped", n.cast("long"))
            .withColumn(text, out).drop(*[f"{p}{c}" for c in ("doc", "version", "cut", "hash", "all")]))
