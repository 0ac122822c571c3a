"""Line-aligned text sources (S1-S4, S7, S8) and manifests.

Row identity of a text line is its position, which a partitioned read does
not keep.  The readers rebuild it without a global sort, an RDD or a shuffle
of the text: one scan writes the lines with their file, split and read order
to a keyed Parquet table in the shared folder; one small row per split (line
count and first row id) and an exclusive running sum over the splits give
every split its offset.  Text is read once, so the numbering cannot depend
on two scans being split alike.
"""

from __future__ import annotations

import csv
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import py_strip, strip_bom
from ..operators.align import AlignmentError, zip_strict, zip_truncate
from ..operators.corpus import manifest_rows, validation_manifest_rows
from ..session import broadcast_if_small, materialize
from .csv_records import read_csv_records

#: columns that carry a line's place: path in the order given, file, split
_PLACE = ["__o", "__d", "__p", "__f", "__b"]


def _place(path_no: int):
    """Place columns of a file scan.  Files of one path are ordered by
    folder, then by the number in a part file's name (``part-100000`` comes
    after ``part-10001``), then by name."""
    f = F.col("_metadata.file_path")
    number = F.regexp_extract(f, r"/part-(\d+)[^/]*$", 1)
    return [F.lit(path_no).alias("__o"), F.regexp_extract(f, r"^(.*)/", 1).alias("__d"),
            F.when(number != "", number.cast("long")).otherwise(-1).alias("__p"), f.alias("__f"),
            F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__m")]


def _paths(path) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def _text_scan(spark: SparkSession, path, cols=()) -> DataFrame:
    scans = [spark.read.text(p).select("value", *cols, *_place(i)) for i, p in enumerate(_paths(path))]
    return reduce(DataFrame.unionByName, scans)


class Numbered:
    """Lines with their position in a group, and the line counts of the groups.

    A split is read in order by one task and ``monotonically_increasing_id``
    advances by one per row inside a partition, so a line's rank in its split
    is ``__m - min(__m over the split)``."""

    def __init__(self, scan: DataFrame, group=()):
        group = list(group)
        stored = materialize(scan, "lines")
        splits = stored.groupBy(*dict.fromkeys([*group, *_PLACE])).agg(
            F.count(F.lit(1)).alias("__n"), F.min("__m").alias("__m0"))
        w = Window.partitionBy(*group).orderBy(*_PLACE).rowsBetween(Window.unboundedPreceding, -1)
        offsets = splits.select(F.xxhash64("__o", "__f").alias("__h"), F.col("__b"), "__m0",
                                F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"), *group, "__n")
        offsets = materialize(offsets, "splits")
        self.counts = offsets.groupBy(*group).agg(F.sum("__n").cast("long").alias("n"))
        # four numbers a split: broadcast while that is small, a shuffle join beyond
        small = broadcast_if_small(offsets.select("__h", "__b", "__m0", "__off"))
        self.lines = (stored.withColumn("__h", F.xxhash64("__o", "__f")).join(small, ["__h", "__b"])
                      .withColumn("line_no", (F.col("__off") + F.col("__m") - F.col("__m0") + 1).cast("long")))


def read_lines(spark: SparkSession, path, corpus: str | None = None, lang: str | None = None,
               per_file: bool = False, strip: bool = True) -> DataFrame:
    """One row per line, both ends stripped (Python ``strip``), numbered
    from 1.  ``path`` may be a file, a folder or a list; lines are numbered
    across all files, paths in the order given and files of a folder in part
    order, unless ``per_file``."""
    out = Numbered(_text_scan(spark, path), ["__f"] if per_file else []).lines
    text = strip_bom(F.col("value"))
    if strip:
        text = py_strip(text)
    cols = [F.lit(corpus).alias("corpus")] if corpus is not None else []
    cols += [F.lit(lang).alias("lang")] if lang is not None else []
    if per_file:
        cols.append(F.col("__f").alias("file"))
    return out.select(*cols, "line_no", text.alias("text"))


def _stripped(lines: DataFrame, name: str, keys=()) -> DataFrame:
    return lines.select(*keys, "line_no", py_strip(strip_bom(F.col("value"))).alias(name))


def _same_counts(s: Numbered, t: Numbered, key: str, names) -> None:
    """Raise unless both sides have as many lines for every key; ``names``
    gives the two names to show for a key.  Reads the split tables only."""
    a, b = s.counts.withColumnRenamed("n", "a"), t.counts.withColumnRenamed("n", "b")
    bad = a.join(b, key, "full_outer").where(~F.coalesce(F.col("a"), F.lit(0)).eqNullSafe(F.coalesce(F.col("b"), F.lit(0))))
    rows = bad.orderBy(key).limit(5).collect()
    if rows:
        raise AlignmentError("; ".join("{0} and {1} differ in line count: {2} and {3}".format(
            *names(r[key]), r["a"] or 0, r["b"] or 0) for r in rows))


def _zipped(s: Numbered, t: Numbered, key: str, alignment: str) -> DataFrame:
    """The lines of both sides by ``key`` and position.  ``truncate`` knows from the split
    tables where the shorter side ends: lines beyond have no partner and are not moved."""
    sides = [_stripped(s.lines, "source", [key]), _stripped(t.lines, "target", [key])]
    if alignment == "truncate":
        ends = s.counts.join(t.counts.withColumnRenamed("n", "m"), key).select(key, F.least("n", "m").alias("__end"))
        ends = broadcast_if_small(materialize(ends, "ends"))
        sides = [x.join(ends, key).where("line_no <= __end").drop("__end") for x in sides]
    return zip_truncate(*sides, [key])


def read_parallel(spark: SparkSession, src_path, tgt_path, alignment: str = "strict",
                  corpus: str | None = None) -> DataFrame:
    """Pair the lines of two files, or of two lists of files pair by
    pair in the order given.  ``strict`` raises when a pair differs in line
    count, naming both files; ``truncate`` drops the longer one's tail.
    ``line_no`` counts the pairs over all files."""
    if alignment not in ("strict", "truncate"):
        raise ValueError("alignment must be 'strict' or 'truncate'")
    left, right = _paths(src_path), _paths(tgt_path)
    if len(left) != len(right):
        raise AlignmentError(f"{len(left)} source files but {len(right)} target files")
    s, t = Numbered(_text_scan(spark, left), ["__o"]), Numbered(_text_scan(spark, right), ["__o"])
    if alignment == "strict":
        _same_counts(s, t, "__o", lambda i: (left[i], right[i]))
    pairs = _zipped(s, t, "__o", alignment)
    # a list of files is configuration: one row per pair of files, a window over them is small
    sizes = s.counts.join(t.counts.withColumnRenamed("n", "m"), "__o").select("__o", F.least("n", "m").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = broadcast_if_small(materialize(sizes.select("__o", before.cast("long").alias("__first")), "files"))
    out = pairs.join(first, "__o").select((F.col("__first") + F.col("line_no")).alias("line_no"), "source", "target")
    return out.withColumn("corpus", F.lit(corpus)) if corpus is not None else out


def read_corpora(spark: SparkSession, root: str, names: list[str], pair: str, src: str, tgt: str,
                 alignment: str = "strict") -> DataFrame:
    """A family of sub-corpora named ``{name}.{pair}.{lang}``; lines are
    numbered per corpus.  ``strict`` (the default) raises when the sides of
    a corpus differ in line count, ``truncate`` drops the longer one's tail."""
    if alignment not in ("strict", "truncate"):
        raise ValueError("alignment must be 'strict' or 'truncate'")
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("__o") + 1)

    def side(lang):
        scan = _text_scan(spark, [os.path.join(root, f"{n}.{pair}.{lang}") for n in names])
        return Numbered(scan.withColumn("corpus", named), ["corpus"])

    s, t = side(src), side(tgt)
    if alignment == "strict":
        _same_counts(s, t, "corpus", lambda n: (f"{n}.{pair}.{src}", f"{n}.{pair}.{tgt}"))
    return _zipped(s, t, "corpus", alignment)


def read_manifest(spark: SparkSession, manifest_json: str, root: str = "", alignment: str = "strict") -> DataFrame:
    """Every file pair that the manifest ``{tag: [{source, target}, ...]}``
    lists, as rows (tag, ord, line_no, source, target); an entry listed twice
    is there twice.  A missing file is an error."""
    entries = manifest_rows(spark, manifest_json).orderBy("tag", "ord").collect()  # configuration
    return _read_entries(spark, [(r["source"], r["target"]) for r in entries], root, alignment,
                         {"tag": [r["tag"] for r in entries], "ord": [r["ord"] for r in entries]})


def read_validation_manifest(spark: SparkSession, manifest_json: str, root: str = "", alignment: str = "strict") -> DataFrame:
    """The one file pair of each task, as rows (task, line_no, source, target)."""
    entries = validation_manifest_rows(spark, manifest_json).orderBy("task").collect()  # configuration
    return _read_entries(spark, [(r["source"], r["target"]) for r in entries], root, alignment,
                         {"task": [r["task"] for r in entries]})


def _read_entries(spark: SparkSession, pairs: list[tuple[str, str]], root: str, alignment: str, labels: dict) -> DataFrame:
    """Reads each distinct file pair once and gives its lines to every entry that names it."""
    if alignment not in ("strict", "truncate"):
        raise ValueError("alignment must be 'strict' or 'truncate'")
    files = list(dict.fromkeys(pairs))
    at = lambda p: os.path.join(root, p) if root else p
    s = Numbered(_text_scan(spark, [at(a) for a, _ in files]), ["__o"])
    t = Numbered(_text_scan(spark, [at(b) for _, b in files]), ["__o"])
    if alignment == "strict":
        _same_counts(s, t, "__o", lambda i: files[i])
    lines = _zipped(s, t, "__o", alignment)
    rows = [(files.index(p), *v) for p, v in zip(pairs, zip(*labels.values()))]
    kinds = ", ".join(f"{k} {'int' if isinstance(v[0], int) else 'string'}" for k, v in labels.items())
    entries = F.broadcast(spark.createDataFrame(rows, f"__o int, {kinds}"))  # a row per manifest entry
    return lines.join(entries, "__o").select(*labels, "line_no", "source", "target")


def read_partitioned_lines(spark: SparkSession, root: str, partition_by="corpus") -> DataFrame:
    """Lines written by ``write_lines(..., partition_by=...)``: numbered per
    partition folder, in file order."""
    cols = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    return _stripped(Numbered(_text_scan(spark, root, cols), cols).lines, "text", cols)


class UnsupportedFormat(ValueError):
    pass


def _csv_text(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, text)`` of CSV files, each with a header; the first file's header names the columns of all."""
    scan = spark.read.option("lineSep", "\n").text(path).select("value", *_place(0))
    records = read_csv_records(spark, scan)
    files = records.groupBy("__o", "__f").agg((F.max("number") - 1).alias("n"))
    named = files.select("__o", "__f", "n", F.regexp_extract("__f", r"^(.*)/", 1).alias("__d"),
                         F.coalesce(F.regexp_extract("__f", r"/part-(\d+)[^/]*$", 1).try_cast("long"), F.lit(-1)).alias("__p"))
    over = Window.orderBy("__o", "__d", "__p", "__f")
    # a row a file: as few as the files that a folder listing holds
    files = materialize(named.select("__o", "__f", F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
                                     F.row_number().over(over).alias("file_no")), "csv-files")
    first = files.where("file_no = 1").select("__o", "__f")
    head = records.where("number = 1").join(F.broadcast(first), ["__o", "__f"]).select(strip_bom(F.col("record"))).first()
    if head is None:
        raise UnsupportedFormat(f"no header in {path}")
    names = next(csv.reader([head[0]]))
    at = names.index("text") if "text" in names else 0
    fields = ", ".join(f"c{i} string" for i in range(at + 1))
    text = F.from_csv("record", fields, {"escape": '"', "maxCharsPerColumn": "-1"})[f"c{at}"]
    return (records.where("number > 1").join(broadcast_if_small(files.select("__o", "__f", "before")), ["__o", "__f"])
            .select((F.col("before") + F.col("number") - 1).cast("long").alias("line_no"), text.alias("text")))


def _json_text(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, text)`` of JSON lines, read once: both columns that may be the text are stored, then one is chosen."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    head = lines.select(F.json_object_keys("value").alias("k")).first()
    if head is None or not head["k"]:
        raise UnsupportedFormat(f"no JSON object with a field in {path}")
    first = head["k"][0]
    kind = StructType([StructField(c, StringType()) for c in dict.fromkeys(["text", first])])
    row = F.from_json("value", kind)
    scan = lines.select(row["text"].alias("value"), row[first].alias("first"), F.array_contains(F.json_object_keys("value"), "text").alias("has"), *_place(0))
    numbered = Numbered(scan).lines
    has = numbered.agg(F.coalesce(F.max("has"), F.lit(False))).first()[0]
    return numbered.select("line_no", F.col("value" if has else "first").alias("text"))


def read_lm(spark: SparkSession, path: str, keep_linebreaks: bool = True) -> DataFrame:
    """Csv / json / txt chosen by extension (anything else is an
    error); the text column is ``text`` if present, else the first column of
    the file.  Text files keep each line's trailing newline when
    ``keep_linebreaks``.  CSV fields may be quoted, with doubled quotes and
    line breaks inside (records end at ``\\n`` or ``\\r\\n``); an empty field
    that is not quoted is null.  JSON files hold an object a line; values
    that are no strings keep their JSON text, lines that are no objects are
    null.  Files of any size are read in splits, once."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in os.path.basename(path.rstrip("/")) else ""
    if ext == "txt":
        df = read_lines(spark, path, strip=False)
        return df.withColumn("text", F.concat("text", F.lit("\n"))) if keep_linebreaks else df
    if ext == "csv":
        return _csv_text(spark, path)
    if ext in ("json", "jsonl"):
        return _json_text(spark, path)
    raise UnsupportedFormat(f"read_lm reads .csv, .json, .jsonl and .txt files, not {path!r}")
