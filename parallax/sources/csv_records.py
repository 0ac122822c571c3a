"""CSV files whose fields may hold line breaks, read by all cores.

A byte range of such a file cannot tell by itself whether it begins inside a
quoted field.  So the lines of each split are followed from both states at
once: one pass over the file stores with every line the state and the number
of records before it for either beginning.  The splits' end states, composed
in file order (a row a split), then choose for each split, and lines that do
not hold a whole record are put together by record number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize

#: lines of one record beyond which a quote counts as never closed
MAX_RECORD_LINES = 1_000_000


class UnclosedQuote(ValueError):
    pass


def quote_state(line: str, inside: bool, sep: str = ",", quote: str = '"') -> bool:
    """Whether ``line`` ends inside a quoted field, having begun ``inside`` one or not.

    A quote opens a field only at its beginning; a doubled one inside is part of it."""
    at = 0
    while True:
        if inside:
            at = line.find(quote, at)
            if at < 0:
                return True
            if line.startswith(quote, at + 1):
                at += 2
                continue
        elif line.startswith(quote, at):
            inside, at = True, at + 1
            continue
        inside, at = False, line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


def _follow(sep: str, quote: str):
    """Lines of splits in order -> the same with states and record numbers for either beginning.

    ``in0``/``in1``: the line begins inside a field; ``out0``/``out1``: it ends
    inside one; ``rec0``/``rec1``: records of the split begun up to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, state, count = None, [False, True], [0, 0]
        for batch in batches:
            values = batch.column("value").to_pylist()
            places = list(zip(batch.column("__f").to_pylist(), batch.column("__b").to_pylist()))
            n = len(values)
            cols = {c: np.zeros(n, bool if c[0] != "r" else np.int64) for c in ("in0", "in1", "out0", "out1", "rec0", "rec1")}
            for i, (line, place) in enumerate(zip(values, places)):
                if place != split:
                    split, state, count = place, [False, True], [0, 0]
                plain, blank = quote not in line, not line.rstrip("\r")
                for s in (0, 1):
                    cols[f"in{s}"][i] = state[s]
                    count[s] += not state[s] and not blank
                    cols[f"rec{s}"][i] = count[s]
                    if not plain:
                        state[s] = quote_state(line, state[s], sep, quote)
                    cols[f"out{s}"][i] = state[s]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x) for x in cols.values()]], [*batch.schema.names, *cols])

    return run


def _split_starts(stored: DataFrame) -> DataFrame:
    """``(__o, __f, __b, start, before, records)``: for each split the state it really begins in,
    the records begun before it in its file, and those of all files up to its own."""
    last = lambda c: F.max_by(c, "__m").alias(c)
    splits = stored.groupBy("__o", "__d", "__p", "__f", "__b").agg(last("out0"), last("out1"), F.max("rec0").alias("rec0"), F.max("rec1").alias("rec1"))
    before = Window.partitionBy("__o", "__f").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    # from either beginning a split ends alike (fixed), as it began (kept) or the other way round (turned)
    turned = F.coalesce(F.sum(F.when((F.col("out0") != F.col("out1")) & F.col("out0"), 1).otherwise(0)).over(
        Window.partitionBy("__o", "__f").orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
    splits = splits.withColumn("turns", turned)
    fixed = F.last(F.when(F.col("out0") == F.col("out1"), F.struct(F.col("out0").alias("state"), F.col("turns"))), ignorenulls=True).over(before)
    splits = splits.withColumn("fixed", fixed).withColumn("sofar", F.coalesce(F.max("turns").over(before), F.lit(0)))
    odd = (F.col("sofar") - F.coalesce("fixed.turns", F.lit(0))) % 2 == 1
    splits = splits.withColumn("start", F.coalesce("fixed.state", F.lit(False)) != odd)
    splits = splits.withColumn("n", F.when(F.col("start"), F.col("rec1")).otherwise(F.col("rec0")))
    return splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def read_csv_records(spark: SparkSession, scan: DataFrame, sep: str = ",", quote: str = '"',
                     max_record_lines: int = MAX_RECORD_LINES) -> DataFrame:
    """``(__o, __f, number, record)``: the records of CSV files, numbered from 1 in each file.

    ``scan`` holds the files' lines as ``value`` (cut at ``\\n`` only) with
    their place columns.  Blank lines between records are no records; a
    carriage return before a record's end is dropped, inside fields it stays.
    A quote that stays open for more than ``max_record_lines`` lines raises."""
    names = {"value": "string", **dict(scan.dtypes)}
    schema = ", ".join(f"`{c}` {names[c]}" for c in scan.columns) + ", in0 boolean, in1 boolean, out0 boolean, out1 boolean, rec0 long, rec1 long"
    stored = materialize(scan.mapInArrow(_follow(sep, quote), schema), "csv")
    starts = materialize(_split_starts(stored).select("__o", "__f", "__b", "start", "before"), "csv-splits")
    lines = stored.join(broadcast_if_small(starts), ["__o", "__f", "__b"])
    pick = lambda c: F.when(F.col("start"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    lines = lines.select("__o", "__f", "__b", "__m", "value", pick("in").alias("in"), pick("out").alias("out"),
                         (F.col("before") + pick("rec")).cast("long").alias("number"))
    ended = lambda c: F.regexp_replace(c, "\r$", "")
    whole = lines.where("not `in` and not `out`").select("__o", "__f", "number", ended("value").alias("record")).where("record <> ''")
    parts = lines.where("`in` or `out`")
    long_ = parts.groupBy("__o", "__f", "number").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_record_lines).limit(1).collect()
    if long_:
        raise UnclosedQuote(f"record {long_[0]['number']} of {long_[0]['__f']} has {long_[0]['n']} lines: its quote is not closed")
    joined = (parts.groupBy("__o", "__f", "number").agg(F.array_sort(F.collect_list(F.struct("__b", "__m", "value"))).alias("rows"))
              .select("__o", "__f", "number", ended(F.array_join(F.col("rows")["value"], "\n")).alias("record")))
    return whole.unionByName(joined)
