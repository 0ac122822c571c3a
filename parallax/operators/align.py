"""Positional alignment of line tables.

Row identity of a text line is its position, so aligning two corpora is an
equi-join on ``(key..., line_no)``.  The join key is unique per row on both
sides, so no key is hot even when one corpus is a third of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class AlignmentError(ValueError):
    pass


def zip_truncate(src: DataFrame, tgt: DataFrame, keys=(), line_col: str = "line_no") -> DataFrame:
    """Pair by position; the longer side's tail is dropped (inner join)."""
    return src.join(tgt, [*keys, line_col], "inner")


def zip_strict(src: DataFrame, tgt: DataFrame, keys=(), line_col: str = "line_no",
               names=("source", "target")) -> DataFrame:
    """Pair by position; a line without a partner raises an error that
    names both sides, when the result is computed.

    One full outer join is both the pairing and the check, so nothing is
    read twice."""
    at = [*keys, line_col]
    both = src.withColumn("__l", F.lit(1)).join(tgt.withColumn("__r", F.lit(1)), at, "full_outer")
    place = F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in at])
    message = F.concat(F.lit(f"{names[0]} and {names[1]} differ in line count: no partner at "), place)
    paired = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    return both.where(F.when(paired, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).drop("__l", "__r")


def paste(frames: list[DataFrame], columns: list[str], keys=(), line_col: str = "line_no") -> DataFrame:
    """Unix ``paste``: join by position, the shorter inputs padded with ''.

    ``frames[i]`` must have ``keys``, ``line_col`` and the column ``columns[i]``.
    """
    out = frames[0].select(*keys, line_col, columns[0])
    for f, c in zip(frames[1:], columns[1:]):
        out = out.join(f.select(*keys, line_col, c), [*keys, line_col], "full_outer")
    return out.select(*keys, line_col, *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns])
