"""Skew-safe running aggregates (positions, running sums, running maxima).

A window ``PARTITION BY g ORDER BY o`` sends a whole group to one task; when
one corpus or run holds a third of all rows that task does a third of the
job.  These helpers compute the same prefix values in two levels:

1. every row gets a *chunk* number (a monotone bucket of the order key,
   ``chunk_by_count``, or a file split);
2. one aggregate row per ``(group, chunk)`` -- a table ~chunk-size times
   smaller than the input -- gets the exclusive prefix over earlier chunks;
3. a window partitioned by ``(group, chunk)`` finishes the prefix inside the
   chunk, and the two are combined.

No window ever holds more than one chunk, the chunk table is joined back on
``(group, chunk)`` (AQE broadcasts it once it has measured it), and the
result equals the single-window definition exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CHUNK = "__chunk"


def _cols(x):
    return [x] if isinstance(x, (str, Column)) else list(x)


def _join_same(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Inner join on equal values of ``on``, null equal to null."""
    for c in on:
        right = right.withColumnRenamed(c, f"__on_{c}")
    same = [F.col(c).eqNullSafe(F.col(f"__on_{c}")) for c in on]
    rest = [c for c in [*left.columns, *right.columns] if c not in on and not c.startswith("__on_")]
    return left.join(right, same).select(*on, *rest)


#: rows that a chunk is meant to hold
ROWS_PER_CHUNK = 4096


#: quantiles whose ranges are cut into chunks one by one, denser towards both ends
QUANTILES = sorted({i / 32 for i in range(33)} | {x for j in range(1, 8) for x in (2.0 ** -j / 32, 1 - 2.0 ** -j / 32)})


def chunk_by_count(df: DataFrame, group_cols, order_col: str, name: str = "__by_count",
                   rows: int | None = None) -> DataFrame:
    """Adds the chunk number ``name``: each group's range of the (numeric)
    order key is cut into parts of about ``rows`` (``ROWS_PER_CHUNK``) rows.

    Where the keys lie evenly, the parts are count / ``rows`` equal widths.
    Where any 32nd of the rows lies four times as dense as that (a key far
    out, steps in bursts), the range is cut at approximate quantiles first and
    each part between two of them into equal widths, so that a key far out
    stretches only the part that it ends.  Equal keys share a chunk."""
    group_cols = _cols(group_cols)
    x = F.col(order_col).cast("double")
    cut = F.percentile_approx(x, F.array(*[F.lit(q) for q in QUANTILES]), F.lit(10_000))
    stats = df.groupBy(*group_cols).agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"), cut.alias("__cut"), F.count(F.lit(1)).alias("__cnt"))
    grid = F.array(*[F.lit(QUANTILES.index(i / 32) + 1) for i in range(33)])
    gaps = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.element_at("__cut", F.element_at(grid, i + 1)) - F.element_at("__cut", F.element_at(grid, i)))
    even = (F.col("__cnt") <= (rows or ROWS_PER_CHUNK)) | F.coalesce(F.array_min(gaps) >= (F.col("__hi") - F.col("__lo")) / 128, F.lit(True))
    stats = stats.withColumn("__cut", F.when(~even, F.array_distinct("__cut")))
    if group_cols:
        j = _join_same(df, stats, group_cols)
    else:  # one row of scalars
        j = (df.withColumn("__st", stats.select(F.struct("__lo", "__hi", "__cut", "__cnt")).scalar())
             .select(*df.columns, "__st.*"))
    parts = F.ceil(F.col("__cnt") / (rows or ROWS_PER_CHUNK))
    at = F.floor((x - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * parts)
    wide = F.when(F.col("__hi") > F.col("__lo"), F.least(at, parts - 1)).otherwise(F.lit(0))
    j = j.withColumn("__q", F.greatest(F.size(F.filter("__cut", lambda b: b <= x)), F.lit(1)))
    low, high = F.try_element_at("__cut", F.col("__q")), F.try_element_at("__cut", F.col("__q") + 1)
    fine = F.ceil(F.col("__cnt") / (32 * (rows or ROWS_PER_CHUNK)))
    inner = F.when(high > low, F.least(F.greatest(F.floor((x - low) / (high - low) * fine), F.lit(0)), fine - 1)).otherwise(F.lit(0))
    chunk = (F.when(F.col("__cut").isNull(), wide).when(x.isNotNull(), F.col("__q") * fine + inner)
             .otherwise((F.size("__cut") + 1) * fine))  # null keys come last, as among equal widths
    return j.withColumn(name, F.coalesce(chunk, F.lit(-1)).cast("long")).drop("__lo", "__hi", "__cut", "__cnt", "__q")


def prefix_scan(df: DataFrame, group_cols, chunk: Column, order_cols, specs) -> DataFrame:
    """Add running aggregates to ``df``.

    ``specs`` is a list of ``(name, kind, value, inclusive)`` with ``kind`` in
    ``{"sum", "max", "count"}``; ``value`` is a Column (ignored for count).
    The chunk column must be non-decreasing along ``order_cols`` within a
    group.
    """
    group_cols = _cols(group_cols)
    order_cols = _cols(order_cols)
    d = df.withColumn(_CHUNK, chunk)
    vals = {}
    for name, kind, value, _inc in specs:
        if kind == "count":
            vals[name] = F.lit(1).cast("long")
        else:
            vals[name] = value
        d = d.withColumn(f"__v_{name}", vals[name])

    aggs = []
    for name, kind, _value, _inc in specs:
        fn = F.max if kind == "max" else F.sum
        aggs.append(fn(f"__v_{name}").alias(f"__c_{name}"))
    per_chunk = d.groupBy(*group_cols, _CHUNK).agg(*aggs)
    wc = Window.partitionBy(*group_cols).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = []
    for name, kind, _value, _inc in specs:
        fn = F.max if kind == "max" else F.sum
        carry_cols.append(fn(f"__c_{name}").over(wc).alias(f"__k_{name}"))
    carry = per_chunk.select(*group_cols, _CHUNK, *carry_cols)

    d = _join_same(d, carry, [*group_cols, _CHUNK])
    wr = Window.partitionBy(*group_cols, _CHUNK).orderBy(*order_cols)
    for name, kind, _value, inc in specs:
        frame = wr.rowsBetween(Window.unboundedPreceding, 0 if inc else -1)
        if kind == "max":
            local = F.max(f"__v_{name}").over(frame)
            d = d.withColumn(name, F.greatest(F.col(f"__k_{name}"), local))
        else:
            local = F.coalesce(F.sum(f"__v_{name}").over(frame), F.lit(0))
            d = d.withColumn(name, F.coalesce(F.col(f"__k_{name}"), F.lit(0)) + local)
    drop = [_CHUNK] + [f"__v_{n}" for n, *_ in specs] + [f"__k_{n}" for n, *_ in specs]
    return d.drop(*drop)


def positions(df: DataFrame, group_cols, chunk: Column, order_cols, name: str = "pos") -> DataFrame:
    """1-based row position inside each group, ordered by ``order_cols``."""
    out = prefix_scan(df, group_cols, chunk, order_cols, [(name, "count", None, True)])
    return out.withColumn(name, F.col(name).cast("long"))


def weighted_offsets(df: DataFrame, group_cols, chunk: Column, order_cols, weight: Column,
                     name: str = "offset") -> DataFrame:
    """Sum of ``weight`` over the rows strictly before each row in its group."""
    out = prefix_scan(df, group_cols, chunk, order_cols, [(name, "sum", weight, False)])
    return out.withColumn(name, F.col(name).cast("long"))


def document_offsets(docs: DataFrame, group_cols, doc_col: str = "doc_id", count: str = "__n",
                     name: str = "__doc_off") -> DataFrame:
    """Lines before each document in its group, from one row per document
    with its line ``count``; a null document comes last, where
    ``chunk_by_count`` puts it."""
    group_cols = _cols(group_cols)
    docs = chunk_by_count(docs, group_cols, doc_col)
    return weighted_offsets(docs, group_cols, F.col("__by_count"), [F.col(doc_col).asc_nulls_last()], F.col(count), name).drop("__by_count")


def line_positions(lines: DataFrame, group_cols, doc_col: str = "doc_id", line_col: str = "line_no",
                   name: str = "pos", dense: bool = False) -> DataFrame:
    """Position of every line in its group when lines are ordered by
    ``(doc, line)``: an offset per document (two-level scan over one row per
    document) plus the rank of the line inside the document.  With
    ``dense=True`` the line numbers are known to be 1..n in every document
    (e.g. straight from ``posexplode``) and are used as the rank directly."""
    group_cols = _cols(group_cols)
    per_doc = lines.groupBy(*group_cols, doc_col).agg(F.count(F.lit(1)).alias("__n"))
    per_doc = document_offsets(per_doc, group_cols, doc_col)
    out = _join_same(lines, per_doc.select(*group_cols, doc_col, "__doc_off"), [*group_cols, doc_col])
    if dense:
        return out.withColumn(name, (F.col("__doc_off") + F.col(line_col)).cast("long")).drop("__doc_off")
    # one window per document: a document is a single input row, so bounded
    inner = F.row_number().over(Window.partitionBy(*group_cols, doc_col).orderBy(line_col))
    return out.withColumn(name, (F.col("__doc_off") + inner).cast("long")).drop("__doc_off")


def positioned_lines(docs: DataFrame, group_cols, parts: str, doc_col: str = "doc_id", line_col: str = "line_no",
                     item: str = "text", name: str = "pos", total: str | None = None) -> DataFrame:
    """The items of the array column ``parts`` as rows, with their number in
    the document (``line_no``) and their position in the group ordered by
    (document, item).

    The offset is found for the documents, from their counts alone, and
    the items are exploded afterwards: no exploded row is ever moved.
    Null groups and documents count like any other, a null document last.
    Only where rows share a document are their items ranked by item number,
    equal numbers by a hash of the row, in chunks of bounded size.
    ``total`` names a column for the group's number of items."""
    group_cols = _cols(group_cols)
    rows = docs.select(*group_cols, doc_col, F.greatest(F.coalesce(F.size(parts), F.lit(0)), F.lit(0)).cast("long").alias("__n"))
    counts = rows.groupBy(*group_cols, doc_col).agg(F.sum("__n").alias("__n"), F.count(F.lit(1)).alias("__rows"))
    offsets = document_offsets(counts, group_cols, doc_col).drop("__n")
    if total:
        offsets = _join_same(offsets, counts.groupBy(*group_cols).agg(F.sum("__n").alias(total)), group_cols)
    out = _join_same(docs, offsets, [*group_cols, doc_col])
    keep = [c for c in out.columns if c != parts]
    single = out.where("__rows = 1").select(*keep, F.posexplode(parts).alias("__i", item)).withColumn("__rank", F.col("__i") + F.lit(1).cast("long"))
    shared = (out.where("__rows > 1").withColumn("__h", F.xxhash64(*docs.columns))
              .select(*keep, "__h", F.posexplode(parts).alias("__i", item)))
    cuts = F.ceil(F.col("__rows") / ROWS_PER_CHUNK)
    chunk = F.col("__i") * cuts + F.pmod(F.col("__h"), cuts)
    shared = positions(shared.withColumn("__cut", F.pmod("__h", cuts)), [*group_cols, doc_col], chunk, ["__i", "__cut", "__h"], "__rank")
    out = single.unionByName(shared.drop("__h", "__cut"))
    return (out.withColumn(line_col, (F.col("__i") + 1).cast("long"))
            .withColumn(name, (F.col("__doc_off") + F.col("__rank")).cast("long")).drop("__i", "__rank", "__rows", "__doc_off"))
