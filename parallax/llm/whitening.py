"""Embedding whitening: distributed centred covariance, eigenvectors on the driver, broadcast projection.

Entries become whole numbers, so sums and products add up exactly in any
order: sums first, then products of the vectors centred by the whole number
nearest to the mean; what is left of the mean is taken off the sums of
products without rounding.  Only matrices of the vectors' dimensions reach
the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, functions as F

from . import symmetric_eigen
from ._common import batch_limits, save

#: cells of all covariance matrices that the driver takes (one matrix for each length of vector)
MAX_CELLS = 2048 ** 2
#: entries beyond this have no whole number and drop their row
MOST = 2.0 ** 60
_LIMB, _LIMBS = 40, 3


def _spaces(vectors: pa.ListArray, scale: float, offset: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of vector: it, the places of those rows, and their whole numbers."""
    length = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    start = np.cumsum(length) - length
    for d in np.unique(length):
        rows = np.flatnonzero(length == d)
        yield int(d), rows, np.floor(scale * flat[start[rows][:, None] + np.arange(d)]).astype(np.int64) + offset


def _split(v: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as limbs of 40 bits, the last one signed."""
    mask = (1 << _LIMB) - 1
    top = (v >> 80) if v.dtype == object else (v >> 63)
    return [np.asarray(x, np.int64) for x in (v & mask, (v >> _LIMB) & mask, top)]


def _rows(dim: int, cells: np.ndarray, values: np.ndarray, n: int) -> pa.RecordBatch:
    cols = [pa.array([dim] * len(cells), pa.int64()), pa.array(cells, pa.int64()), *[pa.array(x) for x in _split(values)],
            pa.array([n] * len(cells), pa.int64())]
    return pa.RecordBatch.from_arrays(cols, ["dim", "cell", "l0", "l1", "l2", "n"])


_SUMS = "dim long, cell long, l0 long, l1 long, l2 long, n long"


def _sums(scale: float, offset: int):
    """Sums of each entry and the number of vectors (cell -1 stands for vectors without entries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for batch in batches:
            for d, rows, x in _spaces(batch.column(1), scale, offset):
                # halves of the numbers, so that no sum passes 64 bits
                part = (x >> 31).sum(axis=0).astype(object) * (1 << 31) + (x & ((1 << 31) - 1)).sum(axis=0).astype(object)
                total[d] = total[d] + part if d in total else part
                count[d] = count.get(d, 0) + len(rows)
        for d, s in total.items():
            yield _rows(d, np.arange(d), s, count[d]) if d else _rows(0, np.array([-1]), np.zeros(1, np.int64), count[0])

    return run


def gram(z: np.ndarray) -> np.ndarray:
    """The exact ``z.T @ z`` of whole numbers."""
    most = int(np.abs(z).max(initial=0))
    if most * most * len(z) < 1 << 53:
        f = z.astype(float)
        return (f.T @ f).astype(np.int64)
    out = np.zeros((z.shape[1],) * 2, object)
    for at in range(0, len(z), 1024):  # limbs of 21 bits: products of 1,024 rows stay below 2 ** 53
        part = z[at:at + 1024]
        limbs = [(part & 0x1FFFFF).astype(float), ((part >> 21) & 0x1FFFFF).astype(float), (part >> 42).astype(float)]
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                out += (a.T @ b).astype(np.int64).astype(object) * (1 << 21 * (i + j))
    return out


def _products(scale: float, offset: int, centre):
    """Sums of products of the centred entries, the upper half of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}

        def cells(d: int) -> pa.RecordBatch:
            i, j = np.triu_indices(d)
            return _rows(d, i * d + j, total[d][i, j], 0)

        for batch in batches:
            for d, _, x in _spaces(batch.column(1), scale, offset):
                part = gram(x - centre.value[d])
                if d in total and total[d].dtype != object and (part.dtype == object or int(np.abs(total[d]).max(initial=0)) > 1 << 61):
                    total[d] = total[d].astype(object)
                total[d] = total[d] + part if d in total else part
        for d in total:
            if d:
                yield cells(d)

    return run


def _collect(rows: DataFrame) -> dict[int, tuple[np.ndarray, list[int], int]]:
    """Exact sums by dimension: cells, their values, number of vectors."""
    summed = rows.groupBy("dim", "cell").agg(*[F.sum(c).alias(c) for c in ("l0", "l1", "l2", "n")]).toPandas().sort_values(["dim", "cell"])
    out = {}
    for dim, part in summed.groupby("dim"):
        limbs = [part[c].tolist() for c in ("l0", "l1", "l2")]
        out[int(dim)] = part["cell"].to_numpy(), [a + (b << _LIMB) + (c << 2 * _LIMB) for a, b, c in zip(*limbs)], int(part["n"].iloc[0])
    return out


def covariance(n: int, rest: list[int], cells: np.ndarray, products: list[int]) -> np.ndarray:
    """Of n vectors whose entries, centred by a whole number, sum to ``rest``: each entry rounded once."""
    d = len(rest)
    v = np.zeros((d, d))
    for cell, p in zip(cells.tolist(), products):
        i, j = divmod(cell, d)
        v[i, j] = v[j, i] = (n * p - rest[i] * rest[j]) / (n * n)
    return v


def _project(scale: float, offset: int, model):
    """Rows ``(id, vector)`` -> ``(id, dim, deviation, whitened)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, x in _spaces(batch.column(1), scale, offset):
                n, centre, rest, wide, shift, weights = model.value[d]
                z = x - centre
                white = (z.astype(float) - shift) @ weights
                # the whole numbers may wrap round, but a sum below 2 ** 63 is right again at the end
                with np.errstate(over="ignore"):
                    exact = ((z * np.int64(n) - rest) ** 2).sum(axis=1)
                rough = ((z.astype(float) - shift) ** 2).sum(axis=1) * float(n) ** 2
                unsure = np.flatnonzero(np.abs(rough / 2.0 ** 63 - 1) < 1e-6)
                large = rough >= 2.0 ** 63
                for i in unsure:
                    true = sum((n * int(a) - b) ** 2 for a, b in zip(z[i], wide))
                    large[i] = true >= 1 << 63
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * weights.shape[1]), pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), d, np.int64)),
                                                  pa.array(exact, mask=large), lists], ["id", "dim", "deviation", "whitened"])

    return run


def _white_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums (row 0) and sums of products of whitened vectors ``(dim, whitened)``."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for d in pa.compute.unique(batch.column(0)).to_pylist():
            some = batch.column(1).filter(pa.compute.equal(batch.column(0), d))
            w = some.flatten().to_numpy(zero_copy_only=False).reshape(len(some), -1)
            part = np.vstack([w.sum(axis=0), w.T @ w])
            total[d] = total[d] + part if d in total else part
    for d, t in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([d] * t.size, pa.int64()), pa.array(np.arange(t.size)), pa.array(t.ravel())], ["dim", "cell", "v"])


def _identity_errors(white: DataFrame, model: dict) -> dict[int, float]:
    """The largest absolute entry of the whitened vectors' covariance less the identity, by dimension."""
    rows = white.where(F.size("whitened") > 0).select("dim", "whitened").mapInArrow(_white_products, "dim long, cell long, v double")
    summed = rows.groupBy("dim", "cell").agg(F.sum("v").alias("v")).toPandas().sort_values(["dim", "cell"])
    out = {}
    for dim, part in summed.groupby("dim"):
        n, k = model[int(dim)][0], model[int(dim)][5].shape[1]
        sums = part["v"].to_numpy().reshape(k + 1, k) / n
        out[int(dim)] = float(np.abs(sums[1:] - np.outer(sums[0], sums[0]) - np.eye(k)).max())
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: float = 64.0, offset: int = 1_000_000,
           components: int = 32, max_cells: int = MAX_CELLS) -> DataFrame:
    """``(<id>, component, n, deviation, whitened, explained, identity_error)``, a row for each vector and component.

    An entry c becomes x = floor(scale c) + offset.  Rows whose vector is
    null or holds a null, NaN or infinite entry, or one with
    ``abs(scale c)`` of 2 ** 60 or more, are dropped; all others, repeated
    rows and null ids included, are fitted and returned.  Vectors of
    different lengths are spaces of their own, with their own n, sums and
    components; more than ``max_cells`` cells of covariance in all raise a
    ValueError.  There are as many components as eigenvalues above rounding
    (d eps times the largest), ``components`` at most: none, and so no rows,
    for equal vectors, a single one, or empty ones.  ``deviation``, the sum
    of (n x - S) squared, is exact, null from 2 ** 63 on.  ``identity_error``
    is measured on the whitened vectors.  Other columns are not read; an
    empty table gives no rows."""
    spark = vectors.sparkSession
    c = F.col(vector).cast("array<double>")
    good = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * F.lit(float(scale))) < F.lit(MOST)))
    rows = vectors.select(F.col(id_col).alias("id"), c.alias("vector")).where(F.col("vector").isNotNull() & good)
    with batch_limits(spark, 10_000, 8 << 20):
        sums = _collect(rows.mapInArrow(_sums(scale, offset), _SUMS))
        if sum(d * d for d in sums) > max_cells:
            raise ValueError(f"vectors of {len(sums)} lengths up to {max(sums)} need more than {max_cells} cells of covariance")
        centre = {d: np.array([(2 * s + n) // (2 * n) for s in total] if d else [], np.int64) for d, (_, total, n) in sums.items()}
        sent = spark.sparkContext.broadcast(centre)
        products = _collect(rows.mapInArrow(_products(scale, offset, sent), _SUMS))
        model, explained = {}, []
        for d, (_, total, n) in sums.items():
            rest = [s - n * int(m) for s, m in zip(total, centre[d])]
            v = covariance(n, rest, *products[d][:2]) if d else np.zeros((0, 0))
            values, axes = symmetric_eigen.leading(v, components)
            real = int((values > d * symmetric_eigen.EPS * values.max(initial=0)).sum())
            values, axes = values[:real], axes[:, :real]
            model[d] = n, centre[d], np.array(rest, np.int64), rest, np.array([r / n for r in rest]), axes / np.sqrt(values)
            trace = float(np.trace(v))
            explained += [(d, n, i + 1, float(e) / trace) for i, e in enumerate(values)]
        sent.destroy()
        known = spark.sparkContext.broadcast(model)
        kind = rows.schema["id"].dataType.simpleString()
        white, _ = save(rows.mapInArrow(_project(scale, offset, known), f"id {kind}, dim long, deviation long, whitened array<double>"), "whitened")
        errors = _identity_errors(white, model)
    per = spark.createDataFrame([(*x, errors[x[0]]) for x in explained], "d long, n long, component int, explained double, identity_error double")
    each = white.select("id", "dim", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.join(F.broadcast(per), (F.col("d") == F.col("dim")) & (F.col("component") == F.col("at") + 1)).select(
        F.col("id").alias(id_col), "component", "n", "deviation", "whitened", "explained", "identity_error")
