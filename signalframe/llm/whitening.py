"""Whitening of embeddings: blockwise QR of centred rows, then a bidiagonal qd solver.

The distinct integer vectors are the fit list. Every task reduces its centred rows
block by block to one triangular factor, the factors meet in groups until one is
left, and that small matrix gives singular values and directions
(``bidiagonal.right_singular``): no covariance is formed, so small values keep
their digits. Only sums and d x d factors leave the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bidiagonal import right_singular
from .common import keep, list_matrix, whole_numbers

#: Rows that a task reduces at a time.
BLOCK = 4096
#: Triangular factors that one task joins.
FAN_IN = 64


def _triangle(blocks: np.ndarray) -> np.ndarray:
    """Square triangular factor of the rows."""
    d = blocks.shape[1]
    r = np.linalg.qr(blocks, mode="r")
    return r if len(r) == d else np.vstack([r, np.zeros((d - len(r), d))])


def _centre(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Centring subtracts the whole part of the mean exactly first."""
    whole = np.round(mean).astype(np.int64)
    return (x - whole).astype(float) - (mean - whole)


def _partial_sums(d):
    def run(batches):
        # Sums of whole numbers, so no order of partial sums changes them.
        for batch in batches:
            x = list_matrix(batch.column(0), d)
            for at in range(0, d, 1024):
                part = x[:, at : at + 1024].sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), pa.array(part)], ["i", "s"])

    return run


def _reduce_rows(d, mean):
    def run(batches):
        r = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows = _centre(list_matrix(batch.column(1).slice(at, BLOCK), d), mean)
                r = _triangle(rows if r is None else np.vstack([r, rows]))
        if r is not None:
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(0, 1), pa.array([r.tobytes()])], ["part", "r"])

    return run


def _join_factors(d):
    def run(key, table):
        r = _triangle(np.vstack([np.frombuffer(b, float).reshape(d, d) for b in table.column("r").to_pylist()]))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "r": pa.array([r.tobytes()])})

    return run


def _factor(fit: DataFrame, d: int, mean: np.ndarray) -> np.ndarray:
    """Triangular factor of all centred rows of ``fit``."""
    factors = fit.select(F.spark_partition_id().alias("part"), "x").mapInArrow(_reduce_rows(d, mean), "part int, r binary")
    factors = keep(factors, "factors")
    parts = factors.agg(F.max("part")).collect()[0][0] + 1
    while parts > 1:
        parts = -(-parts // FAN_IN)
        factors = factors.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("part").applyInArrow(_join_factors(d), "part int, r binary")
    return np.frombuffer(factors.collect()[0]["r"], float).reshape(d, d)


def _project(d, mean, directions):
    def run(batches):
        for batch in batches:
            w = _centre(list_matrix(batch.column(0), d), mean) @ directions
            sums = np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["i", "s"])

    return run


def _whiten(d, n, sums, mean, directions, values, total, error, carried):
    k = directions.shape[1]
    squares = sum(int(s) * int(s) for s in sums)
    fits = np.abs(sums).max(initial=1)

    def run(batches):
        for batch in batches:
            x = list_matrix(batch.column(carried), d)
            w = _centre(x, mean) @ directions
            # sum (n x - S)^2 = n^2 sum x^2 - 2 n sum x S + sum S^2 in whole numbers of any size.
            small = float(np.abs(x).max(initial=1)) * float(fits) * d < 2.0**62
            own = x if small else x.astype(object)
            xx, xs = (own * own).sum(axis=1), own @ (sums if small else np.array([int(s) for s in sums], dtype=object))
            far = [n * n * int(a) - 2 * n * int(b) + squares for a, b in zip(xx, xs)]
            far = pa.array([v if v < 2**63 else None for v in far], pa.int64())
            at = pa.array(np.repeat(np.arange(len(x)), k))
            component = np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))
            constant = lambda v, kind: pa.array(np.full(len(component), v, dtype=kind))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).take(at) for i in range(carried)], pa.array(component), constant(n, np.int64), far.take(at), pa.array(w.ravel()), pa.array((values[component - 1] / total)), constant(error, float)],
                [*batch.schema.names[:carried], "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(vectors: DataFrame, value: str = "embedding", key=("vec_id",), scale: int = 256, components: int = 4) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` per row and component.

    Entries become ``floor(scale * c)``. Mean and covariance (divisor n) are over the
    distinct whole-number vectors, so copies, however many, count once; every row
    gets its coordinates. Components are numbered from 1 by falling variance; the
    largest entry of a direction is positive. A component without variance (below
    rounding) is left out, so n = 1 gives no rows, and so does an empty table.

    Rows whose vector is null or holds a null or non-finite entry are dropped. A
    vector shorter than the longest ends in zeros. A deviation beyond a long is
    null. Other columns, whatever their names, are not read; a null key stays null.
    """
    key = list(key)
    rows = vectors.select(*key, whole_numbers(F.col(value), scale).alias("__x")).filter("__x is not null")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*key).schema)
    schema += ", component int, n long, deviation long, whitened double, explained double, identity_error double"
    d = rows.agg(F.max(F.size("__x"))).collect()[0][0]
    if not d:
        return rows.sparkSession.createDataFrame([], schema)
    whole = F.concat("__x", F.array_repeat(F.lit(0).cast("long"), d - F.size("__x")))
    fit = keep(rows.select(whole.alias("x")).distinct(), "distinct-vectors")
    n = fit.count()
    got = fit.mapInArrow(_partial_sums(d), "i long, s long").groupBy("i").agg(F.sum("s").alias("s")).collect()
    sums = np.zeros(d, dtype=np.int64)
    for r in got:
        sums[r.i] = r.s
    mean = sums / n
    values, v = right_singular(_factor(fit, d, mean), min(components, d))
    values, total = values / n, values.sum() / n
    real = int((values[: v.shape[1]] > values[0] * 1e-14 * d).sum()) if values[0] > 0 else 0
    if real == 0:
        return rows.sparkSession.createDataFrame([], schema)
    v = v[:, :real]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(real)])
    directions = v / np.sqrt(values[:real])
    moments = fit.mapInArrow(_project(d, mean, directions), "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    moments = np.array([r.s for r in sorted(moments, key=lambda r: r.i)]) / n
    cov = moments[real:].reshape(real, real) - np.outer(moments[:real], moments[:real])
    error = float(np.abs(cov - np.eye(real)).max())
    return rows.mapInArrow(_whiten(d, n, sums, mean, directions, values, total, error, len(key)), schema)
