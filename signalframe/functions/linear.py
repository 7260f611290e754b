"""Constant linear maps applied to array columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Up to this many non-zero weights the map becomes plain arithmetic in generated
# code; beyond it one numpy product per Arrow batch is faster and keeps plans small.
UNROLL_LIMIT = 64


def apply_matrix(x: Column, matrix: np.ndarray) -> Column:
    """``matrix @ x`` for each row; a wrong length gives an error.

    An output depends on the elements with a weight other than 0 and on no other: it
    is null if and only if one of those is null, NaN or infinite through those only.
    Sparse small maps become plain arithmetic inside generated code; dense ones
    run as one numpy product per Arrow batch, with the same results.
    """
    matrix = np.where(np.abs(matrix) < 1e-15, 0.0, np.asarray(matrix, dtype=float))
    n = matrix.shape[1]
    fits = F.size(x) == n
    wrong = F.raise_error(F.lit(f"array length must be {n}")).cast("array<double>")
    if np.count_nonzero(matrix) <= UNROLL_LIMIT:
        rows = []
        for row in matrix:
            terms = [F.get(x, F.lit(int(i))) * float(row[i]) for i in np.flatnonzero(row)]
            rows.append(sum(terms[1:], terms[0]) if terms else F.lit(0.0))
        return F.when(fits, F.array(*rows)).otherwise(wrong)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def product(col: pa.Array) -> pa.Array:
        flat = col.flatten().cast(pa.float64())
        values = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, n)
        out = values @ matrix.T
        for i in np.flatnonzero(~np.isfinite(values).all(axis=1)):
            out[i] = np.where(matrix != 0, values[i] * np.where(matrix != 0, matrix, 1.0), 0.0).sum(axis=1)
        mask = None
        if flat.null_count:
            missing = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, n)
            mask = (missing @ (matrix != 0).T).ravel()
        offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * len(matrix))
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel(), mask=mask))

    return product(F.when(fits, x).otherwise(wrong))
