"""Table-level vector operators (V2) for large dimensions.

A d x d matrix-vector product per row is d^2 multiply-adds: as array lambdas Spark runs it
interpreted, and as literal arithmetic the generated code exceeds what the JIT compiler accepts at
d = 64. Rows are therefore transformed in Arrow batches with numpy; Spark partitions the rows, and
the matrix and offset travel as one broadcast whose size (d^2 + d doubles) is checked.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BUDGET = 1 << 23  # doubles


def _rotate_batches(bc, x_col: str, out_col: str, keep: list[str], shift: bool, rotate: bool):
    import numpy as np

    def run(batches):
        offset, rate, matrix = bc.value
        for pdf in batches:
            if pdf.empty:
                continue
            X = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[x_col]])
            Y = ((X - offset) if shift else X) * rate
            if rotate:
                Y = Y @ matrix.T
            out = pdf[keep].copy()
            out[out_col] = list(Y)
            yield out
    return run


def affine_rotate_rows(df: DataFrame, x_col: str, offset: Sequence[float], rate: float,
                       matrix: Sequence[Sequence[float]], out_col: str = "y", keep: Sequence[str] = (),
                       shift: bool = True, rotate: bool = True) -> DataFrame:
    """(keep..., out_col) with out = M . ((x - offset) * rate) for every row (flags as in V2)."""
    import numpy as np

    from ..session import ship_package

    o = np.asarray(offset, dtype=np.float64)
    m = np.asarray(matrix, dtype=np.float64).reshape(len(matrix), len(offset)) if rotate else np.zeros((0, 0))
    if o.size + m.size > BROADCAST_BUDGET:
        raise ValueError(f"matrix of {m.shape} exceeds the broadcast budget of {BROADCAST_BUDGET} doubles")
    spark = df.sparkSession
    ship_package(spark)
    bc = spark.sparkContext.broadcast((o, float(rate), m))
    keep = list(keep)
    fields = [df.schema[c].simpleString() for c in keep]
    schema = ", ".join(fields + [f"{out_col} array<double>"])
    return df.select(*keep, x_col).mapInPandas(_rotate_batches(bc, x_col, out_col, keep, shift, rotate), schema)
