"""Array<double> column arithmetic with higher-order functions (JVM-side, no Python UDFs)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import hash01


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def vsum(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, t: acc + t)


def sq_dist(a, b) -> Column:
    return vsum(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))


def dist(a, b) -> Column:
    return F.sqrt(sq_dist(a, b))


def norm(a) -> Column:
    return F.sqrt(vsum(F.transform(_c(a), lambda x: x * x)))


def vadd(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def vsub(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def vscale(a, s) -> Column:
    s = F.lit(s) if isinstance(s, (int, float)) else _c(s)
    return F.transform(_c(a), lambda x: x * s)


def lerp_n(a, b, u, d: int) -> Column:
    """a + u * (b - a) for a known dimension as element arithmetic (whole-stage codegen)."""
    a, b = _c(a), _c(b)
    u = F.lit(u) if isinstance(u, (int, float)) else _c(u)
    return F.array(*[a[i] + u * (b[i] - a[i]) for i in range(d)])


def floor_div_n(a, step: float, d: int) -> Column:
    """Grid cell of a point: floor(a_i / step) per dimension, as element arithmetic."""
    a = _c(a)
    return F.array(*[F.floor(a[i] / F.lit(float(step))) for i in range(d)])


def offsets_n(cell, offsets, d: int) -> Column:
    """Array of the cells ``cell + o`` for each literal offset ``o`` (explode it to probe).

    The offsets stay one constant-folded literal array shifted by a lambda: measured faster than
    building the nested array from element arithmetic (a large generator expression)."""
    off = F.array(*[F.array(*[F.lit(int(v)).cast("bigint") for v in o]) for o in offsets])
    return F.transform(off, lambda o: F.zip_with(_c(cell), o, lambda c, e: c + e))


def zeros_like(a) -> Column:
    return F.transform(_c(a), lambda x: F.lit(0.0))


def bounds_wrap(x, v, lb: Sequence[float], ub: Sequence[float], key, seed: str = "border") -> tuple[Column, Column]:
    """V1: per dimension, x > ub -> lb and x < lb -> ub (strict tests); the companion rate of a
    wrapped dimension becomes (ub - lb) * draw, the draw being hash01(seed, key, dim). Nothing is
    mutated in place (the reference may scale a shared vector through a slice view)."""
    lb_a = F.array(*[F.lit(float(b)) for b in lb])
    ub_a = F.array(*[F.lit(float(b)) for b in ub])
    idx = F.sequence(F.lit(0), F.size(_c(x)) - 1)
    key_c = _c(key)
    new_x = F.transform(idx, lambda i: F.when(_c(x)[i] > ub_a[i], lb_a[i])
                        .when(_c(x)[i] < lb_a[i], ub_a[i]).otherwise(_c(x)[i]))
    new_v = F.transform(idx, lambda i: F.when((_c(x)[i] > ub_a[i]) | (_c(x)[i] < lb_a[i]),
                                              (ub_a[i] - lb_a[i]) * hash01(seed, key_c, i))
                        .otherwise(_c(v)[i]))
    return new_x, new_v


def affine_rotate(x, offset, rate: float, matrix, shift: bool = True, rotate: bool = True) -> Column:
    """V2: y = (x - o) * rate (shift flag), then M . y (rotate flag). ``offset`` is an array column,
    ``matrix`` an array<array<double>> column (row-major), both typically from a one-row broadcast."""
    y = vsub(x, offset) if shift else _c(x)
    y = vscale(y, rate)
    if not rotate:
        return y
    return F.transform(_c(matrix), lambda row: vsum(F.zip_with(row, y, lambda m, t: m * t)))


def dist_n(a, b, d: int) -> Column:
    """Euclidean distance for a known dimension ``d`` as plain element arithmetic: unlike the
    lambda forms above, this stays inside whole-stage code generation (hot join filters)."""
    a, b = _c(a), _c(b)
    acc = None
    for i in range(d):
        t = (a[i] - b[i]) * (a[i] - b[i])
        acc = t if acc is None else acc + t
    return F.sqrt(F.lit(0.0) + acc) if acc is not None else F.lit(0.0)


def array_dim(df, col: str) -> int:
    """Dimension of a fixed-size array column (one row read)."""
    row = df.select(F.size(col).alias("d")).where(F.col("d") > 0).first()
    return int(row["d"]) if row else 0

