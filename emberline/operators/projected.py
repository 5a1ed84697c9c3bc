"""Approximate nearest neighbours by random projections (D5, D6), after published LSH orders on sorted keys.

Each of ``tables`` tables projects the vectors on ``AXES`` random directions, shifts and quantises the projections and
interleaves their bits into one sort key, so vectors close to one another tend to be close in the order. Range partitioning
sorts a table by that key, and each vector is compared with the ``width`` vectors before and after it: what a probe of
neighbouring buckets would find, but with work bounded by n x width x tables pairs however the vectors crowd, and no bucket
that a hot spot could fill. The k best of each table go on (at most k rows a vector and table); the same pair found by
several tables counts once.

Approximate in two ways only: a neighbour that is far away in the order of every table is missed, and pairs that lie across
the border of two ranges are not compared in that table. Distances are exact. Few dimensions (readings) give a recall near 1;
isotropic vectors of 64 dimensions have no near order to find, and want ``oversample.knn``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .oversample import distinct_vectors, ranked_rows

AXES, BITS = 4, 15
TABLES, WIDTH = 8, 24
ROWS_PER_RANGE = 50_000


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _keys(at: np.ndarray) -> np.ndarray:
    """(vectors, AXES) in 0..2^BITS - 1 -> bits interleaved, the highest first."""
    out = np.zeros(len(at), np.int64)
    for bit in reversed(range(BITS)):
        for axis in range(AXES):
            out = (out << 1) | ((at[:, axis] >> bit) & 1)
    return out


def _nearest(X: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of X the k nearest among the ``width`` rows before and after: (places, distances); infinite where none."""
    m = len(X)
    d = np.full((m, 2 * width), np.inf)
    for j in range(1, min(width, m - 1) + 1):
        apart = np.sqrt(((X[j:] - X[:-j]) ** 2).sum(axis=1))
        d[:-j, width + j - 1] = apart
        d[j:, width - j] = apart
    best = np.argsort(d, axis=1, kind="stable")[:, :k]
    steps = np.where(best < width, best - width, best - width + 1)
    return np.arange(m)[:, None] + steps, np.take_along_axis(d, best, axis=1)


def _in_order(width: int, k: int):
    """mapInArrow body over rows (table, z, vid, x) in order: the k nearest of each in the window around it. Holds a batch and
    twice the window."""
    def found(vids: np.ndarray, X: np.ndarray, a: int, b: int) -> pa.RecordBatch:
        at, d = _nearest(X, width, k)
        at, d = at[a:b], d[a:b]
        rows, cols = np.nonzero(np.isfinite(d))
        return pa.RecordBatch.from_arrays([pa.array(vids[a:b][rows]), pa.array(vids[at[rows, cols]]), pa.array(d[rows, cols])],
                                          names=["vid", "uid", "dist"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, vids, X, done = None, np.zeros(0, np.int64), None, 0  # rows up to ``done`` are finished, kept as predecessors
        for batch in batches:
            tables = batch.column("table").to_numpy()
            cuts = [0, *(np.flatnonzero(tables[1:] != tables[:-1]) + 1), len(tables)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if X is not None and tables[lo] != table:
                    yield found(vids, X, done, len(vids))
                    vids, X, done = vids[:0], None, 0
                part = batch.slice(lo, hi - lo)
                table, more = tables[lo], _matrix(part.column("x"))
                vids = np.concatenate([vids, part.column("vid").to_numpy()])
                X = more if X is None else np.concatenate([X, more])
                if (ready := len(vids) - width) > done:
                    yield found(vids, X, done, ready)
                    keep = max(0, ready - width)
                    vids, X, done = vids[keep:], X[keep:], ready - keep
        if X is not None:
            yield found(vids, X, done, len(vids))
    return run


def knn_projected(df: DataFrame, id_col: str, vec_col: str, k: int = 5, tables: int = TABLES, width: int = WIDTH, seed: int = 17,
                  rows_per_range: int = ROWS_PER_RANGE, materialize: bool = True) -> DataFrame:
    """(id, rank, nn_id, dist): k near other rows of every row, most of them the nearest; ties by id. Rows that share a
    vector are one vector here, so they always find each other. Null vectors take no part."""
    from ..session import ship_package, stored

    spark = df.sparkSession
    ship_package(spark)
    pts = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("x")).where(F.col("x").isNotNull())
    if materialize:
        pts = stored(pts, "projected-rows")
    vx, rows, top = distinct_vectors(pts, k + 1)
    vx = stored(vx.select(F.col("vid").cast("bigint").alias("vid"), "x"), "projected-vectors")
    size = vx.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("dim")).first()
    rng = np.random.default_rng(seed)
    axes = rng.normal(size=(max(1, size["dim"] or 1), tables * AXES))  # a few numbers a dimension
    shift = rng.random(tables * AXES)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = np.full(tables * AXES, np.inf), np.full(tables * AXES, -np.inf)
        for batch in batches:
            if len(batch):
                p = _matrix(batch.column("x")) @ axes
                lo, hi = np.minimum(lo, p.min(axis=0)), np.maximum(hi, p.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(lo))), pa.array(lo), pa.array(hi)], names=["axis", "lo", "hi"])

    ends = vx.select("x").mapInArrow(spans, "axis bigint, lo double, hi double").groupBy("axis").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("axis").collect()  # tables x AXES rows
    low = np.array([r["lo"] for r in ends] or [0.0] * len(shift))
    span = np.maximum(np.array([r["hi"] for r in ends] or [1.0] * len(shift)) - low, 1e-300)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            p = _matrix(batch.column("x")) @ axes
            at = np.clip(((p - low) / span + shift) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            z = np.stack([_keys(at[:, t * AXES:(t + 1) * AXES]) for t in range(tables)], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * tables, pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vid"), batch.column("x"), lists], names=["vid", "x", "z"])

    placed = vx.mapInArrow(keyed, "vid bigint, x array<double>, z array<bigint>").select("vid", "x", F.posexplode("z").alias("table", "z"))
    ranges = max(1, -(-size["n"] * tables // rows_per_range))
    ordered = placed.select("table", "z", "vid", "x").repartitionByRange(ranges, "table", "z", "vid").sortWithinPartitions("table", "z", "vid")
    near = ordered.mapInArrow(_in_order(width, k), "vid bigint, uid bigint, dist double").dropDuplicates(["vid", "uid"])
    return ranked_rows(near, rows, top, k)
