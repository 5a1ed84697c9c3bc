"""Centroid clustering over a VA-file.

Vectors become integers and are written in blocks: one file of whole vectors and one of approximations, which hold for
every dimension the number of the cell the component lies in, in ``BITS`` bits. Inner cell bounds are quantiles of a
sample (``SAMPLE`` vectors with the smallest key hashes, drawn by a distributed top-k), the outer ones the true least and
largest components, so every vector's cell is an interval around it. Cells change speed only, never results.

Each round is one Spark job over the blocks. A task has, for every dimension, cell and centroid, the least and the largest
squared difference; summed up over the dimensions these give an interval for the distance to every centroid. Where one
interval lies below all others the cluster is known; only where intervals overlap is the whole vector fetched, and
compared with the overlapping centroids only. Centroids move by differences: a task fetches the vectors that have changed
their cluster, adds them to the new and takes them from the old sums, and Spark adds up k x d numbers a task. All
arithmetic is on integers, so results don't depend on blocks, partitions or order.

Files lie in the shared folder under names of their own; a job's table names those of its successful tasks, so a lost
executor's work is done again from there. Nothing but k x d sums, the sample and the bounds passes through the driver.

Defined results: vectors of another length or with a null or non-finite component are left out; vectors that repeat,
identifiers too, are clustered each for itself; a null identifier counts as hash after all others; of equal hashes the
smaller vector starts first; fewer vectors than centroids make as many centroids; a table without vectors gives none.
A component beyond 2^27 in its integer form, whose squared distances would not fit a long, is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import pick, query, written
from emberline.llm.elias_fano import mapped, save
from emberline.session import scratch_path

K, DIMS, SCALE, ROUNDS, BITS = 40, 64, 256, 5, 4
SAMPLE = 4096  # vectors from which cell bounds are taken; the first centroids are the first of them
BLOCK = 8192  # vectors of a file, at most
CHUNK = 1024  # vectors whose intervals are computed at a time
LARGEST = 1 << 27
FAR = np.iinfo(np.int64).max


def usable(vector: Column, dims: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def integers(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).reshape(-1, dims)
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError("a component is too large for exact distances")
    return x.astype(np.int64)


# ---------------------------------------------------------------- approximations

def pack(cells: np.ndarray, bits: int) -> np.ndarray:
    """Cell numbers of each row side by side, 8 / bits in a byte."""
    per = 8 // bits
    wide = np.zeros((len(cells), -(-cells.shape[1] // per) * per), np.uint8)
    wide[:, :cells.shape[1]] = cells
    return np.bitwise_or.reduce(wide.reshape(len(cells), -1, per) << (np.arange(per, dtype=np.uint8) * bits), axis=2).astype(np.uint8)


def unpack(packed: np.ndarray, bits: int, dims: int) -> np.ndarray:
    per = 8 // bits
    return (packed[:, :, None] >> (np.arange(per, dtype=np.uint8) * bits) & ((1 << bits) - 1)).reshape(len(packed), -1)[:, :dims]


def cells_of(x: np.ndarray, inner: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(inner[d], x[:, d], side="right") for d in range(x.shape[1])], axis=1).astype(np.uint8)


def tables(centroids: np.ndarray, inner: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[dimension, cell, centroid] -> least and largest squared difference between the centroid and a number of the cell."""
    begin = np.concatenate([lo[:, None], inner], axis=1)[:, :, None]
    end = np.concatenate([inner - 1, hi[:, None]], axis=1)[:, :, None]
    v = centroids.T[:, None, :]
    least = np.where(v < begin, begin - v, np.where(v > end, v - end, 0)) ** 2
    return least, np.maximum(np.abs(v - begin), np.abs(v - end)) ** 2


def nearest(approx: np.ndarray, fetch, centroids: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each vector's nearest centroid (ties: the smaller) and whether the whole vector was fetched for it."""
    out, fetched = np.zeros(len(approx), np.int32), np.zeros(len(approx), bool)
    bits = (least.shape[1] - 1).bit_length()
    for a in range(0, len(approx), CHUNK):
        cells = unpack(approx[a:a + CHUNK], bits, least.shape[0])
        low = np.zeros((len(cells), len(centroids)), np.int64)
        high = np.zeros_like(low)
        for d in range(least.shape[0]):
            low += least[d][cells[:, d]]
            high += most[d][cells[:, d]]
        near = low <= high.min(axis=1, keepdims=True)
        out[a:a + CHUNK] = near.argmax(axis=1)
        open_ = np.flatnonzero(near.sum(axis=1) > 1)
        if len(open_):
            row, c = np.nonzero(near[open_])
            x = fetch(a + open_)
            exact = np.full((len(open_), len(centroids)), FAR)
            for i in range(0, len(row), 4 * CHUNK):
                r, k = row[i:i + 4 * CHUNK], c[i:i + 4 * CHUNK]
                exact[r, k] = ((x[r] - centroids[k]) ** 2).sum(axis=1)
            out[a + open_] = exact.argmin(axis=1)
            fetched[a + open_] = True
    return out, fetched


# ---------------------------------------------------------------- blocks

def write_blocks(rows: DataFrame, folder: str, dims: int, scale: int) -> DataFrame:
    """Files of whole vectors: (path, n, lo, hi) a block, with the least and largest component of each dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            x = np.concatenate([integers(b.column("vector"), dims, scale) for b in held])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.select(["key"]).schema) as w:
                w.write_table(table.select(["key"]))
            path = save(folder, "vectors", {"full": x.astype(np.int32), "keys": np.frombuffer(sink.getvalue(), np.uint8)})
            return pa.RecordBatch.from_pydict({"path": [path], "n": pa.array([len(x)], pa.int64()), "lo": [x.min(axis=0).tolist()], "hi": [x.max(axis=0).tolist()]})

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                if held and sum(b.num_rows for b in held) + piece.num_rows > BLOCK:
                    yield out()
                    held = []
                held.append(piece)
        if held:
            yield out()

    return written(rows.mapInArrow(run, "path string, n long, lo array<long>, hi array<long>"), "va-blocks")


def dealt(blocks: DataFrame, n: int) -> DataFrame:
    """The block table over enough tasks: it holds names only, so Spark would read it in one."""
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    return blocks.repartition(max(1, min(n, max(4 * cores, n // 64))))


def approximate(blocks: DataFrame, n: int, folder: str, inner: np.ndarray, bits: int) -> DataFrame:
    """Adds every block's file of approximations: (path, approx, state), no state yet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path").to_pylist()
            files = [save(folder, "approx", {"cells": pack(cells_of(mapped(p)["full"].astype(np.int64), inner), bits)}) for p in paths]
            yield pa.RecordBatch.from_pydict({"path": paths, "approx": files, "state": pa.array([None] * len(paths), pa.string())})

    return written(dealt(blocks.select("path"), n).mapInArrow(run, "path string, approx string, state string"), "va-approx")


def assign(blocks: DataFrame, n: int, folder: str, centroids: np.ndarray, least: np.ndarray, most: np.ndarray) -> DataFrame:
    """One round: (path, approx, state, fetched, sums) with new states; a task's last row has what its moved vectors add to
    each cluster's count and sums, row by row of [count, sum of every dimension]."""
    shared = blocks.sparkSession.sparkContext.broadcast((centroids, least, most))  # k x d and d x cells x k numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, least, most = shared.value
        change = np.zeros((len(centroids), 1 + centroids.shape[1]), np.int64)
        any_ = False
        for batch in batches:
            states, counts = [], []
            for path, approx, state in zip(*(batch.column(c).to_pylist() for c in ("path", "approx", "state"))):
                full = mapped(path)["full"]
                now, fetched = nearest(mapped(approx)["cells"], lambda at: full[at].astype(np.int64), centroids, least, most)
                was = mapped(state)["cluster"].astype(np.int32) if state else np.full(len(now), -1, np.int32)
                moved = np.flatnonzero(now != was)
                x = np.concatenate([np.ones((len(moved), 1), np.int64), full[moved]], axis=1)
                np.add.at(change, now[moved], x)
                old = was[moved] >= 0
                np.subtract.at(change, was[moved][old], x[old])
                states.append(save(folder, "state", {"cluster": now}))
                counts.append(int(fetched.sum()))
                any_ = True
            empty = pa.array([[]] * len(states), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("approx"), pa.array(states, pa.string()), pa.array(counts, pa.int64()), empty],
                                             names=["path", "approx", "state", "fetched", "sums"])
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string())] * 3 + [pa.array([0], pa.int64()), pa.array([change.ravel()], pa.list_(pa.int64()))],
                                             names=["path", "approx", "state", "fetched", "sums"])

    return written(dealt(blocks.select("path", "approx", "state"), n).mapInArrow(
        run, "path string, approx string, state string, fetched long, sums array<long>"), "va-round")


def last_assignment(blocks: DataFrame, n: int, centroids: np.ndarray, least: np.ndarray, most: np.ndarray, kind: str) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast((centroids, least, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, least, most = shared.value
        for batch in batches:
            for path, approx in zip(batch.column("path").to_pylist(), batch.column("approx").to_pylist()):
                arrays = mapped(path)
                full = arrays["full"]
                now, fetched = nearest(mapped(approx)["cells"], lambda at: full[at].astype(np.int64), centroids, least, most)
                gap = ((full - centroids[now]) ** 2).sum(axis=1)
                keys = pa.ipc.open_stream(pa.py_buffer(arrays["keys"].tobytes())).read_all().combine_chunks().column("key")
                table = pa.table({"key": keys, "cluster": now, "distance": gap, "fetched": fetched})
                yield from table.to_batches()

    return dealt(blocks.select("path", "approx"), n).mapInArrow(run, f"key {kind}, cluster int, distance long, fetched boolean")


# ---------------------------------------------------------------- the operator

def first_by_hash(rows: DataFrame, n: int, salt: str, k: int) -> list:
    """At most max(SAMPLE, k) vectors in the order of their key hashes, the k first of all n among them. Hashes above a bound that
    some four samples are expected to keep are left out before the sort, so that it gathers few rows however many tasks there are."""
    size, share = max(SAMPLE, k), 4 * max(SAMPLE, k) / max(n, 1)
    mark = F.sha2(F.concat(F.lit(salt), F.col("key").cast("string")), 256)
    while True:
        some = rows.select(mark.alias("mark"), "vector")
        if share < 1:
            some = some.where(F.col("mark") < f"{int(share * 16 ** 12):012x}")
        drawn = written(some.orderBy(F.col("mark").asc_nulls_last(), "vector").limit(size), "va-sample").orderBy(F.col("mark").asc_nulls_last(), "vector").collect()
        if len(drawn) >= k or share >= 1:
            return [r["vector"] for r in drawn]
        share *= 16


def cluster(df: DataFrame, key: str, vector: str, k: int = K, dims: int = DIMS, scale: int = SCALE, rounds: int = ROUNDS, bits: int = BITS,
            salt: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance, fetched) of every usable vector, as a written table, and the final centroids. A vector x
    stands for the integers floor(scale * x); the first centroids are the k vectors with the smallest sha256 of the salt
    and the key. ``bits`` (1, 2, 4 or 8) is the width of a cell number; ``fetched`` tells for which vectors the last
    assignment's intervals overlapped."""
    spark = df.sparkSession
    rows = pick(df, key=key, vector=vector).where(usable(F.col("vector"), dims))
    kind = rows.schema["key"].dataType.simpleString()
    folder = scratch_path(spark, "va-file")
    blocks = write_blocks(rows, folder, dims, scale)
    n = blocks.count()
    drawn = first_by_hash(rows, blocks.agg(F.sum("n")).first()[0] or 0, salt, k)
    if not drawn:
        return spark.createDataFrame([], f"key {kind}, cluster int, distance long, fetched boolean").withColumnRenamed("key", key), np.zeros((0, dims), np.int64)
    drawn = integers(pa.array(drawn, pa.list_(pa.float64())), dims, scale)
    centroids = drawn[:k]
    inner = np.quantile(drawn, np.arange(1, 1 << bits) / (1 << bits), axis=0, method="higher").T.astype(np.int64)
    sides = blocks.select(F.posexplode(F.arrays_zip("lo", "hi"))).groupBy("pos").agg(F.min("col.lo").alias("lo"), F.max("col.hi").alias("hi")).orderBy("pos").collect()
    lo, hi = np.array([r["lo"] for r in sides]), np.array([r["hi"] for r in sides])
    inner = np.clip(inner, lo[:, None], hi[:, None] + 1)
    blocks = approximate(blocks, n, folder, inner, bits)
    total = np.zeros((len(centroids), 1 + dims), np.int64)
    for _ in range(rounds):
        done = assign(blocks, n, folder, centroids, *tables(centroids, inner, lo, hi))
        for r in done.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s")).collect():
            total.flat[r["pos"]] += r["s"]
        some = total[:, 0] > 0
        centroids = centroids.copy()
        centroids[some] = total[some, 1:] // total[some, :1]
        blocks = done.where(F.col("path").isNotNull())
    found = written(last_assignment(blocks, n, centroids, *tables(centroids, inner, lo, hi), kind), "va-clusters")
    return found.withColumnRenamed("key", key), centroids


def digest_of(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def _oracle(k: int = K, dims: int = DIMS, rounds: int = ROUNDS) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT id, arg_min(c, (d, c)) AS c, min(d) AS d FROM
  (SELECT x.id, c.c, list_sum([(x.v[i] - c.v[i]) * (x.v[i] - c.v[i]) FOR i IN range(1, {dims + 1})]) AS d FROM x, c{r} c) GROUP BY id)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN
  (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM
    (SELECT a.c, i, CAST(sum(x.v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r} a JOIN x USING (id), range(1, {dims + 1}) t(i) GROUP BY a.c, i) GROUP BY c) m USING (c))""")
    return f"""
WITH x AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, [CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len([1 FOR e IN embedding IF e IS NOT NULL AND isfinite(e)]) = {dims}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), v) - 1 AS c, v FROM x
  ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), v LIMIT {k}),
{(',' + chr(10)).join(steps)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN x USING (id) JOIN c{rounds} f ON f.c = a.c
"""


@query("op12_va_clusters", _oracle())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"), "vec_id", "embedding")
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    about = spark.createDataFrame([(c, s, sum(inertia.values()), digest_of(centroids[c])) for c, s in inertia.items()],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
