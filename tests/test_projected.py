"""Approximate neighbours by random projections: recall against brute force, bounded work, copies and small tables."""

import numpy as np
import pytest

from conftest import SF_MID
from emberline import fixtures as fx
from emberline.operators import oversample as O
from emberline.operators import projected as PJ
from emberline.schema import READING_FEATURES


def _brute(ids, X, k):
    out = {}
    for lo in range(0, len(X), 500):
        d = ((X[lo:lo + 500, None, :] - X[None]) ** 2).sum(axis=2)
        d[np.arange(len(d)), lo + np.arange(len(d))] = np.inf
        for i, row in enumerate(np.argpartition(d, k, axis=1)[:, :k]):
            out[ids[lo + i]] = np.sort(d[i, row])
    return out


def _frame(spark, X):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, x array<double>")


def _recall(nn, want):
    """Share of the k nearest distances that were found (rows at equal distance count alike)."""
    got = {}
    for r in nn.collect():
        got.setdefault(r["id"], []).append(r["dist"] ** 2)
    return np.mean([(np.sort(got.get(i, [])) <= d.max() * (1 + 1e-9) + 1e-12).sum() / len(d) for i, d in want.items()])


def test_recall_on_scaled_readings(spark):
    r = fx.readings(spark, SF_MID).where("label = 0").toPandas()
    X = r[READING_FEATURES].to_numpy(float)
    X = X / X.std(axis=0)
    nn = PJ.knn_projected(_frame(spark, X), "id", "x", 5)
    assert nn.groupBy("id").count().where("count <> 5").count() == 0 and nn.select("id").distinct().count() == len(X)
    assert 2 * PJ.WIDTH * PJ.TABLES * len(X) < 0.1 * len(X) ** 2  # ordered pairs compared
    assert _recall(nn, _brute(list(range(len(X))), X, 5)) >= 0.9


def test_distances_are_exact_and_ranges_lose_little(spark):
    X = np.random.default_rng(1).normal(size=(3000, 4))
    df = _frame(spark, X)
    want = _brute(list(range(len(X))), X, 5)
    whole, cut = (PJ.knn_projected(df, "id", "x", 5, rows_per_range=n).cache() for n in (10 ** 9, 1000))
    for r in whole.where("id % 50 = 0").collect():
        assert abs(r["dist"] - np.linalg.norm(X[r["id"]] - X[r["nn_id"]])) < 1e-12
    assert _recall(whole, want) >= 0.9 and _recall(cut, want) >= _recall(whole, want) - 0.02


@pytest.mark.parametrize("n", [0, 1, 2, 40])
def test_small_tables_equal_the_exact_join(spark, n):
    """Tables inside one window are compared whole; a third of the rows are copies of one vector."""
    X = np.random.default_rng(n).normal(size=(n, 3))
    X[::3] = 1.0
    df = _frame(spark, X)
    got = PJ.knn_projected(df, "id", "x", 5, width=50).select("id", "rank", "nn_id").collect()
    assert sorted(got) == sorted(O.knn(df, "id", "x", 5).select("id", "rank", "nn_id").collect() if n else [])


def test_smote_with_approximate_neighbours(spark):
    v = fx.vectors(spark, SF_MID)
    got = O.smote(v, "vec_id", "x", "label", 5, 140, neighbours=PJ.knn_projected)
    want = O.smote(v, "vec_id", "x", "label", 5, 140)
    assert {(r["label"], r["count"]) for r in got.groupBy("label").count().collect()} == \
        {(r["label"], r["count"]) for r in want.groupBy("label").count().collect()}
