"""Unit cases and invariants of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from emberline import fixtures as fx
from emberline.functions.vectors import bounds_wrap
from emberline.operators import metrics as M
from emberline.operators import neighbours as G
from emberline.operators import oversample as O
from emberline.operators import prepare as P
from emberline.operators import search_stats as H
from emberline.plans import models as E
from emberline.plans.search import levy_sigma


def test_border_case(spark):
    """The reference's only unit case: lb=(10,0), ub=(150,1), pos=(152.1,-1.992), v=(52.002,0.5)."""
    df = spark.createDataFrame([(1, [152.1, -1.992], [52.002, 0.5])], "id long, x array<double>, v array<double>")
    nx, nv = bounds_wrap("x", "v", (10.0, 0.0), (150.0, 1.0), "id")
    # distinct output names: re-using "x" in the same select would hand the rate expression the
    # wrapped position through lateral column aliasing
    row = df.select(nx.alias("nx"), nv.alias("nv")).first()
    assert row["nx"] == [10.0, 1.0]
    assert 0.0 <= row["nv"][0] < 140.0 and 0.0 <= row["nv"][1] < 1.0
    assert row["nv"][0] != 52.002 and row["nv"][1] != 0.5


def test_folds_disjoint_complete_and_partition_stable(spark):
    r = fx.readings(spark, SF_SMALL)
    a = P.kfold_assign(r, "o_orderkey", 5).select("o_orderkey", "fold")
    b = P.kfold_assign(r.repartition(1), "o_orderkey", 5).select("o_orderkey", "fold")
    assert a.count() == r.count() == a.select("o_orderkey").distinct().count()
    assert a.exceptAll(b).count() == 0
    assert set(x["fold"] for x in a.select("fold").distinct().collect()) <= set(range(5))
    counts = P.kfold_train_counts(a)
    total = r.count()
    for row in counts.collect():
        assert row["n_train"] + row["n_valid"] == total
    s1 = P.hash_split(r, "o_orderkey").select("o_orderkey", "split")
    s8 = P.hash_split(r.repartition(8), "o_orderkey").select("o_orderkey", "split")
    assert s1.exceptAll(s8).count() == 0


def test_standardize_matches_spark_scaler_and_sql(spark):
    r = fx.readings(spark, SF_SMALL)
    cols = ["n_items", "sum_qty", "sum_price", "avg_disc", "avg_tax"]
    a = feat_scaled = __import__("emberline.operators.features", fromlist=["x"]).standardize(r, cols, as_array=True)
    b = __import__("emberline.operators.features", fromlist=["x"]).standardize_sql_columns(r, cols)
    j = a.join(b, "o_orderkey").collect()
    for row in j:
        for i, c in enumerate(cols):
            assert abs(row["features"][i] - row[f"{c}_z"]) < 1e-9


def test_metrics_equal_mllib(spark):
    from pyspark.mllib.evaluation import BinaryClassificationMetrics

    s = fx.scored(spark, SF_MID)
    rdd = s.select(F.col("score").cast("double"), F.col("label").cast("double")).rdd.map(tuple)
    m = BinaryClassificationMetrics(rdd)
    ours = M.areas(s).first()
    assert abs(ours["auc_roc"] - m.areaUnderROC) < 1e-12
    assert abs(ours["auc_pr"] - m.areaUnderPR) < 1e-12
    # bucket count does not change the result
    one = M.areas(s, buckets=1).first()
    assert abs(one["auc_roc"] - ours["auc_roc"]) < 1e-12


def _brute_knn(df, k):
    from pyspark.sql import Window

    from emberline.functions.vectors import dist

    a = df.select(F.col("id"), F.col("x"))
    b = df.select(F.col("id").alias("nn_id"), F.col("x").alias("y"))
    p = a.join(b, F.col("id") != F.col("nn_id")).select("id", "nn_id", dist("x", "y").alias("dist"))
    w = Window.partitionBy("id").orderBy("dist", "nn_id")
    return p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "rank", "nn_id")


@pytest.mark.parametrize("pivots", [None, 1, 7])
def test_knn_exact_with_duplicates(spark, pivots):
    r = fx.readings(spark, SF_SMALL).where("label = 0")
    df = r.select(F.col("o_orderkey").alias("id"),
                  F.when(F.col("o_orderkey") % 3 == 0, F.array(*[F.lit(1.0)] * 3))
                  .otherwise(F.array("n_items", "sum_qty", "avg_tax")).alias("x"))
    nn = O.knn(df, "id", "x", 5, n_pivots=pivots).select("id", "rank", "nn_id")
    br = _brute_knn(df, 5)
    assert nn.count() == br.count()
    assert nn.exceptAll(br).count() == 0


@pytest.mark.parametrize("tile", [4096, 16])
def test_knn_tiles_are_exact_in_many_dimensions(spark, tile, monkeypatch):
    """Copies (more than k and fewer), ties and vectors 1e-9 apart, in one tile and in many."""
    import numpy as np

    monkeypatch.setattr(O, "TILE", tile)
    x = np.random.default_rng(3).normal(size=(120, 20))
    x[40:50], x[50:53] = x[0], x[1]
    x[53:60] = x[2] + np.eye(7, 20)  # equally far from x[2]
    x[60:70] = x[3] + np.random.default_rng(4).normal(size=(10, 20)) * 1e-9
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(5)
    got = O.knn(df, "id", "x", 5).select("id", "rank", "nn_id")
    assert sorted(got.collect()) == sorted(_brute_knn(df, 5).collect())


def test_smote_points_on_segments(spark):
    v = fx.vectors(spark, SF_MID)
    syn = O.smote_synthetic(v, "vec_id", "x", "label", 5, 140)
    x = v.select(F.col("vec_id").alias("src_id"), F.col("x").alias("a"))
    y = v.select(F.col("vec_id").alias("nn_id"), F.col("x").alias("b"))
    rows = syn.join(x, "src_id").join(y, "nn_id").collect()
    assert rows
    for r in rows:
        assert 0.0 <= r["u"] < 1.0
        for xi, ai, bi in zip(r["x"], r["a"], r["b"]):
            assert abs(xi - (ai + r["u"] * (bi - ai))) < 1e-9


def test_radius_join_equals_brute_force(spark):
    p = fx.points(spark, SF_MID)
    got = G.radius_neighbours(p, 2.0, dim=2).select("id", "nn_id")
    a = p.select("group_id", "id", "x")
    b = p.select("group_id", F.col("id").alias("nn_id"), F.col("x").alias("y"))
    d = F.sqrt((F.col("x")[0] - F.col("y")[0]) ** 2 + (F.col("x")[1] - F.col("y")[1]) ** 2)
    brute = a.join(b, "group_id").where((d > 1e-9) & (d < 2.0)).select("id", "nn_id")
    assert got.count() == brute.count()
    assert got.exceptAll(brute).count() == 0


def test_best_so_far_monotone(spark):
    rows = H.best_so_far(fx.trace(spark, SF_MID)).orderBy("iter").collect()
    vals = [r["global_value"] for r in rows]
    assert all(b >= a for a, b in zip(vals, vals[1:]))
    assert all(r["global_value"] >= r["actual"] for r in rows)


def test_decode_candidate(spark):
    df = spark.createDataFrame([(10.5, 0.4), (149.49, 0.5), (20.0, 1.2)], "x0 double, x1 double")
    nt, imp = E.decode_candidate("x0", "x1")
    got = [(r["num_trees"], r["impurity"]) for r in df.select(nt, imp).collect()]
    assert got == [(11, "gini"), (149, "entropy"), (20, "entropy")]


def test_param_grid_table(spark):
    t = E.param_grid_table(spark, [10, 20], ["gini", "entropy"])
    assert t.count() == 4


def test_levy_sigma_matches_gamma_values():
    # fixed values: Gamma(2.25) and Gamma(3.5) as used by the recorded algorithm
    g225, g35 = 1.1330030963193471, 3.323350970447843
    beta = 1.5
    expected = (g35 * math.sin(math.pi * beta / 2) / (g225 * beta * 2 ** ((beta - 1) / 2))) ** (1 / beta)
    assert abs(levy_sigma(beta) - expected) < 1e-12


def test_neighbour_terms_hot_spot_equals_brute_force(spark):
    """A third of the rows on one exact position plus a dense cluster: the aggregated sub-cell sums
    equal the pair-by-pair definition."""
    p = fx.points(spark, SF_MID)
    hot = p.select(
        "group_id", "id",
        F.when(F.col("id") % 3 == 0, F.array(F.lit(20.0), F.lit(2.0)))
        .when(F.col("id") % 3 == 1, F.array(20.0 + (F.col("id") % 7) * 0.01, 2.0 + (F.col("id") % 5) * 0.013))
        .otherwise(F.col("x")).alias("x"),
        "v", "value").withColumn("group_id", F.lit("g"))
    got = G.neighbour_terms(hot, 0.5, dim=2).select("id", "n_nb", "separation", "alignment", "cohesion")
    a = hot.select("id", "x", "v")
    b = hot.select(F.col("id").alias("nn_id"), F.col("x").alias("y"), F.col("v").alias("w"))
    d = F.sqrt((F.col("x")[0] - F.col("y")[0]) ** 2 + (F.col("x")[1] - F.col("y")[1]) ** 2)
    pairs = a.crossJoin(b).where((d > 1e-9) & (d < 0.5))
    agg = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y")[0]).alias("sx0"),
                                  F.sum(F.col("y")[1]).alias("sx1"), F.sum(F.col("w")[0]).alias("sv0"),
                                  F.sum(F.col("w")[1]).alias("sv1"))
    want = {r["id"]: r for r in agg.collect()}
    rows = got.collect()
    assert len(rows) == hot.count()
    for r in rows:
        w = want.get(r["id"])
        if w is None:
            assert r["n_nb"] == 0 and r["separation"] == [0.0, 0.0]
            continue
        assert r["n_nb"] == w["n"]
        assert abs(r["alignment"][0] - w["sv0"] / w["n"]) < 1e-9
        assert abs(r["alignment"][1] - w["sv1"] / w["n"]) < 1e-9


def test_partition_invariance(spark):
    """Same results under 1 and 8 input partitions (hash draws, exact kNN, exact curves)."""
    s = fx.scored(spark, SF_SMALL)
    r1 = M.evaluate_report(s.repartition(1), "score", "label", "pred")
    r8 = M.evaluate_report(s.repartition(8), "score", "label", "pred")
    a = {(r["metric"], r["threshold"]): r["value"] for r in r1.collect()}
    b = {(r["metric"], r["threshold"]): r["value"] for r in r8.collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) < 1e-12 for k in a)
    v = fx.vectors(spark, SF_MID)
    s1 = O.smote(v.repartition(1), "vec_id", "x", "label").select("src_id", "copy", "x")
    s8 = O.smote(v.repartition(8), "vec_id", "x", "label").select("src_id", "copy", "x")
    rows1 = {(r["src_id"], r["copy"]): r["x"] for r in s1.collect()}
    rows8 = {(r["src_id"], r["copy"]): r["x"] for r in s8.collect()}
    assert rows1.keys() == rows8.keys()
    assert all(max(abs(p - q) for p, q in zip(rows1[k], rows8[k])) < 1e-12 for k in rows1)


@pytest.mark.parametrize("n_rows", [1, 2, 4, 6])
def test_knn_small_classes(spark, n_rows):
    """Fewer rows than k + 1: every row gets all the others, ranked by (distance, id)."""
    pts = fx.vectors(spark, SF_MID).orderBy("vec_id").limit(n_rows).select(F.col("vec_id").alias("id"), "x")
    got = O.knn(pts, "id", "x", 5).select("id", "rank", "nn_id")
    want = _brute_knn(pts, 5)
    assert got.count() == want.count() == n_rows * min(5, n_rows - 1)
    assert got.exceptAll(want).count() == 0


def test_radius_must_be_positive(spark):
    p = fx.points(spark, SF_SMALL)
    with pytest.raises(ValueError):
        G.radius_neighbours(p, 0.0, dim=2)
    assert G.radius_value([3.0, 4.0]) == 5.0


def test_affine_rotate_forms_agree(spark):
    from emberline.functions.vectors import affine_rotate
    from emberline.operators.vector_ops import affine_rotate_rows

    v = fx.vectors(spark, SF_SMALL)
    d = len(v.first()["x"])
    off = [0.01 * j for j in range(d)]
    mat = [[((i * 7 + j * 3) % 11 - 5) / 10.0 for j in range(d)] for i in range(d)]
    a = affine_rotate_rows(v, "x", off, 0.5, mat, "y", keep=["vec_id"])
    b = v.select("vec_id", affine_rotate("x", F.array(*[F.lit(o) for o in off]), 0.5,
                                         F.array(*[F.array(*[F.lit(m) for m in r]) for r in mat])).alias("z"))
    rows = a.join(b, "vec_id").collect()
    assert len(rows) == v.count()
    assert all(max(abs(p - q) for p, q in zip(r["y"], r["z"])) < 1e-9 for r in rows)


def test_memories_prefer_the_newer_on_ties(spark):
    from emberline.operators import search_stats as H

    t = spark.createDataFrame([(0, 1, 5.0), (0, 2, 1.0), (1, 3, 5.0), (1, 4, 1.0), (2, 5, 4.0), (2, 6, 2.0)], "iter int, agent long, value double")
    last = H.best_worst_memory(t).orderBy("iter").collect()[-1]
    assert (last["food_agent"], last["enemy_agent"]) == (3, 4)
    seeded = H.best_worst_memory(t, compat_enemy_init=True).orderBy("iter").collect()
    assert (seeded[0]["enemy_agent"], seeded[0]["enemy_value"]) == (1, 5.0)


def test_matrix_is_one_file_in_line_order(spark, tmp_path):
    from emberline.sources import files as io

    one = tmp_path / "m.csv"
    one.write_text("1,2\n3,4\n5,6\n")
    got = io.read_matrix(spark, str(one), 2).orderBy("row_idx").collect()
    assert [r["values"] for r in got] == [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]
    (tmp_path / "two").mkdir()
    for n in ("a.csv", "b.csv"):
        (tmp_path / "two" / n).write_text("1,2\n")
    with pytest.raises(ValueError):
        io.read_matrix(spark, str(tmp_path / "two"), 2)


@pytest.mark.parametrize("block,pivots", [(8, None), (1024, 1), (16, 40)])
def test_knn_parts_are_exact_in_few_dimensions(spark, block, pivots, monkeypatch):
    """Large coordinates with small gaps, copies, ties, repeated and missing ids; a vector with a part that is no number or null takes no
    neighbour from those of its cell."""
    import numpy as np

    monkeypatch.setattr(O, "BLOCK", block)
    x = np.random.default_rng(5).normal(size=(150, 3)) + [1e6, 0, 0]
    x[40:50], x[50:53] = x[0], x[1]
    x[53:56] = x[2] + np.eye(3)  # equally far from x[2]
    x[60:80] = x[3] + np.random.default_rng(6).normal(size=(20, 3)) * 1e-7
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    kinds = "id long, x array<double>"
    plain = spark.createDataFrame(rows, kinds)
    want = sorted(_brute_knn(plain, 5).collect())
    odd = [(-1, [float("nan"), 0.0, 0.0]), (-2, [1e6, None, 0.0]), (None, [5e6, 0.0, 0.0])]
    got = O.knn(spark.createDataFrame(rows + odd, kinds).repartition(5), "id", "x", 5, n_pivots=pivots)
    assert sorted(r for r in got.select("id", "rank", "nn_id").collect() if r["id"] >= 0) == want
    assert got.schema.simpleString() == "struct<id:bigint,rank:int,nn_id:bigint,dist:double>"
    twice = spark.createDataFrame([(i % 4, [float(i // 2), 0.0, 0.0]) for i in range(12)], kinds)
    got = O.knn(twice, "id", "x", 5, n_pivots=pivots).groupBy("id").agg(F.sort_array(F.collect_list("rank")).alias("ranks")).collect()
    assert sorted((r["id"], r["ranks"]) for r in got) == [(i, [1, 2, 3, 4, 5]) for i in range(4)]
