"""Metric functions against the published confusion tables (counts in, logged numbers out)."""

import pytest
from pyspark.sql import functions as F

from emberline.operators import metrics as M

# fixed values: (TP, FP, FN, TN) and the logged weighted F1 ("accuracy"), precision(1), recall(1),
GOLDEN = [
    (8820, 1709, 154, 1821, 0.8359043885, 0.8376863900, 0.9828393136, 0.9044762344, 0.8366567827),
    (8908, 220, 66, 3310, 0.9769695881, 0.9758983348, 0.9926454201, 0.9842006408, 0.9749488291),
    (8882, 1800, 92, 1730, 0.8311182365, 0.8314922299, 0.9897481614, 0.9037444037, 0.8309088906),
    (8793, 97, 181, 3433, 0.9778455513, 0.9890888639, 0.9798306218, 0.9844379758, 0.9863518941),
    (8722, 555, 252, 2975, 0.9345493391, 0.9401746254, 0.9719188768, 0.9557832448, 0.9370508211),
    (8853, 1766, 121, 1764, 0.8325010408, 0.8336943215, 0.9865166035, 0.9036900934, 0.8329122577),
    (8766, 463, 208, 3067, 0.9457076061, 0.9498320511, 0.9768219300, 0.9631379443, 0.9471417527),
]


def _frame(spark, tp, fp, fn, tn):
    counts = spark.createDataFrame([(1.0, 1.0, tp), (0.0, 1.0, fp), (1.0, 0.0, fn), (0.0, 0.0, tn)],
                                   "label double, prediction double, n int")
    return counts.select("label", "prediction", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_i")).drop("_i")


@pytest.mark.parametrize("row", GOLDEN)
def test_golden_confusion(spark, row):
    tp, fp, fn, tn, wf1, p1, r1, f11, pr2 = row
    df = _frame(spark, tp, fp, fn, tn)
    assert abs(M.weighted_f1(df).first()["weighted_f1"] - wf1) < 1e-9
    cs = {r["label"]: r for r in M.class_stats(df).collect()}
    assert abs(cs[1.0]["precision"] - p1) < 1e-9
    assert abs(cs[1.0]["recall"] - r1) < 1e-9
    assert abs(cs[1.0]["f1"] - f11) < 1e-9
    assert abs(M.auc_pr(df, "prediction").first()["auc_pr"] - pr2) < 1e-9
    acc = M.accuracy(df).first()["accuracy"]
    assert abs(acc - (tp + tn) / (tp + fp + fn + tn)) < 1e-12
    # metric label 0.0 is the no-alarm class
    f0 = M.f_by_label(df, 0.0).first()["f1"]
    assert abs(f0 - cs[0.0]["f1"]) < 1e-15


def test_hard_pr_is_three_point_trapezoid(spark):
    tp, fp, fn, tn = GOLDEN[0][:4]
    df = _frame(spark, tp, fp, fn, tn)
    p1, r1, prev = tp / (tp + fp), tp / (tp + fn), (tp + fn) / (tp + fp + fn + tn)
    expected = r1 * p1 + (1 - r1) * (p1 + prev) / 2
    assert abs(M.auc_pr(df, "prediction").first()["auc_pr"] - expected) < 1e-12


def test_bucketed_prefix_sums_equal_mllib(spark):
    """Force the multi-bucket two-level prefix sum (which many distinct scores ask for)."""
    from pyspark.mllib.evaluation import BinaryClassificationMetrics

    from conftest import SF_MID
    from emberline import fixtures as fx

    s = fx.scored(spark, SF_MID)
    ours = M.areas(s, buckets=16).first()
    rdd = s.select(F.col("score").cast("double"), F.col("label").cast("double")).rdd.map(tuple)
    m = BinaryClassificationMetrics(rdd)
    assert abs(ours["auc_roc"] - m.areaUnderROC) < 1e-12
    assert abs(ours["auc_pr"] - m.areaUnderPR) < 1e-12
    pts = [r["point"] for r in M.pr_curve(s, buckets=16).collect()]
    assert sorted(pts) == list(range(len(pts)))


def test_curves_ignore_missing_and_do_not_depend_on_buckets(spark):
    rows = [(i / 50 if i % 9 else None, float(i % 3 == 0) if i % 11 else None) for i in range(50)] + [(float("nan"), 1.0)]
    s = spark.createDataFrame(rows, "score double, label double")
    clean = spark.createDataFrame([r for r in rows if None not in r and r[0] == r[0]], "score double, label double")
    want = M.areas(clean, buckets=1).first()
    for buckets in (None, 1, 16, 256):
        assert M.areas(s, buckets=buckets).first() == want
        assert M.pr_curve(s, buckets=buckets).orderBy("point").collect() == M.pr_curve(clean).orderBy("point").collect()
        assert M.roc_curve(s, buckets=buckets).orderBy("point").collect() == M.roc_curve(clean).orderBy("point").collect()


def test_curves_over_thousands_of_ranges(spark):
    """200,000 distinct scores in 5,000 ranges: the same points as in one, and a plan of the same size as with 8."""
    s = spark.range(200_000).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    columns = ["threshold", "point", "tp", "fp", "prev_tp", "prev_fp", "P", "N", "n_points"]
    found, sizes = [], []
    for ranges in (1, 2, 5000):
        t = M.threshold_table(s, buckets=ranges)
        sizes.append(len(t._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        digest = F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("digest")
        found.append(t.agg(digest, F.count(F.lit(1)).alias("n"), *M.area_columns()).first())
    assert sizes[1] == sizes[2] and found[0][:2] == found[1][:2] == found[2][:2]
    for b in found[1:]:
        assert abs(found[0]["auc_roc"] - b["auc_roc"]) < 1e-12 and abs(found[0]["auc_pr"] - b["auc_pr"]) < 1e-12


def test_report_has_the_pr_points(spark):
    s = spark.createDataFrame([(0.9, 1, 1), (0.8, 0, 1), (0.2, 1, 0), (0.1, 0, 0), (None, 1, 1)], "score double, label int, pred int")
    rep = {(r["metric"], r["threshold"]): r["value"] for r in M.evaluate_report(s, "score", "label", "pred").collect()}
    pts = {r["point"]: (r["recall"], r["precision"]) for r in M.pr_curve(s, "pred").collect()}
    assert len(pts) == 3
    for point, (recall, precision) in pts.items():
        assert rep["pr_recall", float(point)] == recall and rep["pr_precision", float(point)] == precision
