"""Classification metrics as DataFrame queries.

Semantics follow Spark's MulticlassMetrics / BinaryClassificationMetrics without binning:

* confusion counts per (label, prediction); weighted F1 is the count-weighted mean of the per-class
  F-measure over the *true* labels (this is what the default multiclass evaluator reports);
* binary curves have one point per distinct score, descending; a row is positive when label > 0.5;
  precision = tp/(tp+fp) (1.0 when nothing is predicted), recall = tp/P, fpr = fp/N;
* ROC runs from (0,0) to (1,1); the PR curve starts at (0, precision of the first threshold);
  areas are trapezoid sums.

Scale: rows are first reduced to one row per distinct score (map-side partial aggregation). The running
sums are then prefix sums over range partitions: Spark deals the scores into ranges by a sample of them, each
row keeps the number of its range, the ranges' totals (one row a range) are summed up and joined back by that
number, and a window inside each range does the rest. The plan has the same size for any number of ranges, and
no step puts more than one range into a task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

RANGE_ROWS = 500_000  # distinct thresholds in one range, about


def _ratio(num: Column, den: Column, if_zero: float) -> Column:
    return F.when(den == 0, F.lit(if_zero)).otherwise(num / den)


def _f_measure(p: Column, r: Column, beta: float = 1.0) -> Column:
    b2 = beta * beta
    return F.when(p + r == 0, F.lit(0.0)).otherwise((1.0 + b2) * p * r / (b2 * p + r))


# ---------------------------------------------------------------- multiclass (hard predictions)

def confusion(df: DataFrame, label_col: str = "label", prediction_col: str = "prediction",
              group_cols: Sequence[str] = (), weight_col: str | None = None) -> DataFrame:
    """(group..., label, prediction, n) counts (``weight_col``: rows are pre-aggregated counts)."""
    n = F.sum(weight_col).cast("bigint") if weight_col else F.count(F.lit(1))
    return df.groupBy(
        *group_cols,
        F.col(label_col).cast("double").alias("label"),
        F.col(prediction_col).cast("double").alias("prediction"),
    ).agg(n.alias("n"))


def class_stats(df: DataFrame, label_col: str = "label", prediction_col: str = "prediction",
                group_cols: Sequence[str] = (), weight_col: str | None = None) -> DataFrame:
    """Per (group..., class): tp, predicted, actual, precision, recall, f1.

    Built from the confusion table, which has at most (#groups x #classes^2) rows.
    """
    g = list(group_cols)
    conf = confusion(df, label_col, prediction_col, g, weight_col)
    per_class = (
        conf.select(*g, F.col("label").alias("cls"), F.lit(0).cast("bigint").alias("pred_n"),
                    F.col("n").alias("act_n"), F.when(F.col("label") == F.col("prediction"), F.col("n"))
                    .otherwise(F.lit(0)).cast("bigint").alias("tp_n"))
        .unionByName(conf.select(*g, F.col("prediction").alias("cls"), F.col("n").alias("pred_n"),
                                 F.lit(0).cast("bigint").alias("act_n"), F.lit(0).cast("bigint").alias("tp_n")))
        .groupBy(*g, "cls")
        .agg(F.sum("tp_n").alias("tp"), F.sum("pred_n").alias("predicted"), F.sum("act_n").alias("actual"))
    )
    p = _ratio(F.col("tp"), F.col("predicted"), 0.0)
    r = _ratio(F.col("tp"), F.col("actual"), 0.0)
    return per_class.select(
        *g, F.col("cls").alias("label"), "tp", "predicted", "actual",
        p.alias("precision"), r.alias("recall"), _f_measure(p, r).alias("f1"),
    )


def weighted_f1(df: DataFrame, label_col: str = "label", prediction_col: str = "prediction",
                group_cols: Sequence[str] = (), weight_col: str | None = None) -> DataFrame:
    """One row per group: ``weighted_f1`` (what the reference prints as "accuracy")."""
    cs = class_stats(df, label_col, prediction_col, group_cols, weight_col)
    return cs.groupBy(*group_cols).agg((F.sum(F.col("f1") * F.col("actual")) / F.sum("actual")).alias("weighted_f1"))


def accuracy(df: DataFrame, label_col: str = "label", prediction_col: str = "prediction",
             weight_col: str | None = None) -> DataFrame:
    """One row: share of rows with prediction = label."""
    hit = (F.col(label_col).cast("double") == F.col(prediction_col).cast("double")).cast("double")
    if weight_col:
        return df.agg((F.sum(hit * F.col(weight_col)) / F.sum(weight_col)).alias("accuracy"))
    return df.agg(F.avg(hit).alias("accuracy"))


def by_label(df: DataFrame, metric: str, metric_label: float, label_col: str = "label",
             prediction_col: str = "prediction", group_cols: Sequence[str] = (), weight_col: str | None = None) -> DataFrame:
    """One row (per group): precision / recall / f1 of one class. The label is explicit (the
    reference's evaluator default is 0.0, i.e. the *no alarm* class); a class never seen scores 0."""
    g = list(group_cols)
    cs = class_stats(df, label_col, prediction_col, g, weight_col)
    return cs.groupBy(*g).agg(
        F.lit(float(metric_label)).alias("label"),
        F.coalesce(F.max(F.when(F.col("label") == float(metric_label), F.col(metric))), F.lit(0.0)).alias(metric),
    )


def f_by_label(df: DataFrame, metric_label: float = 0.0, **kw) -> DataFrame:
    return by_label(df, "f1", metric_label, **kw)


def precision_by_label(df: DataFrame, metric_label: float = 0.0, **kw) -> DataFrame:
    return by_label(df, "precision", metric_label, **kw)


# ---------------------------------------------------------------- binary curves (scores)

def _ranged(d: DataFrame, ranges: int | None) -> DataFrame:
    """``d`` with the number of the score range each row lies in, ``part``: 0 has the highest scores. As many ranges as the
    number of distinct scores asks for, or ``ranges``. The table is written, as another run of the sampled
    partitioning need not cut at the same scores."""
    rows = d.count()
    n = min(ranges, rows) if ranges else -(-rows // RANGE_ROWS)
    if n <= 1:
        return d.withColumn("part", F.lit(0))
    return stored(d.repartitionByRange(n, F.desc("threshold")).withColumn("part", F.spark_partition_id()), "curve-ranges")


def threshold_table(df: DataFrame, score_col: str = "score", label_col: str = "label",
                    buckets: int | None = None, materialize: bool = True,
                    weight_col: str | None = None) -> DataFrame:
    """One row per distinct score (= threshold), with running counts and curve coordinates.

    Columns: threshold, point (1 = highest), n_points, pos, neg, tp, fp, prev_tp, prev_fp, P, N, precision,
    recall, fpr, f1, prev_precision, prev_recall, prev_fpr. Rows without a score (null or NaN) or without a
    label take no part.

    The per-score table is counted, sampled and dealt into ranges; with ``materialize`` it is written once to the
    scratch folder, so the scored input is scanned once.
    """
    w = F.col(weight_col).cast("long") if weight_col else F.lit(1).cast("long")
    s = F.col(score_col).cast("double")
    d = df.where(s.isNotNull() & ~F.isnan(s) & F.col(label_col).isNotNull()).groupBy(s.alias("threshold")).agg(
        F.sum(F.when(F.col(label_col) > 0.5, w).otherwise(F.lit(0).cast("long"))).alias("pos"),
        F.sum(F.when(F.col(label_col) <= 0.5, w).otherwise(F.lit(0).cast("long"))).alias("neg"),
    )
    if materialize:
        d = stored(d, "curve-scores")
    d = _ranged(d, buckets)
    # one row a range: what lies before it and in all of them
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy(F.lit(1))
    totals = d.groupBy("part").agg(F.sum("pos").alias("b_pos"), F.sum("neg").alias("b_neg"), F.count(F.lit(1)).alias("b_n")).select(
        "part",
        F.coalesce(F.sum("b_pos").over(before), F.lit(0)).alias("off_pos"),
        F.coalesce(F.sum("b_neg").over(before), F.lit(0)).alias("off_neg"),
        F.coalesce(F.sum("b_n").over(before), F.lit(0)).alias("off_n"),
        F.sum("b_pos").over(everywhere).alias("P"),
        F.sum("b_neg").over(everywhere).alias("N"),
        F.sum("b_n").over(everywhere).alias("n_points"),
    )
    w = Window.partitionBy("part").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    c = d.join(F.broadcast(totals), "part").select(
        "threshold", "pos", "neg", "P", "N", "n_points",
        (F.col("off_n") + F.count(F.lit(1)).over(w)).cast("bigint").alias("point"),
        (F.col("off_pos") + F.sum("pos").over(w)).alias("tp"),
        (F.col("off_neg") + F.sum("neg").over(w)).alias("fp"),
    )
    c = c.withColumn("prev_tp", F.col("tp") - F.col("pos")).withColumn("prev_fp", F.col("fp") - F.col("neg"))
    precision = _ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0)
    recall = _ratio(F.col("tp"), F.col("P"), 0.0)
    fpr = _ratio(F.col("fp"), F.col("N"), 0.0)
    prev_den = F.col("prev_tp") + F.col("prev_fp")
    c = c.select(
        "*",
        precision.alias("precision"), recall.alias("recall"), fpr.alias("fpr"),
    )
    return c.select(
        "*",
        _f_measure(F.col("precision"), F.col("recall")).alias("f1"),
        # the PR curve's first point is (0, precision of the first threshold)
        F.when(prev_den == 0, F.col("precision")).otherwise(F.col("prev_tp") / prev_den).alias("prev_precision"),
        _ratio(F.col("prev_tp"), F.col("P"), 0.0).alias("prev_recall"),
        _ratio(F.col("prev_fp"), F.col("N"), 0.0).alias("prev_fpr"),
    )


def areas(df: DataFrame, score_col: str = "score", label_col: str = "label",
          buckets: int | None = None, weight_col: str | None = None) -> DataFrame:
    """One row: auc_roc, auc_pr (trapezoid sums over the exact curves)."""
    return areas_of(threshold_table(df, score_col, label_col, buckets, weight_col=weight_col))


def areas_of(t: DataFrame) -> DataFrame:
    """auc_roc, auc_pr of a threshold table."""
    return t.agg(*area_columns())


def area_columns() -> list[Column]:
    """The trapezoid sums over a threshold table."""
    return [
        F.sum((F.col("fpr") - F.col("prev_fpr")) * (F.col("recall") + F.col("prev_recall")) / 2.0).alias("auc_roc"),
        F.sum((F.col("recall") - F.col("prev_recall")) * (F.col("precision") + F.col("prev_precision")) / 2.0).alias("auc_pr"),
    ]


def auc_roc(df: DataFrame, score_col: str = "score", label_col: str = "label", **kw) -> DataFrame:
    return areas(df, score_col, label_col, **kw).select("auc_roc")


def auc_pr(df: DataFrame, score_col: str = "score", label_col: str = "label", **kw) -> DataFrame:
    return areas(df, score_col, label_col, **kw).select("auc_pr")


def by_threshold(df: DataFrame, metric: str, score_col: str = "score", label_col: str = "label",
                 **kw) -> DataFrame:
    """(threshold, <metric>) for metric in precision / recall / f1."""
    return threshold_table(df, score_col, label_col, **kw).select("threshold", metric)


def pr_curve(df: DataFrame, score_col: str = "score", label_col: str = "label", **kw) -> DataFrame:
    """(point, recall, precision): point 0 is (0, first precision), then one point per threshold,
    numbered by descending threshold. No rows, no points."""
    return pr_points(threshold_table(df, score_col, label_col, **kw))


def pr_points(t: DataFrame) -> DataFrame:
    """The PR curve's points of a threshold table."""
    own = F.struct("point", "recall", "precision")
    start = F.struct(F.lit(0).cast("bigint").alias("point"), F.lit(0.0).alias("recall"), F.col("precision"))
    return t.select(F.explode(F.when(F.col("point") == 1, F.array(start, own)).otherwise(F.array(own))).alias("p")).select("p.*")


def roc_curve(df: DataFrame, score_col: str = "score", label_col: str = "label", **kw) -> DataFrame:
    """(point, fpr, tpr): (0,0), one point per threshold, then (1,1). No rows, no points."""
    t = threshold_table(df, score_col, label_col, **kw)
    corner = lambda point, at: F.struct(point.cast("bigint").alias("point"), F.lit(at).alias("fpr"), F.lit(at).alias("tpr"))
    none = F.array().cast("array<struct<point:bigint,fpr:double,tpr:double>>")
    points = F.concat(F.when(F.col("point") == 1, F.array(corner(F.lit(0), 0.0))).otherwise(none),
                      F.array(F.struct("point", "fpr", F.col("recall").alias("tpr"))),
                      F.when(F.col("point") == F.col("n_points"), F.array(corner(F.col("point") + 1, 1.0))).otherwise(none))
    return t.select(F.explode(points).alias("p")).select("p.*")


def evaluate_report(df: DataFrame, score_col: str = "score", label_col: str = "label",
                    prediction_col: str = "prediction", buckets: int | None = None,
                    materialize: bool = True) -> DataFrame:
    """Long table (metric, threshold, value): weighted F1 (logged as "accuracy"), true accuracy, AUC-ROC / AUC-PR
    on the score; on the hard predictions precision / recall / F1 by threshold, AUC-PR and the points of the PR
    curve (``pr_recall`` and ``pr_precision``, whose ``threshold`` is the number of the point; 0 is the first).

    One pass over the input: rows are counted per (score, label, prediction) -- a table no larger
    than the distinct scores times four -- and every metric is derived from those counts."""
    cnt = df.groupBy(F.col(score_col).cast("double").alias("_s"), F.col(label_col).cast("double").alias("_l"),
                     F.col(prediction_col).cast("double").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    if materialize:
        cnt = stored(cnt, "report-counts")
    null_t = F.lit(None).cast("double").alias("threshold")
    wf1 = weighted_f1(cnt, "_l", "_p", weight_col="_n").select(
        F.lit("weighted_f1").alias("metric"), null_t, F.col("weighted_f1").alias("value"))
    acc = accuracy(cnt, "_l", "_p", weight_col="_n").select(
        F.lit("accuracy").alias("metric"), null_t, F.col("accuracy").alias("value"))
    a = areas_of(threshold_table(cnt, "_s", "_l", buckets, materialize=False, weight_col="_n"))
    soft = a.select(F.explode(F.array(
        F.struct(F.lit("auc_roc").alias("metric"), null_t, F.col("auc_roc").alias("value")),
        F.struct(F.lit("auc_pr").alias("metric"), null_t, F.col("auc_pr").alias("value")),
    )).alias("m")).select("m.*")
    hard_t = threshold_table(cnt, "_p", "_l", buckets, materialize=False, weight_col="_n")
    points = pr_points(hard_t).select(F.explode(F.array(*[
        F.struct(F.lit(f"pr_{m}").alias("metric"), F.col("point").cast("double").alias("threshold"), F.col(m).alias("value"))
        for m in ("recall", "precision")
    ])).alias("m")).select("m.*")
    hard = hard_t.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col("threshold"), F.col(m).alias("value"))
        for m in ("precision", "recall", "f1")
    ])).alias("m")).select("m.*")
    hard_area = areas_of(hard_t).select(F.lit("auc_pr_hard").alias("metric"), null_t, F.col("auc_pr").alias("value"))
    return wf1.unionByName(acc).unionByName(soft).unionByName(hard).unionByName(hard_area).unionByName(points)
