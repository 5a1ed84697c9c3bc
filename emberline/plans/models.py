"""Forest training, cross-validation, candidate evaluation and the three training recipes.

All fitting is Spark ML on the cluster. Folds are a ``fold`` column (hash of the row key), never an
array of frames; the fold table is persisted once per cross-validation and released afterwards.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import assembler, scaler, scaling_model
from ..operators.oversample import smote
from ..operators.prepare import kfold_assign, score_extract
from ..session import stored
from .forests import prefix_fitness

# fixed values: forest defaults of the recorded runs
DEFAULT_TREES = 20
SAMPLE_TREES = 112
DEFAULT_SEED = 46


def forest(num_trees: int = DEFAULT_TREES, impurity: str = "gini", seed: int = DEFAULT_SEED,
           features_col: str = "features", label_col: str = "label", **params) -> RandomForestClassifier:
    """Random forest; other parameters stay at Spark's defaults (maxDepth 5, maxBins 32,
    subsamplingRate 1.0, bootstrap)."""
    return RandomForestClassifier(numTrees=num_trees, impurity=impurity, seed=seed,
                                  featuresCol=features_col, labelCol=label_col, **params)


def pipeline(input_cols: Sequence[str], num_trees: int = DEFAULT_TREES, impurity: str = "gini",
             seed: int = DEFAULT_SEED) -> tuple[RandomForestClassifier, Pipeline]:
    """Assembler -> scaler -> forest."""
    rf = forest(num_trees, impurity, seed)
    return rf, Pipeline(stages=[assembler(input_cols), scaler(), rf])


def evaluator(metric: str = "f1", metric_label: float = 0.0) -> MulticlassClassificationEvaluator:
    """Default ``f1`` is the weighted F1 (the reference's "accuracy"); ``fMeasureByLabel`` and
    ``precisionByLabel`` need the label explicitly (the reference leaves it at 0.0)."""
    return MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction",
                                             metricName=metric, metricLabel=float(metric_label))


def score_batch(model: PipelineModel, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Score a table with a fitted pipeline; adds ``score`` = P(label 1)."""
    out = score_extract(model.transform(df))
    return out.select(*keep, "prediction", "score", *(["label"] if "label" in df.columns else []))


def param_grid(rf: RandomForestClassifier, num_trees: Sequence[int], impurities: Sequence[str] = ("gini",)):
    """numTrees x impurity."""
    return ParamGridBuilder().addGrid(rf.numTrees, list(num_trees)).addGrid(rf.impurity, list(impurities)).build()


def param_grid_table(spark: SparkSession, num_trees: Sequence[int], impurities: Sequence[str] = ("gini",)) -> DataFrame:
    """E4 as a table (candidate_id, num_trees, impurity)."""
    rows = [(i, int(n), str(imp)) for i, (n, imp) in
            enumerate((n, imp) for n in num_trees for imp in impurities)]
    return spark.createDataFrame(rows, "candidate_id int, num_trees int, impurity string")


def cross_validate(est, grid, metric: MulticlassClassificationEvaluator, folded: DataFrame, k: int, parallelism: int = 1) -> CrossValidatorModel:
    """Spark's CrossValidator over a persisted table with a ``fold`` column: the same folds, fits and averages. Folds are filters on
    the one table (CrossValidator keeps every fold's training and held-out rows in memory once more), and up to ``parallelism`` fits
    of any fold run side by side, so the short jobs of one fill the cores that another leaves idle."""
    found = {r["fold"]: r["count"] for r in folded.groupBy("fold").count().collect()}
    if missing := [i for i in range(k) if not found.get(i) or found[i] == sum(found.values())]:
        raise ValueError(f"The training or the validation data of folds {missing} is empty.")

    def measured(job) -> float:
        fold, params = job
        model = est.fit(folded.where(F.col("fold") != fold), params)
        return metric.evaluate(model.transform(folded.where(F.col("fold") == fold)))

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        values = np.array(list(pool.map(measured, [(i, params) for i in range(k) for params in grid]))).reshape(k, len(grid))
    averages = values.mean(axis=0)
    best = int(averages.argmax() if metric.isLargerBetter() else averages.argmin())
    return CrossValidatorModel(est.fit(folded, grid[best]), averages.tolist(), stdMetrics=values.std(axis=0).tolist())


def cv_select(train: DataFrame, input_cols: Sequence[str], key: str, num_trees: Sequence[int] = (DEFAULT_TREES,),
              impurities: Sequence[str] = ("gini",), k: int = 5, metric: str = "f1", metric_label: float = 0.0,
              parallelism: int = 4, seed: int = DEFAULT_SEED):
    """E5: k-fold CV over the grid with a hash ``fold`` column; the best whole pipeline is refit on
    all training rows. Returns the CrossValidatorModel (``avgMetrics``, ``bestModel``)."""
    rf, pipe = pipeline(input_cols, seed=seed)
    grid = param_grid(rf, num_trees, impurities)
    folded = kfold_assign(train, key, k).persist()
    try:  # a fit keeps its rows in memory: no more of them at a time than points in the grid, or two
        return cross_validate(pipe, grid, evaluator(metric, metric_label), folded, k, min(parallelism, max(2, len(grid))))
    finally:
        folded.unpersist()


def _fold_fit(folded: DataFrame, fold: int, input_cols: Sequence[str], num_trees: int, impurity: str,
              metric: str, metric_label: float, oversample: bool, rescale: str, key: str, seed: int):
    tr = folded.where(F.col("fold") != fold)
    va = folded.where(F.col("fold") == fold)
    scal = scaling_model(tr, input_cols)
    tr_s = scal.transform(tr)
    va_s = (scaling_model(va, input_cols) if rescale == "self" else scal).transform(va)
    if oversample:
        tr_s = smote_frame(tr_s, key).drop("src_id", "copy")
    model = forest(num_trees, impurity, seed).fit(tr_s)
    m = evaluator(metric, metric_label).evaluate(model.transform(va_s))
    return fold, float(m), scal, model


def smote_frame(scaled: DataFrame, key: str, k: int = 5, perc_over: int = 140,
                materialize: bool = True) -> DataFrame:
    """SMOTE on the scaled ``features`` vector (arrays inside, vectors outside).

    The forest reads its input several times (metadata, split candidates, bagging); with
    ``materialize`` the oversampled rows are written once to the scratch folder instead of the
    kNN plan being re-run by every pass."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    arr = scaled.select(F.col(key), vector_to_array("features").alias("fx"), F.col("label"))
    out = smote(arr, key, "fx", "label", k=k, perc_over=perc_over)
    out = out.select("src_id", "copy", array_to_vector("fx").alias("features"), "label")
    return stored(out, "smote-frame") if materialize else out


def cv_manual(train: DataFrame, input_cols: Sequence[str], key: str, num_trees: int = DEFAULT_TREES,
              impurity: str = "gini", k: int = 5, metric: str = "fMeasureByLabel", metric_label: float = 0.0,
              oversample: bool = False, rescale: str = "train", parallelism: int = 4,
              seed: int = DEFAULT_SEED):
    """For each fold fit on the other folds (SMOTE if ``oversample``), evaluate on the fold.
    ``rescale="self"`` scales the held-out fold by its own statistics (the reference); the default
    uses the training scaler. Returns (metrics table (fold, metric), list of per-fold results)."""
    folded = kfold_assign(train, key, k).persist()
    try:
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            res = list(pool.map(lambda f: _fold_fit(folded, f, input_cols, num_trees, impurity, metric,
                                                    metric_label, oversample, rescale, key, seed), range(k)))
    finally:
        folded.unpersist()
    spark = train.sparkSession
    table = spark.createDataFrame([(f, m) for f, m, _, _ in res], "fold int, metric double")
    return table, res


def cv_reduce(fold_metrics: DataFrame, how: str = "avg") -> DataFrame:
    """Reduce per-fold metrics: ``avg`` (default) or ``max`` (the reference's best single fold)."""
    agg = F.avg("metric") if how == "avg" else F.max("metric")
    return fold_metrics.agg(agg.alias("metric"))


def decode_candidate(x0, x1):
    """E7 decode as columns: num_trees = round(x0) (half up), impurity = entropy if round(x1) != 0."""
    c0 = F.col(x0) if isinstance(x0, str) else x0
    c1 = F.col(x1) if isinstance(x1, str) else x1
    return (F.floor(c0 + 0.5).cast("int").alias("num_trees"),
            F.when(F.floor(c1 + 0.5) != 0, F.lit("entropy")).otherwise(F.lit("gini")).alias("impurity"))


def candidate_eval(candidates: DataFrame, train: DataFrame, input_cols: Sequence[str], key: str,
                   k: int = 5, metric: str = "fMeasureByLabel", metric_label: float = 0.0, reduce: str = "avg",
                   fitness: DataFrame | None = None, parallelism: int = 4, seed: int = DEFAULT_SEED) -> DataFrame:
    """Fitness of candidate rows (candidate_id, num_trees, impurity): the candidates joined with ``value``.

    One forest of the largest size is fitted per fold and impurity, and every candidate is scored on its first
    ``num_trees`` trees. ``fitness`` is a table (num_trees, impurity, value) from an earlier ``prefix_fitness``
    that covers the candidates; without it the table is made for the sizes that occur (a forest size is a small
    number, so there are few whatever the number of candidates)."""
    if fitness is None:
        pairs = candidates.groupBy("impurity").agg(F.collect_set("num_trees").alias("sizes")).collect()
        if not pairs:
            return candidates.withColumn("value", F.lit(None).cast("double"))
        sizes = sorted({int(n) for r in pairs for n in r["sizes"]})
        fitness = prefix_fitness(train, input_cols, key, sizes, sorted(r["impurity"] for r in pairs), k, metric, metric_label, reduce,
                                 parallelism=parallelism, seed=seed)
    return candidates.join(F.broadcast(fitness), ["num_trees", "impurity"], "left")  # sizes x impurities rows


def model_params(model) -> DataFrame:
    """(param, value) of a fitted forest (or of the forest stage of a pipeline)."""
    from pyspark.ml.classification import RandomForestClassificationModel

    if isinstance(model, PipelineModel):
        model = [s for s in model.stages if isinstance(s, RandomForestClassificationModel)][-1]
    spark = SparkSession.getActiveSession()
    rows = [(p.name, str(v)) for p, v in sorted(model.extractParamMap().items(), key=lambda kv: kv[0].name)]
    rows.append(("numFeatures", str(model.numFeatures)))
    rows.append(("totalNumNodes", str(model.totalNumNodes)))
    return spark.createDataFrame(rows, "param string, value string")


# ----------------------------------------------------------------------------- recipes

def train_plain(train: DataFrame, test: DataFrame, input_cols: Sequence[str], key: str,
                num_trees: int = DEFAULT_TREES, k: int = 5, rescale: str = "train", seed: int = DEFAULT_SEED):
    """v1: pipeline + CV on train (weighted F1), then score the test rows. ``rescale="self"`` scales
    the test rows by their own statistics, as the reference does. Returns (best pipeline, scored test,
    cv average metrics)."""
    cvm = cv_select(train, input_cols, key, [num_trees], k=k, seed=seed)
    best: PipelineModel = cvm.bestModel
    if rescale == "self":
        scal = scaling_model(test, input_cols)
        scored = best.stages[-1].transform(scal.transform(test))
    else:
        scored = best.transform(test)
    return best, score_extract(scored), list(cvm.avgMetrics)


def train_oversampled(train: DataFrame, test: DataFrame, input_cols: Sequence[str], key: str,
                      num_trees: int = SAMPLE_TREES, k: int = 5, metric_label: float = 0.0,
                      seed: int = DEFAULT_SEED):
    """v2: scale with the training scaler, SMOTE the training rows, CV the forest on
    precisionByLabel, score the test rows with the same scaler."""
    scal = scaling_model(train, input_cols)
    tr = smote_frame(scal.transform(train), key)
    rf = forest(num_trees, seed=seed)
    folded = kfold_assign(tr, ["src_id", "copy"], k).persist()
    try:
        cvm = cross_validate(rf, param_grid(rf, [num_trees]), evaluator("precisionByLabel", metric_label), folded.drop("src_id", "copy"), k)
    finally:
        folded.unpersist()
    best = PipelineModel(stages=[*scal.stages, cvm.bestModel])
    return best, score_extract(best.transform(test)), list(cvm.avgMetrics)


def train_kfold(train: DataFrame, test: DataFrame, input_cols: Sequence[str], key: str,
                num_trees: int = DEFAULT_TREES, oversample: bool = True, k: int = 5, metric_label: float = 0.0,
                reduce: str = "max", seed: int = DEFAULT_SEED):
    """v3: manual k-fold on the *training* rows (the reference cuts them from the test rows) with
    optional SMOTE; keeps the best fold's model (``reduce="max"``), or takes the folds for the metric only
    and fits one model on all training rows (``reduce="avg"``); scores the test rows."""
    table, res = cv_manual(train, input_cols, key, num_trees, k=k, metric_label=metric_label,
                           oversample=oversample, seed=seed)
    if reduce == "max":
        _, _, scal, model = max(res, key=lambda r: r[1])
    else:
        scal = scaling_model(train, input_cols)
        rows = scal.transform(train)
        model = forest(num_trees, seed=seed).fit(smote_frame(rows, key) if oversample else rows)
    best = PipelineModel(stages=[*scal.stages, model])
    return best, score_extract(best.transform(test)), table
