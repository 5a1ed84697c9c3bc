"""Registered model, search and streaming queries (rows-only checks: Spark ML output has no SQL twin).

Every query trains on the whole readings table of the scale factor (80 % hash split) and scores the
rest; forests are seeded, so reruns on the same partitioning give the same rows.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.hashing import sql_hash01
from ..operators import metrics as M
from ..operators import prepare as P
from ..schema import READING_FEATURES, READING_JSON_SCHEMA, READING_KEY
from ..session import scratch_path, stored
from ..sources import files as io
from ..streaming import scoring as S
from . import forests as TR
from . import models as E
from . import search as H1
from .catalog import RM, TRAIN_FRACTION, register

FEATS = READING_FEATURES
TREES = 20


def _split(spark, sf):
    """Readings written once to the scratch folder (scaler and forest passes re-read them instead
    of re-aggregating lineitem), then the hash split."""
    r = stored(fx.readings(spark, sf), "readings")
    return P.train_test(r, READING_KEY, TRAIN_FRACTION)


def _fit(train):
    _, pipe = E.pipeline(FEATS, TREES)
    return pipe.fit(train)


def _report(pred: DataFrame) -> DataFrame:
    rep = M.evaluate_report(pred, "score", "label", "prediction")
    return rep.select("metric", "threshold", F.round("value", RM).alias("value"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _split(spark, sf)
    return _report(P.score_extract(_fit(train).transform(test)))


@register("rf_fit_predict")
def q_rf_fit_predict(spark, sf):
    """Fit the pipeline on the training split, predict the test split."""
    train, test = _split(spark, sf)
    return _fit(train).transform(test).select(READING_KEY, "label", "prediction")


@register("score_extract")
def q_score_extract(spark, sf):
    """Positive-class score from the probability vector."""
    train, test = _split(spark, sf)
    return P.score_extract(_fit(train).transform(test)).select(READING_KEY, "label", "score")


@register("pipeline_fit")
def q_pipeline_fit(spark, sf):
    """Fitted pipeline summary -- the forest's feature importances by feature."""
    train, _ = _split(spark, sf)
    model = _fit(train)
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(FEATS, imp)], "feature string, importance double")


@register("score_batch")
def q_score_batch(spark, sf):
    """Score a whole table with a fitted pipeline."""
    train, _ = _split(spark, sf)
    return E.score_batch(_fit(train), fx.readings(spark, sf), keep=[READING_KEY])


@register("cv_select")
def q_cv_select(spark, sf):
    """5-fold CV over numTrees x impurity with a fold column; average metric per grid point."""
    train, _ = _split(spark, sf)
    grid = [10, TREES]
    cvm = E.cv_select(train, FEATS, READING_KEY, grid, ["gini"])
    return spark.createDataFrame([(n, "gini", float(m)) for n, m in zip(grid, cvm.avgMetrics)],
                                 "num_trees int, impurity string, avg_metric double")


@register("cv_manual")
def q_cv_manual(spark, sf):
    """Manual k-fold, F-measure of label 0 per held-out fold."""
    train, _ = _split(spark, sf)
    table, _ = E.cv_manual(train, FEATS, READING_KEY, TREES)
    return table


@register("candidate_eval")
def q_candidate_eval(spark, sf):
    """Fitness of candidate parameter rows, 5 folds; every size on its first trees of one forest a fold and impurity."""
    train, _ = _split(spark, sf)
    cands = E.param_grid_table(spark, [10, 15, TREES], ["gini", "entropy"])
    return E.candidate_eval(cands, train, FEATS, READING_KEY)


@register("recipe_plain")
def q_recipe_plain(spark, sf):
    """E8 v1: pipeline + CV on train, evaluation report on test."""
    train, test = _split(spark, sf)
    _, pred, _ = E.train_plain(train, test, FEATS, READING_KEY, TREES)
    return _report(pred)


@register("recipe_oversampled")
def q_recipe_oversampled(spark, sf):
    """E8 v2: SMOTE on the scaled training rows, CV of 112 trees on precision of label 0, report on test."""
    train, test = _split(spark, sf)
    _, pred, _ = E.train_oversampled(train, test, FEATS, READING_KEY)
    return _report(pred)


@register("recipe_kfold")
def q_recipe_kfold(spark, sf):
    """E8 v3: manual k-fold with SMOTE inside the folds, best fold's model, report on test."""
    train, test = _split(spark, sf)
    _, pred, _ = E.train_kfold(train, test, FEATS, READING_KEY, TREES, oversample=True)
    return _report(pred)


@register("model_params")
def q_model_params(spark, sf):
    """Parameters of the fitted forest."""
    train, _ = _split(spark, sf)
    return E.model_params(_fit(train))


@register("model_roundtrip")
def q_model_roundtrip(spark, sf):
    """Save the fitted pipeline (overwrite), load it, score the test split."""
    train, test = _split(spark, sf)
    path = scratch_path(spark, "model")
    io.save_model(_fit(train), path)
    return P.score_extract(io.load_model(path).transform(test)).select(READING_KEY, "prediction", "score")


@register("population_search")
def q_population_search(spark, sf):
    """H1: 20 agents, 5 generations, 10 to 150 trees, 5 folds; every agent of every generation."""
    train, _ = _split(spark, sf)
    history, _ = H1.population_search(train, FEATS, READING_KEY)
    return history


@register("search_summary")
def q_search_summary(spark, sf):
    """The search's result, a row a generation with its agents."""
    train, _ = _split(spark, sf)
    return H1.result_lines(*H1.population_search(train, FEATS, READING_KEY))


@register("tree_walk", fx.with_sql("SELECT o_orderkey, CAST(1 AS INTEGER) AS agrees FROM r", r=fx.READINGS_SQL))
def q_tree_walk(spark, sf):
    """Every reading scored by expressions over the exported node table; 1 where prediction and score are the model's."""
    train, _ = _split(spark, sf)
    model = _fit(train)
    rows = model.transform(fx.readings(spark, sf)).select(
        READING_KEY, vector_to_array("features").alias("fx"), F.col("prediction").alias("model_prediction"), vector_to_array("probability")[1].alias("model_score"))
    walked = TR.walk_scores(rows, F.col("fx"), TR.node_table(model.stages[-1]))
    same = (F.col("prediction") == F.col("model_prediction")) & (F.abs(F.col("score") - F.col("model_score")) < 1e-12)
    return walked.select(READING_KEY, same.cast("int").alias("agrees"))


def _stream(spark, sf, alerts_only: bool, rescale: bool = False) -> DataFrame:
    train, test = _split(spark, sf)
    model = _fit(train)
    src = scratch_path(spark, "stream_in")
    io.write_json_lines(test.select(READING_KEY, *FEATS, "label"), src)
    sink = scratch_path(spark, "stream_out")
    ckpt = scratch_path(spark, "stream_ckpt")
    stream = S.json_line_stream(spark, src, READING_JSON_SCHEMA)
    if rescale:
        q = S.rescale_batches(stream, model, FEATS, [READING_KEY], sink, ckpt, available_now=True)
    else:
        q = S.start(S.score_stream(stream, model, [READING_KEY], alerts_only), sink, ckpt, available_now=True)
    q.awaitTermination()
    schema = "o_orderkey bigint, prediction double, score double"
    return spark.read.schema(schema).parquet(sink).select(READING_KEY, "prediction", "score")


@register("stream_score")
def q_stream_score(spark, sf):
    """JSON lines -> declared schema -> fitted pipeline -> parquet sink (availableNow run)."""
    return _stream(spark, sf, alerts_only=False)


@register("stream_alerts")
def q_stream_alerts(spark, sf):
    """Only rows predicted as alarm (prediction = 1) reach the sink."""
    return _stream(spark, sf, alerts_only=True)


@register("stream_rescale_batches")
def q_stream_rescale_batches(spark, sf):
    """D4/B6 on the stream: compat per-micro-batch scaling through foreachBatch."""
    return _stream(spark, sf, alerts_only=False, rescale=True)


# fixed value: every so many readings are sent as a line that breaks off
TORN_EVERY = 17
_H_SPLIT = sql_hash01("split", "o_orderkey")


@register("stream_sinks", fx.with_sql(f"""SELECT o_orderkey, CASE WHEN o_orderkey % {TORN_EVERY} = 0 THEN 'broken' ELSE 'scored' END AS sink
FROM r WHERE {_H_SPLIT} >= {TRAIN_FRACTION}""", r=fx.READINGS_SQL))
def q_stream_sinks(spark, sf):
    """The test readings as lines of growing files, some of them broken off, through the line source into the raw, scored
    and broken-line sinks; which sink each reading's line has reached, read from committed epochs."""
    train, test = _split(spark, sf)
    model = _fit(train)
    line = F.to_json(F.struct(READING_KEY, *FEATS, "label"))
    torn = F.when(F.col(READING_KEY) % TORN_EVERY == 0, F.substring(line, 1, 30)).otherwise(line)
    source, root = scratch_path(spark, "lines"), scratch_path(spark, "sinks")
    test.select(torn.alias("value")).write.text(source)
    stream = S.json_line_stream(spark, source, READING_JSON_SCHEMA, "growing_lines", corrupt_col="_corrupt")
    S.start_sinks(stream, model, FEATS, [READING_KEY], "_corrupt", root, scratch_path(spark, "sinks-ckpt"), available_now=True).awaitTermination()
    key = F.regexp_extract("_corrupt", f'"{READING_KEY}":([0-9]+)', 1).cast("long")
    return S.committed(spark, root, "scored").select(READING_KEY, F.lit("scored").alias("sink")).unionByName(
        S.committed(spark, root, "broken").select(key.alias(READING_KEY), F.lit("broken").alias("sink")))
