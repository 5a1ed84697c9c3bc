"""Model fitting, save/load, and stream = batch."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from emberline import fixtures as fx
from emberline.operators import prepare as P
from emberline.plans import catalog_ml as CM
from emberline.plans import models as E
from emberline.schema import READING_FEATURES, READING_KEY

import __spark_entry__ as ENTRY


def test_entry_report(spark):
    df = ENTRY.entry(spark)
    rows = {(r["metric"], r["threshold"]): r["value"] for r in df.collect()}
    assert ("weighted_f1", None) in rows and ("auc_roc", None) in rows
    assert 0.0 <= rows[("auc_roc", None)] <= 1.0


def test_stream_equals_batch(spark):
    s = CM.q_stream_score(spark, SF_SMALL)
    train, test = CM._split(spark, SF_SMALL)
    b = P.score_extract(CM._fit(train).transform(test)).select(READING_KEY, "prediction", "score")
    assert s.count() == b.count()
    assert s.exceptAll(b).count() == 0
    alerts = CM.q_stream_alerts(spark, SF_SMALL)
    assert alerts.where(F.col("prediction") != 1.0).count() == 0
    assert alerts.count() == b.where(F.col("prediction") == 1.0).count()


def test_model_roundtrip_equals_fit(spark):
    a = CM.q_model_roundtrip(spark, SF_SMALL)
    train, test = CM._split(spark, SF_SMALL)
    b = P.score_extract(CM._fit(train).transform(test)).select(READING_KEY, "prediction", "score")
    assert a.exceptAll(b).count() == 0


def test_cv_manual_and_reduce(spark):
    train, _ = CM._split(spark, SF_SMALL)
    table, res = E.cv_manual(train, READING_FEATURES, READING_KEY, 5, k=3)
    assert table.count() == 3
    avg = E.cv_reduce(table, "avg").first()["metric"]
    mx = E.cv_reduce(table, "max").first()["metric"]
    assert avg <= mx + 1e-12


def _made_rows(spark, n=400):
    x = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)).cast("double").alias(c) for i, c in enumerate(("a", "b"))]
    return spark.range(0, n, 1, 4).select("id", *x).withColumn("label", (F.col("a") + F.col("b") / 4 > 600).cast("double"))


def test_cross_validation_equals_sparks(spark):
    """cv_select gives the averages, deviations and best forest of Spark's CrossValidator on the same folds."""
    from pyspark.ml.tuning import CrossValidator

    rows = _made_rows(spark)
    cvm = E.cv_select(rows, ["a", "b"], "id", [3, 6], ["gini"], k=3)
    rf, pipe = E.pipeline(["a", "b"])
    folded = P.kfold_assign(rows, "id", 3).persist()
    plain = CrossValidator(estimator=pipe, estimatorParamMaps=E.param_grid(rf, [3, 6]), evaluator=E.evaluator(), numFolds=3, foldCol="fold").fit(folded)
    folded.unpersist()
    assert cvm.avgMetrics == plain.avgMetrics and cvm.stdMetrics == plain.stdMetrics
    assert cvm.bestModel.stages[-1].toDebugString.split("\n")[1:] == plain.bestModel.stages[-1].toDebugString.split("\n")[1:]


def test_cross_validation_keeps_one_table(spark, monkeypatch):
    """while a fold is evaluated, the folded table is all that is kept in memory, no copies of the fold's rows."""
    kept, evaluate = [], E.MulticlassClassificationEvaluator.evaluate

    def counted(self, df, *params):
        value = evaluate(self, df, *params)
        kept.append(spark.sparkContext._jsc.getPersistentRDDs().size())
        return value

    monkeypatch.setattr(E.MulticlassClassificationEvaluator, "evaluate", counted)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    E.cv_select(_made_rows(spark), ["a", "b"], "id", [3], k=3, parallelism=1)
    assert kept == [before + 1] * 3


def test_cross_validation_refuses_empty_folds(spark):
    import pytest

    with pytest.raises(ValueError, match="empty"):
        E.cv_select(_made_rows(spark, 1), ["a", "b"], "id", [3], k=3)


def test_stream_restart_exactly_once(spark):
    """A5 re-aimed: the query stops after the first files, restarts on the same checkpoint when more
    files arrive, and every reading is scored exactly once."""
    from emberline.schema import READING_JSON_SCHEMA
    from emberline.session import scratch_path
    from emberline.sources import files as io
    from emberline.streaming import scoring as S

    train, test = CM._split(spark, SF_SMALL)
    model = CM._fit(train)
    rows = test.select(READING_KEY, *READING_FEATURES, "label")
    src, sink, ckpt = scratch_path(spark, "in"), scratch_path(spark, "out"), scratch_path(spark, "ck")
    first, second = P.train_test(rows, READING_KEY, 0.5, seed="arrival")  # two arrival batches
    io.write_json_lines(first, src + "/part1")
    stream = S.json_line_stream(spark, src + "/*", READING_JSON_SCHEMA)
    S.start(S.score_stream(stream, model, [READING_KEY]), sink, ckpt, available_now=True).awaitTermination()
    n1 = spark.read.parquet(sink).count()
    assert n1 == first.count()
    io.write_json_lines(second, src + "/part2")
    stream = S.json_line_stream(spark, src + "/*", READING_JSON_SCHEMA)
    S.start(S.score_stream(stream, model, [READING_KEY]), sink, ckpt, available_now=True).awaitTermination()
    out = spark.read.parquet(sink)
    assert out.count() == rows.count()
    assert out.select(READING_KEY).distinct().count() == rows.count()


def test_stream_survives_broken_lines(spark, tmp_path):
    """Every good line is scored once and every broken one lands in the side sink, also after a restart."""
    from emberline.schema import READING_JSON_SCHEMA
    from emberline.session import scratch_path
    from emberline.streaming import scoring as S

    train, test = CM._split(spark, SF_SMALL)
    model = CM._fit(train)
    lines = [r["j"] for r in test.select(F.to_json(F.struct(READING_KEY, *READING_FEATURES, "label")).alias("j")).limit(20).collect()]
    (tmp_path / "in").mkdir()
    sink, side, ckpt = (scratch_path(spark, n) for n in ("good", "bad", "ck"))
    for part, text in enumerate(["\n".join(lines[:10] + ['{"o_orderkey": 1, "n_it']), "\n".join(lines[10:] + ["not json"])]):
        (tmp_path / "in" / f"p{part}.json").write_text(text)
        stream = S.json_line_stream(spark, str(tmp_path / "in"), READING_JSON_SCHEMA, corrupt_col="_corrupt")
        S.start_split(stream, model, READING_FEATURES, [READING_KEY], "_corrupt", sink, side, ckpt, available_now=True).awaitTermination()
    assert spark.read.parquet(sink).select(READING_KEY).distinct().count() == spark.read.parquet(sink).count() == 20
    assert {r["_corrupt"] for r in spark.read.parquet(side).collect()} == {'{"o_orderkey": 1, "n_it', "not json"}
