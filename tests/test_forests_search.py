"""Prefix forests, node tables and the population search with its generation log."""

import json
import os

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import SF_SMALL
from emberline import fixtures as fx
from emberline.operators import search_stats
from emberline.operators.features import scaling_model
from emberline.operators.prepare import kfold_assign
from emberline.plans import forests, models, search
from emberline.schema import READING_FEATURES as FEATS
from emberline.schema import READING_KEY as KEY
from emberline.session import scratch_path, ship_package, stored


@pytest.fixture(scope="module")
def train(spark):
    ship_package(spark)
    return stored(fx.readings(spark, SF_SMALL), "readings")


def counts(df):
    return {(r["label"], r["prediction"]): r["n"] for r in df.groupBy("label", "prediction").agg(F.sum("n").alias("n")).collect()}


@pytest.fixture(scope="module")
def fitted(train):
    scaled = scaling_model(train, FEATS).transform(train)
    return scaled, models.forest(12).fit(scaled).setLeafCol("leaf")


def test_all_trees_predict_as_the_model(fitted):
    scaled, model = fitted
    scored = model.transform(scaled)
    votes = forests.leaf_votes(forests.node_table(model))
    found = forests.prefix_confusion(scored, votes, [1, 5, 12])
    own = scored.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    assert counts(found.where("num_trees = 12")) == counts(own)
    assert found.groupBy("num_trees").agg(F.sum("n").alias("n")).where(F.col("n") != scaled.count()).count() == 0


def test_walk_equals_the_model(fitted):
    scaled, model = fitted
    rows = model.transform(scaled).select(KEY, vector_to_array("features").alias("f"), F.col("prediction").alias("p"), vector_to_array("probability")[1].alias("s"))
    walked = forests.walk_scores(rows, F.col("f"), forests.node_table(model))
    assert walked.count() == rows.count() and walked.where((F.col("p") != F.col("prediction")) | (F.abs(F.col("s") - F.col("score")) > 1e-12)).count() == 0


def test_prefixes_score_like_separate_forests(spark, train):
    """Another forest of the same size scores within 0.05 of its prefix (the spread between seeds is of that order)."""
    table = forests.prefix_fitness(train, FEATS, KEY, [5, 10, 20], k=3, metric="f1")
    got = {r["num_trees"]: r["value"] for r in table.collect()}
    assert sorted(got) == [5, 10, 20]
    for n in (5, 20):
        separate, _ = models.cv_manual(train, FEATS, KEY, n, k=3, metric="f1")
        assert abs(models.cv_reduce(separate).first()["metric"] - got[n]) < 0.05
    folded = kfold_assign(train, KEY, 3)
    assert folded.groupBy("fold").count().count() == 3


def test_metrics_of_confusions_equal_the_evaluator(fitted):
    scaled, model = fitted
    scored = model.transform(scaled)
    conf = scored.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.lit(1))
    for metric in ("f1", "accuracy", "fMeasureByLabel", "precisionByLabel", "recallByLabel"):
        want = models.evaluator(metric, 1.0).evaluate(scored)
        assert abs(forests.metric_of(conf, ["g"], metric, 1.0).first()["metric"] - want) < 1e-12


def test_candidates_of_any_number_share_the_fits(spark, train):
    cands = spark.createDataFrame([(i, 3 + i % 4, ("gini", "entropy")[i % 2]) for i in range(50)], "candidate_id int, num_trees int, impurity string")
    got = models.candidate_eval(cands, train, FEATS, KEY, k=2)
    assert got.count() == 50 and got.where("value is null").count() == 0
    assert got.groupBy("num_trees", "impurity").agg(F.countDistinct("value").alias("n")).where("n > 1").count() == 0
    assert models.candidate_eval(cands.limit(0), train, FEATS, KEY).count() == 0


OPTIONS = {"n_agents": 6, "iterations": 5, "lb": (3.0, 0.0), "ub": (12.0, 1.0), "k": 2}


def plain(history):
    return sorted(tuple(map(str, r)) for r in history.collect())


def test_search_continues_after_any_generation(spark, train, monkeypatch):
    space = search.search_space(OPTIONS["lb"], OPTIONS["ub"])
    assert space == (list(range(3, 13)), ["entropy", "gini"])
    table = stored(forests.prefix_fitness(train, FEATS, KEY, *space, k=2), "fitness")
    whole, summary = search.population_search(train, FEATS, KEY, fitness=table, **OPTIONS)
    folder = scratch_path(spark, "cut-search")
    add, calls = search.GenerationLog.add, []

    def breaks(self, i, agents):
        calls.append(i)
        if i == 3:
            raise RuntimeError("cut")
        return add(self, i, agents)

    monkeypatch.setattr(search.GenerationLog, "add", breaks)
    with pytest.raises(RuntimeError, match="cut"):
        search.population_search(train, FEATS, KEY, fitness=table, log=folder, **OPTIONS)
    monkeypatch.setattr(search.GenerationLog, "add", add)
    made = []
    monkeypatch.setattr(search, "prefix_fitness", lambda *a, **k: made.append(1))
    again, again_summary = search.population_search(train, FEATS, KEY, log=folder, **OPTIONS)
    assert calls == [0, 1, 2, 3] and not made
    assert plain(again) == plain(whole) and plain(again_summary) == plain(summary)
    with pytest.raises(ValueError, match="another search"):
        search.population_search(train, FEATS, KEY, log=folder, **(OPTIONS | {"n_agents": 7}))


def test_search_summary_and_result_lines(spark, train):
    table = spark.createDataFrame([(n, i, 0.5 + n / 1000 - (i == "gini") / 100) for n in range(3, 13) for i in ("gini", "entropy")], "num_trees int, impurity string, value double")
    history, summary = search.population_search(train, FEATS, KEY, fitness=table, weights={"w": 0.5, "s": 0.1, "a": 0.1, "c": 0.7, "f": 1.0, "e": 0.1}, **OPTIONS)
    rows = {r["iter"]: r for r in summary.collect()}
    by = {}
    for r in history.collect():
        by.setdefault(r["iter"], []).append(r)
        assert 3 <= r["x"][0] <= 12 and 0 <= r["x"][1] <= 1 and r["num_trees"] == int(r["x"][0] + 0.5)
    assert sorted(rows) == sorted(by) == list(range(5)) and all(len(v) == 6 for v in by.values())
    best = None
    for i in range(5):
        values = [r["value"] for r in by[i]]
        assert rows[i]["actual"] == max(values) and abs(rows[i]["mean"] - sum(values) / 6) < 1e-12
        best = max(values) if best is None else max(best, max(values))
        assert rows[i]["global_value"] == best
    lines = [json.loads(x) for x in search.result_lines(history, summary).toJSON().collect()]
    assert {x["i"] for x in lines} == {1, 2, 3, 4, 5} and all(len(x["agents"]) == 6 and {"global", "actual", "food", "enemy", "radius", "mean", "std"} <= set(x) for x in lines)


def test_swarm_terms_move_the_agents(spark, train):
    """The first generations have weights for all terms; without them the agents end elsewhere."""
    assert all(search.schedule(1, 5, 0.5)[t] > 0 for t in "sacfe")
    table = spark.createDataFrame([(n, "gini", 0.5 + n / 1000) for n in range(10, 31)], "num_trees int, impurity string, value double")
    run = lambda w: search.population_search(train, FEATS, KEY, n_agents=8, iterations=2, ub=(30.0, 0.0), fitness=table, weights=w)[0].where("iter = 1")
    base = {"w": 0.01, "s": 0.0, "a": 0.0, "c": 0.0, "f": 0.0, "e": 0.0}
    still = plain(run(base))
    for term in "sacfe":
        assert plain(run(base | {term: 0.02})) != still


def test_repeats_have_a_run_each(spark, train):
    runs = search.repeated_search(train, FEATS, KEY, runs=2, n_agents=3, iterations=2, lb=(2.0, 0.0), ub=(5.0, 0.0), k=2)
    assert runs.groupBy("run").count().collect().__len__() == 2
    averages = {r["iter"]: r for r in search_stats.repeat_avg(runs).collect()}
    for i, r in averages.items():
        best = [max(x["value"] for x in runs.where((F.col("run") == run) & (F.col("iter") <= i)).collect()) for run in range(2)]
        assert abs(r["avg_global"] - sum(best) / 2) < 1e-12 and r["n_runs"] == 2
