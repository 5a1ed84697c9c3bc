"""End-to-end jobs on sensor CSV files -- the flows of the reference's entry points.

* ``split``   : read the sensor CSV (positional schema) and write an 80/20 train/test pair (hash split);
* ``v1``      : pipeline + CV on train, evaluation report on test (``--rescale self`` reproduces the
                reference's test-frame rescaling);
* ``v3``      : manual k-fold with SMOTE inside the folds, best fold's model, report, save the model;
* ``search``  : population search over the forest size, history written as JSON lines;
* ``v2``      : SMOTE on the scaled training rows, CV of 112 trees, report;
* ``score``   : score a CSV of readings with a saved model;
* ``stream``  : score JSON reading lines with a saved model (3-second trigger): raw, scored (alerts) and broken-line sinks.

Run as ``python -m emberline.plans.jobs <job> ...``; every job also exists as a function.
"""

from __future__ import annotations

import argparse
import json
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import metrics as M
from ..operators import prepare as P
from ..schema import SENSOR_DROP, SENSOR_LABEL, SENSOR_SCHEMA
from ..session import stored
from ..sources import files as io
from ..streaming import scoring as S
from . import models as E
from . import search as H1

KEY = "index"


def load_sensor_csv(spark: SparkSession, path: str) -> DataFrame:
    """Sensor CSV -> (index, 12 features, label double). ``index`` stays as the row key (used by the
    hash split and the folds) and is never a feature; UTC and CNT are dropped."""
    raw = io.read_csv(spark, path, SENSOR_SCHEMA)
    return P.prepare_features(raw, SENSOR_LABEL, drop=[c for c in SENSOR_DROP if c != KEY])


def sensor_features(df: DataFrame) -> list[str]:
    return P.feature_columns(df, exclude=[KEY])


def split(spark: SparkSession, src: str, train_out: str, test_out: str, fraction: float = 0.8) -> None:
    raw = io.read_csv(spark, src, SENSOR_SCHEMA)
    s = P.hash_split(raw, KEY, fraction, col="_split")
    io.write_csv(s.where(F.col("_split") == "train").drop("_split"), train_out)
    io.write_csv(s.where(F.col("_split") == "test").drop("_split"), test_out)


def run_v1(spark: SparkSession, train_path: str, test_path: str, n_trees: int = 20, rescale: str = "train") -> DataFrame:
    train = stored(load_sensor_csv(spark, train_path), "train")
    test = load_sensor_csv(spark, test_path)
    _, pred, _ = E.train_plain(train, test, sensor_features(train), KEY, n_trees, rescale=rescale)
    return M.evaluate_report(pred, "score", "label", "prediction")


def run_v3(spark: SparkSession, train_path: str, test_path: str, n_trees: int = 20, oversample: bool = True,
           model_out: str | None = None) -> DataFrame:
    train = stored(load_sensor_csv(spark, train_path), "train")
    test = load_sensor_csv(spark, test_path)
    best, pred, _ = E.train_kfold(train, test, sensor_features(train), KEY, n_trees, oversample=oversample)
    if model_out:
        io.save_model(best, model_out)
    return M.evaluate_report(pred, "score", "label", "prediction")


def run_search(spark: SparkSession, train_path: str, out: str, n_agents: int = 20, iterations: int = 5,
               lb: Sequence[float] = (10.0, 0.0), ub: Sequence[float] = (150.0, 0.0), weights=H1.schedule, log: str | None = None) -> DataFrame:
    """Result file of the search, a line a generation. ``log``: a search cut off is continued from this folder."""
    train = stored(load_sensor_csv(spark, train_path), "train")
    history, summary = H1.population_search(train, sensor_features(train), KEY, n_agents, iterations, lb, ub, weights=weights, log=log)
    io.write_json_lines(H1.result_lines(history, summary), out)
    return history


def run_v2(spark: SparkSession, train_path: str, test_path: str, n_trees: int = E.SAMPLE_TREES, model_out: str | None = None) -> DataFrame:
    train = stored(load_sensor_csv(spark, train_path), "train")
    best, pred, _ = E.train_oversampled(train, load_sensor_csv(spark, test_path), sensor_features(train), KEY, n_trees)
    if model_out:
        io.save_model(best, model_out)
    return M.evaluate_report(pred, "score", "label", "prediction")


def run_score(spark: SparkSession, model_path: str, source: str, out: str) -> DataFrame:
    """Score a table of readings with a saved model: (index, prediction, score, label) as Parquet."""
    E.score_batch(io.load_model(model_path), load_sensor_csv(spark, source), keep=[KEY]).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def run_stream(spark: SparkSession, model_path: str, source: str | None, sink: str, checkpoint: str, alerts_only: bool = True,
               available_now: bool = False, fmt: str = "json", sink_format: str = "parquet", **options):
    """Scores reading lines. With the Parquet sink every batch goes to ``sink``/raw, /scored and /broken, committed together, so broken
    lines are kept and never stop the job; ``sink_format="console"`` prints the scored good lines instead. ``fmt`` and
    ``options``: any line source (json files, growing_lines, socket, kafka)."""
    model = io.load_model(model_path)
    features = list(model.stages[0].getInputCols())
    schema = T.StructType([T.StructField(KEY, T.LongType())] + [f for f in SENSOR_SCHEMA.fields if f.name in features])
    stream = S.json_line_stream(spark, source, schema, fmt, corrupt_col="_corrupt", **options)
    if sink_format != "console":
        return S.start_sinks(stream, model, features, [KEY], "_corrupt", sink, checkpoint, alerts_only, available_now)
    good = stream.where(F.col("_corrupt").isNull()).dropna(subset=features).drop("_corrupt")
    return S.start(S.score_stream(good, model, [KEY], alerts_only), sink, checkpoint, "console", available_now=available_now)


def main(argv: Sequence[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="emberline")
    sub = ap.add_subparsers(dest="job", required=True)
    a = sub.add_parser("split"); a.add_argument("src"); a.add_argument("train_out"); a.add_argument("test_out")
    for name in ("v1", "v2", "v3"):
        b = sub.add_parser(name); b.add_argument("train"); b.add_argument("test")
        b.add_argument("--trees", type=int, default=E.SAMPLE_TREES if name == "v2" else 20)
        if name == "v2":
            b.add_argument("--model-out")
        elif name == "v1":
            b.add_argument("--rescale", default="train", choices=["train", "self"])
        else:
            b.add_argument("--no-sample", action="store_true"); b.add_argument("--model-out")
    c = sub.add_parser("search"); c.add_argument("train"); c.add_argument("out")
    c.add_argument("--agents", type=int, default=20); c.add_argument("--iterations", type=int, default=5)
    c.add_argument("--log")
    e = sub.add_parser("score"); e.add_argument("model"); e.add_argument("source"); e.add_argument("out")
    d = sub.add_parser("stream"); d.add_argument("--format", default="json"); d.add_argument("--console", action="store_true")
    d.add_argument("--option", action="append", default=[], help="name=value for the source")
    d.add_argument("model"); d.add_argument("source"); d.add_argument("sink")
    d.add_argument("checkpoint"); d.add_argument("--all-rows", action="store_true")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName(f"emberline-{args.job}").getOrCreate()
    from ..session import ensure_checkpoint_dir, ship_package

    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if args.job == "split":
        split(spark, args.src, args.train_out, args.test_out)
    elif args.job in ("v1", "v2", "v3"):
        rep = (run_v1(spark, args.train, args.test, args.trees, args.rescale) if args.job == "v1"
               else run_v2(spark, args.train, args.test, args.trees, args.model_out) if args.job == "v2"
               else run_v3(spark, args.train, args.test, args.trees, not args.no_sample, args.model_out))
        for r in rep.collect():  # the report is a handful of rows
            print(json.dumps(r.asDict()))
    elif args.job == "search":
        run_search(spark, args.train, args.out, args.agents, args.iterations, log=args.log)
    elif args.job == "score":
        run_score(spark, args.model, args.source, args.out)
    else:
        run_stream(spark, args.model, args.source, args.sink, args.checkpoint, not args.all_rows, fmt=args.format,
                   sink_format="console" if args.console else "parquet", **dict(o.split("=", 1) for o in args.option)).awaitTermination()


if __name__ == "__main__":
    main()
