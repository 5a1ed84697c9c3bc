"""The sensor-CSV jobs on a sensor-format file derived from the test tables."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from emberline import fixtures as fx
from emberline.plans import jobs
from emberline.schema import SENSOR_SCHEMA
from emberline.session import scratch_path
from emberline.sources import files as io


def _sensor_csv(spark):
    r = fx.readings(spark, SF_SMALL)
    cols = [F.col("o_orderkey").alias("index"), F.lit(0).cast("bigint").alias("UTC")]
    src = ["sum_qty", "sum_price", "n_items", "avg_disc", "avg_tax"]
    for i, f in enumerate(SENSOR_SCHEMA.fields[2:14]):
        c = F.col(src[i % len(src)]) * (1 + i)
        cols.append(c.cast(f.dataType).alias(f"h{i}"))  # header names differ: binding is positional
    cols += [F.col("n_items").cast("int").alias("CNT"), F.col("label").cast("int").alias("alarm")]
    path = scratch_path(spark, "sensor_csv")
    io.write_csv(r.select(*cols), path)
    return path, r.count()


def test_split_and_v1_report(spark):
    src, n = _sensor_csv(spark)
    tr, te = scratch_path(spark, "train_csv"), scratch_path(spark, "test_csv")
    jobs.split(spark, src, tr, te)
    a, b = jobs.load_sensor_csv(spark, tr), jobs.load_sensor_csv(spark, te)
    assert a.count() + b.count() == n
    assert "label" in a.columns and "CNT" not in a.columns and "UTC" not in a.columns
    assert len(jobs.sensor_features(a)) == 12
    rep = {r["metric"]: r["value"] for r in jobs.run_v1(spark, tr, te, 5).collect() if r["threshold"] is None}
    assert 0.0 <= rep["auc_roc"] <= 1.0 and 0.0 <= rep["weighted_f1"] <= 1.0
