"""Micro-batch scoring of JSON reading lines with Structured Streaming.

The reference's socket receiver becomes a pluggable streaming source (files here, a socket or Kafka
source by configuration); restart and exactly-once output come from the checkpoint location, which
must live in shared storage. Rows are parsed with a declared schema (no per-batch inference, which
would reorder columns), scored by a fitted pipeline and written to a sink.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.features import scaling_model
from ..operators.prepare import score_extract
from ..sources.growing_lines import register as register_lines


def json_line_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json",
                     max_files_per_trigger: int | None = None, corrupt_col: str | None = None, **options) -> DataFrame:
    """A4: JSON-lines stream with a declared schema. ``fmt="growing_lines"`` (files that are appended to),
    ``"socket"`` and ``"kafka"`` read a ``value`` text column that is parsed with the same schema. With ``corrupt_col`` a line that does not parse is
    kept there as text (its other columns are null), for ``start_split``."""
    if corrupt_col:
        schema = T.StructType([*schema.fields, T.StructField(corrupt_col, T.StringType(), True)])
        options["columnNameOfCorruptRecord"] = corrupt_col
    if fmt == "json":
        r = spark.readStream.schema(schema).options(**options)
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", max_files_per_trigger)
        return r.json(path)
    parse = {k: options.pop(k) for k in ("columnNameOfCorruptRecord",) if k in options}
    if fmt == "growing_lines":
        register_lines(spark)
    if path:
        options["path"] = path
    raw = spark.readStream.format(fmt).options(**options).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema, parse).alias("_j")).select("_j.*")


def start_split(stream: DataFrame, model: PipelineModel, input_cols: Sequence[str], keep: Sequence[str], corrupt_col: str,
                sink_path: str, side_path: str, checkpoint: str, available_now: bool = False,
                processing_time: str = "3 seconds") -> StreamingQuery:
    """Scores the good lines into ``sink_path`` and writes lines that did not parse, or that lack a feature, to
    ``side_path``: a broken line never stops the stream. One folder per epoch, overwritten on replay, so a
    restart on the same checkpoint neither loses nor repeats rows."""
    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        batch = batch.persist()
        try:
            whole = F.col(corrupt_col).isNull()
            for c in input_cols:
                whole = whole & F.col(c).isNotNull()
            good = score_stream(batch.where(whole).drop(corrupt_col), model, keep)
            good.write.mode("overwrite").parquet(f"{sink_path}/epoch={epoch_id}")
            batch.where(~whole).write.mode("overwrite").parquet(f"{side_path}/epoch={epoch_id}")
        finally:
            batch.unpersist()

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


SINKS = ("raw", "scored", "broken")


def start_sinks(stream: DataFrame, model: PipelineModel, input_cols: Sequence[str], keep: Sequence[str], corrupt_col: str, root: str,
                checkpoint: str, alerts_only: bool = False, available_now: bool = False, processing_time: str = "3 seconds") -> StreamingQuery:
    """Every micro-batch goes to three sinks below ``root``: ``raw`` as it came, ``scored`` the scored good lines (or the
    alerts among them), ``broken`` lines that did not parse or lack a feature. Each writes one folder an epoch; the epoch's row in
    ``epochs`` comes last and commits all three together. A batch that is run again overwrites its folders, and ``committed`` reads
    committed epochs only, so readers see every line once in every sink whatever happened in between."""
    def per_batch(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            whole = F.col(corrupt_col).isNull()
            for c in input_cols:
                whole = whole & F.col(c).isNotNull()
            parts = {"raw": batch, "scored": score_stream(batch.where(whole).drop(corrupt_col), model, keep, alerts_only), "broken": batch.where(~whole)}
            for name in SINKS:
                parts[name].write.mode("overwrite").parquet(f"{root}/{name}/epoch={epoch}")
            about = batch.agg(F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum((~whole).cast("long")), F.lit(0)).alias("broken"))
            about.coalesce(1).write.mode("overwrite").parquet(f"{root}/epochs/epoch={epoch}")
        finally:
            batch.unpersist()

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


def committed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One sink's rows of all committed epochs, with the epoch."""
    epochs = spark.read.parquet(f"{root}/epochs").select("epoch").distinct()
    return spark.read.parquet(f"{root}/{name}").join(epochs, "epoch", "left_semi")


def score_stream(stream: DataFrame, model: PipelineModel, keep: Sequence[str], alerts_only: bool = False) -> DataFrame:
    """Parse -> score -> (optional) alert filter ``prediction = 1``. Stateless, so it runs as a
    plain streaming projection (no per-batch driver work)."""
    out = score_extract(model.transform(stream)).select(*keep, "prediction", "score")
    return out.where(F.col("prediction") == 1.0) if alerts_only else out


def start(scored: DataFrame, sink_path: str, checkpoint: str, fmt: str = "parquet",
          processing_time: str | None = "3 seconds", available_now: bool = False) -> StreamingQuery:
    """Start the query with a 3-second processing-time trigger (or ``availableNow`` in tests). ``fmt`` is any sink of the
    caller's; ``"console"`` prints every batch and takes no path (A9)."""
    w = scored.writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start() if fmt == "console" else w.start(sink_path)


def rescale_batches(stream: DataFrame, model: PipelineModel, input_cols: Sequence[str], keep: Sequence[str],
                    sink_path: str, checkpoint: str, available_now: bool = False,
                    processing_time: str = "3 seconds") -> StreamingQuery:
    """Compat path (D4 on a stream): each micro-batch is scaled by its own statistics before the
    forest scores it, as the reference does. Not deterministic under re-batching; the empty-batch
    guard (B6) skips the statistics job when a batch has no rows."""
    forest_stage = model.stages[-1]

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        batch = batch.persist()  # read three times: guard, statistics, scoring
        try:
            if batch.isEmpty():
                return
            scal = scaling_model(batch, input_cols)
            out = score_extract(forest_stage.transform(scal.transform(batch)))
            # one folder per epoch, overwritten on replay: a re-run batch does not duplicate rows
            out.select(*keep, "prediction", "score").write.mode("overwrite").parquet(f"{sink_path}/epoch={epoch_id}")
        finally:
            batch.unpersist()

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()
