"""Feature vectors and scaling.

Spark's StandardScaler defaults are kept: divide by the sample standard deviation (n-1), no mean
centring, a zero-deviation column maps to 0. The SQL twin is ``x / stddev_samp(x)``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assembler(input_cols: Sequence[str], output_col: str = "featureVector",
              handle_invalid: str = "error") -> VectorAssembler:
    return VectorAssembler(inputCols=list(input_cols), outputCol=output_col, handleInvalid=handle_invalid)


def scaler(input_col: str = "featureVector", output_col: str = "features",
           with_mean: bool = False, with_std: bool = True) -> StandardScaler:
    return StandardScaler(inputCol=input_col, outputCol=output_col, withMean=with_mean, withStd=with_std)


def assemble(df: DataFrame, input_cols: Sequence[str], output_col: str = "featureVector",
             handle_invalid: str = "error", as_array: bool = False) -> DataFrame:
    """Vector column in input order; ``handle_invalid`` = error | skip | keep for nulls."""
    out = assembler(input_cols, output_col, handle_invalid).transform(df)
    if as_array:
        out = out.withColumn(output_col, vector_to_array(F.col(output_col)))
    return out


def scaling_model(fit_on: DataFrame, input_cols: Sequence[str], vector_col: str = "featureVector",
                  output_col: str = "features") -> PipelineModel:
    """Assembler + scaler fitted on ``fit_on`` (one statistics job: a single tree-aggregate pass)."""
    return Pipeline(stages=[assembler(input_cols, vector_col), scaler(vector_col, output_col)]).fit(fit_on)


def standardize(df: DataFrame, input_cols: Sequence[str], fit_on: DataFrame | None = None,
                output_col: str = "features", as_array: bool = False) -> DataFrame:
    """Scale ``df`` with statistics of ``fit_on`` (the training rows); ``fit_on=None`` fits
    on ``df`` itself -- the reference's ``processData`` behaviour (``rescale="self"``)."""
    model = scaling_model(df if fit_on is None else fit_on, input_cols, output_col=output_col)
    out = model.transform(df).drop("featureVector")
    if as_array:
        out = out.withColumn(output_col, vector_to_array(F.col(output_col)))
    return out


def standardize_sql_columns(df: DataFrame, input_cols: Sequence[str], fit_on: DataFrame | None = None,
                            suffix: str = "_z") -> DataFrame:
    """Column-wise twin of :func:`standardize` in plain aggregates: one global aggregate row
    (bounded, broadcast) joined to every row."""
    src = df if fit_on is None else fit_on
    stats = src.agg(*[F.stddev_samp(c).alias(f"_sd_{c}") for c in input_cols])
    j = df.crossJoin(F.broadcast(stats))
    return j.select(
        *df.columns,
        *[F.when(F.coalesce(F.col(f"_sd_{c}"), F.lit(0.0)) == 0, F.lit(0.0))
          .otherwise(F.col(c) / F.col(f"_sd_{c}")).alias(f"{c}{suffix}") for c in input_cols],
    )


def standardize_by_batch(df: DataFrame, ts_col: str, value_cols: Sequence[str],
                         batch: str = "3 seconds", suffix: str = "_z") -> DataFrame:
    """D4 batch twin: scale each value by the sample std of its processing batch, approximated by the
    event-time window ``batch`` the row falls in.

    Statistics are a grouped aggregate per window (partial aggregation before the shuffle, so a
    window holding a large share of rows is still reduced map-side), joined back on the window
    start; AQE's skew join splits a hot window on the row side."""
    keyed = df.withColumn("_batch", F.window(F.col(ts_col), batch).start)
    stats = keyed.groupBy("_batch").agg(*[F.stddev_samp(c).alias(f"_sd_{c}") for c in value_cols])
    j = keyed.join(stats, "_batch")
    return j.select(
        *df.columns,
        *[F.when(F.coalesce(F.col(f"_sd_{c}"), F.lit(0.0)) == 0, F.lit(0.0))
          .otherwise(F.col(c) / F.col(f"_sd_{c}")).alias(f"{c}{suffix}") for c in value_cols],
    )
