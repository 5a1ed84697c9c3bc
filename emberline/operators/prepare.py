"""Column preparation, class counts, hash splits and folds."""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash01


def prepare_features(df: DataFrame, label_source: str, label: str = "label",
                     drop: Iterable[str] = ()) -> DataFrame:
    """Rename the alarm column to ``label``, cast it to double in place, drop id/time/counter columns."""
    out = df.withColumnRenamed(label_source, label).withColumn(label, F.col(label).cast("double"))
    drop = [c for c in drop if c in out.columns]
    return out.drop(*drop) if drop else out


def feature_columns(df: DataFrame, label: str = "label", exclude: Iterable[str] = ()) -> list[str]:
    """Every column except the label (and explicit exclusions), in frame order."""
    ex = set(exclude) | {label}
    return [c for c in df.columns if c not in ex]


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n) class counts."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def hash_split(df: DataFrame, key: str | Sequence[str], train_fraction: float = 0.8, seed: str = "split",
               col: str = "split") -> DataFrame:
    """Add ``split`` = 'train' | 'test' from a deterministic draw of the row key.

    Unlike ``randomSplit`` the assignment does not depend on partitioning or on a sort, so a
    re-executed task (lost executor) reproduces exactly the same split.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return df.withColumn(col, F.when(hash01(seed, *keys) < train_fraction, F.lit("train")).otherwise(F.lit("test")))


def train_test(df: DataFrame, key: str | Sequence[str], train_fraction: float = 0.8,
               seed: str = "split") -> tuple[DataFrame, DataFrame]:
    s = hash_split(df, key, train_fraction, seed, col="_split")
    return (s.where(F.col("_split") == "train").drop("_split"),
            s.where(F.col("_split") == "test").drop("_split"))


def kfold_assign(df: DataFrame, key: str | Sequence[str], k: int = 5, seed: str = "fold",
                 col: str = "fold") -> DataFrame:
    """Add ``fold`` in [0, k): k equal-probability folds from a draw of the row key."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.withColumn(col, F.floor(hash01(seed, *keys) * k).cast("int"))


def kfold_train_counts(df_with_fold: DataFrame, fold_col: str = "fold") -> DataFrame:
    """(fold, n_train, n_valid): size of the leave-one-fold-out training set of every fold.

    One grouped count; the complement comes from the total, no fold union is materialised.
    """
    per = df_with_fold.groupBy(fold_col).agg(F.count(F.lit(1)).alias("n_valid"))
    tot = per.agg(F.sum("n_valid").alias("_tot"))
    return per.crossJoin(F.broadcast(tot)).select(
        F.col(fold_col).alias("fold"), (F.col("_tot") - F.col("n_valid")).alias("n_train"), "n_valid")


def union_folds(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL of frames by column name (the reference's ``reduce(_ union _)``)."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def score_extract(predictions: DataFrame, probability_col: str = "probability",
                  out: str = "score", positive_index: int = 1) -> DataFrame:
    """Positive-class score from Spark ML's probability vector, JVM-side (no row lambdas)."""
    from pyspark.ml.functions import vector_to_array

    return predictions.withColumn(out, vector_to_array(F.col(probability_col))[positive_index])
