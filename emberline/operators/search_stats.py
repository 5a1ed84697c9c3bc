"""Search-history analytics (F15, F17, H2-H4) over a table ``(iter, agent, value)``.

Rows are first reduced to one row per iteration (partial aggregation, so a hot iteration is
combined map-side); running bests are then windows over the per-iteration table, whose size is the
number of iterations, not the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_iteration(df: DataFrame, iter_col: str = "iter", agent_col: str = "agent",
                  value_col: str = "value") -> DataFrame:
    """(iter, n, mean, std, best_value, best_agent, worst_value, worst_agent); ties: smaller agent."""
    return df.groupBy(F.col(iter_col).alias("iter")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value_col).alias("mean"),
        F.stddev_samp(value_col).alias("std"),
        F.max(F.struct(F.col(value_col).alias("v"), (-F.col(agent_col)).alias("na"))).alias("_b"),
        F.min(F.struct(F.col(value_col).alias("v"), F.col(agent_col).alias("a"))).alias("_w"),
    ).select("iter", "n", "mean", "std",
             F.col("_b.v").alias("best_value"), (-F.col("_b.na")).alias("best_agent"),
             F.col("_w.v").alias("worst_value"), F.col("_w.a").alias("worst_agent"))


def trace_stats(df: DataFrame, **kw) -> DataFrame:
    """mean and sample std of the agents' values per iteration."""
    return per_iteration(df, **kw).select("iter", "n", "mean", "std")


def best_so_far(df: DataFrame, **kw) -> DataFrame:
    """H3: per iteration the generation best (``actual``) and the global best so far; a later value
    replaces the global only when strictly greater (so ties keep the earlier iteration)."""
    it = per_iteration(df, **kw)
    w = Window.orderBy("iter").rowsBetween(Window.unboundedPreceding, 0)
    g = F.max(F.struct(F.col("best_value").alias("v"), (-F.col("iter")).alias("ni"),
                       (-F.col("best_agent")).alias("na"))).over(w)
    return it.select("iter", F.col("best_value").alias("actual"), g.alias("_g")).select(
        "iter", "actual", F.col("_g.v").alias("global_value"), (-F.col("_g.ni")).alias("global_iter"),
        (-F.col("_g.na")).alias("global_agent"))


def best_worst_memory(df: DataFrame, compat_enemy_init: bool = False, **kw) -> DataFrame:
    """H2: food = best value seen so far (an older best survives a lower new best, a tie goes to the newer);
    enemy = worst so far (an older worst survives a higher new worst, a tie goes to the newer). ``compat_enemy_init`` seeds the enemy with the
    first generation's *best*, as the reference does."""
    it = per_iteration(df, **kw)
    w = Window.orderBy("iter").rowsBetween(Window.unboundedPreceding, 0)
    food = F.max(F.struct(F.col("best_value").alias("v"), F.col("iter").alias("i"), F.col("best_agent").alias("a"))).over(w)
    worst_v = F.col("worst_value")
    worst_a = F.col("worst_agent")
    if compat_enemy_init:
        first = F.col("iter") == F.min("iter").over(Window.partitionBy(F.lit(1)))
        worst_v = F.when(first, F.col("best_value")).otherwise(worst_v)
        worst_a = F.when(first, F.col("best_agent")).otherwise(worst_a)
    it = it.withColumn("_wv", worst_v).withColumn("_wa", worst_a)
    enemy = F.min(F.struct(F.col("_wv").alias("v"), (-F.col("iter")).alias("i"), F.col("_wa").alias("a"))).over(w)
    return it.select("iter", food.alias("_f"), enemy.alias("_e")).select(
        "iter", F.col("_f.v").alias("food_value"), F.col("_f.a").alias("food_agent"),
        F.col("_e.v").alias("enemy_value"), F.col("_e.a").alias("enemy_agent"))


def convergence(df: DataFrame, **kw) -> DataFrame:
    """H4: iteration, global best, generation best (actual), mean, std -- the series behind the
    reference's charts."""
    it = per_iteration(df, **kw)
    w = Window.orderBy("iter").rowsBetween(Window.unboundedPreceding, 0)
    return it.select("iter", F.max("best_value").over(w).alias("global_value"),
                     F.col("best_value").alias("actual"), "mean", "std")


def repeat_avg(df: DataFrame, run_col: str = "run", iter_col: str = "iter", value_col: str = "value") -> DataFrame:
    """per (run, iteration) the convergence columns, averaged over the runs that have the iteration."""
    per = df.groupBy(F.col(run_col).alias("_run"), F.col(iter_col).alias("iter")).agg(
        F.max(value_col).alias("actual"), F.avg(value_col).alias("mean"), F.stddev_samp(value_col).alias("std"))
    w = Window.partitionBy("_run").orderBy("iter").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("global_value", F.max("actual").over(w))
    return per.groupBy("iter").agg(
        F.avg("global_value").alias("avg_global"), F.avg("actual").alias("avg_actual"),
        F.avg("mean").alias("avg_mean"), F.avg("std").alias("avg_std"), F.count(F.lit(1)).alias("n_runs"))
