"""Connected components of an edge table by repeated minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) edges -> (node, label): the smallest node of each component. Each round gives every node the smallest
    label among itself and its neighbours, then the label of its label; both halve the distances to the smallest
    node, so rounds grow with the logarithm of the longest path. Each round is a written table."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{name}-edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), f"{name}-0")
    for k in range(1, 200):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("l"))
        low = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "l").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        new = low.join(up, "low", "left").select("node", F.col("label").alias("was"), F.least("low", F.coalesce("jump", "low")).alias("label"))
        new = written(new, f"{name}-{k}")
        if not new.where(F.col("was") != F.col("label")).limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")
    raise RuntimeError("labels did not settle")
