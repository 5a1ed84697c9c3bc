"""Mixing sources to target weights, in DataFrame operations only.

1. Every row gets a hash-random key (md5 of seed, epoch-free and row key), so a rerun draws the same mix.
2. Within a source the keys are range-sorted: the key's leading bits are its range, as hash keys are uniform; a source
   is cut into as many ranges as its row count asks for, so a source with a third of all rows is many small groups.
3. Running sums inside a range plus the totals of the ranges before it are the distributed prefix sums.
4. The source's budget is cut exactly: whole epochs first, then rows in key order until the budget is reached; the
   row in which it is reached is taken in part.

Defined results: null or blank text has size 0 and nothing is taken of it; null sources are one source, last in order;
rows that agree in everything share one place in the order and are told apart by their count; a source of size 0 has
target 0; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.common import DOCUMENT_COLUMNS, WORD, as_documents, documents, pick, query, written

ROWS_PER_RANGE = 512
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, n_rows) -> the same with ``target``: ``share`` of all sizes dealt by weight, no target
    above ``max_epochs`` sources' sizes, the excess dealt again by weight among the rest.

    Sources that hit their limit do so in the order of limit / weight, so the fixed point is one running sum over
    the sources in that order. The table has one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                            ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_limit = Window.orderBy((F.col("_cap") / F.col("_w")), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = (s.withColumn("_total", F.sum("source_size").over(every) * F.lit(float(share)))
         .withColumn("_caps", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
         .withColumn("_left", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    s = s.withColumn("_full", (F.col("_total") - F.col("_caps")) * F.col("_w") >= F.col("_cap") * F.col("_left"))
    s = (s.withColumn("_over", F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(every))
         .withColumn("_free", F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(every)))
    level = (F.col("_total") - F.col("_over")) / F.when(F.col("_free") > 0, F.col("_free")).otherwise(1.0)
    return s.select("source", "source_size", "n_rows",
                    F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(F.col("_cap"), level * F.col("_w"))).alias("target"))


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", size: Column | None = None,
        weights: tuple = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """key, size, source_size, target, taken: how many words the mix takes of each row, repeats counted."""
    rows = pick(df, key=key, source=source, text=text).select(
        "key", "source", (words_in(F.col("text")) if size is None else size).alias("size"))
    rows = written(rows.withColumn("_draw", F.conv(F.substring(F.md5(F.concat(
        F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("~")))), 1, 15), 16, 10).cast("long")), "mix-sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    plan = written(targets(per_source, weights, share, max_epochs), "mix-targets")
    per = plan.select(F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"),
                      "source_size", "target", F.ceil(F.col("n_rows") / ROWS_PER_RANGE).alias("_ranges"))
    keyed = rows.select("key", "size", "_draw", F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"))
    keyed = keyed.join(per, ["_none", "_source"]).withColumn(
        "_range", F.floor(F.col("_draw") / F.lit(float(16 ** 15)) * F.col("_ranges")).cast("long"))
    group = ["_none", "_source"]
    totals = keyed.groupBy(*group, "_range").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_range").orderBy("_draw", F.col("key").asc_nulls_last(), "size").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(totals, [*group, "_range"])
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("_before") - F.col("_inside")
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest))
    return placed.select(F.col("key").alias(key), "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(df: DataFrame, **options) -> DataFrame:
    """The mix as rows: a document comes once per epoch that takes it, in full; the one document of a source in
    which the budget is reached comes in full as well if at least half of it is taken, else not, so texts stay
    whole and each source ends within half a document of its target."""
    # rows are told apart by identifier, source and text; rows that agree in all of these share what they take evenly
    digest = F.md5(F.coalesce("text", F.lit("")))
    docs = as_documents(df).withColumn("_row", F.struct("doc_id", "source", digest.alias("text")))
    parts = mix(docs, key="_row", **options).where(F.col("taken") > 0).select(
        "_row", F.floor(F.col("taken") / F.col("size") + F.lit(0.5)).cast("int").alias("_n"))
    parts = parts.groupBy("_row").agg(F.round(F.avg("_n")).cast("int").alias("_n")).where(F.col("_n") > 0)
    return docs.join(parts, docs["_row"].eqNullSafe(parts["_row"])).select(
        *DOCUMENT_COLUMNS, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy")).drop("_copy")


ORACLE = r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '~'))[1:15] AS draw FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS w,
             source_size * 2.0::DOUBLE AS cap FROM p),
o AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total,
             coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
             sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST
                                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM w),
f AS (SELECT *, (total - caps) * w >= cap * rest AS is_full FROM o),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE
        least(cap, (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())
                   / greatest(sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (), 1) * w) END AS target FROM f),
b AS (SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
             coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY draw, s.doc_id
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken FROM e
"""


@query("op2_mix_sources", ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))
