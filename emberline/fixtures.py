"""Stand-in inputs derived from the test tables (FIXTURES.md), each with its DuckDB twin.

Every fixture is a plain DataFrame plan over the parquet tables, so its cost grows with them and
Catalyst prunes columns / pushes filters into the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import hash01, hash_u32, sql_hash01, sql_hash_u32
from .session import read_table

# fixed values: label rule of the readings stand-in (price per item threshold)
PRICE_PER_ITEM_THRESHOLD = 45000


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, n_items, sum_qty, sum_price, avg_disc, avg_tax, label) per order with lines.

    The aggregate runs before the join (partial aggregation map-side, one shuffle on the key);
    the join to ``orders`` is a semi join that only needs the key column.
    """
    li = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey")
    agg = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).cast("double").alias("n_items"),
        F.sum("l_quantity").alias("_qty"),
        F.sum("l_extendedprice").alias("_price"),
        F.avg("l_discount").alias("_disc"),
        F.avg("l_tax").alias("_tax"),
    )
    # features are rounded to 6 decimals so both engines start every later step from equal inputs
    agg = agg.select(
        "o_orderkey", "n_items",
        F.round("_qty", 6).alias("sum_qty"), F.round("_price", 6).alias("sum_price"),
        F.round("_disc", 6).alias("avg_disc"), F.round("_tax", 6).alias("avg_tax"),
        (F.round("_price", 2) > F.lit(PRICE_PER_ITEM_THRESHOLD) * F.col("n_items")).cast("double").alias("label"),
    )
    return agg.join(orders, "o_orderkey", "left_semi")


READINGS_SQL = f"""
SELECT l_orderkey AS o_orderkey,
       CAST(count(*) AS DOUBLE) AS n_items,
       round(sum(l_quantity), 6) AS sum_qty,
       round(sum(l_extendedprice), 6) AS sum_price,
       round(avg(l_discount), 6) AS avg_disc,
       round(avg(l_tax), 6) AS avg_tax,
       CAST(round(sum(l_extendedprice), 2) > {PRICE_PER_ITEM_THRESHOLD} * count(*) AS DOUBLE) AS label
FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
GROUP BY l_orderkey
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, score, pred): 100 distinct scores, label-correlated, identical in both engines."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    lab = (F.col("o_orderstatus") == "F").cast("int")
    s_int = F.floor(
        (F.lit(60) * hash_u32("7", "o_orderkey") + F.lit(40) * lab * hash_u32("8", "o_orderkey"))
        / F.lit(4294967296)
    )
    return o.select(
        F.col("o_orderkey").alias("id"),
        lab.alias("label"),
        (s_int / F.lit(100.0)).alias("score"),
        (s_int >= 50).cast("int").alias("pred"),
    )


_S_INT = (
    f"floor((60 * {sql_hash_u32('7', 'o_orderkey')} + 40 * CAST(o_orderstatus = 'F' AS INTEGER) * "
    f"{sql_hash_u32('8', 'o_orderkey')}) / 4294967296)"
)
SCORED_SQL = f"""
SELECT o_orderkey AS id,
       CAST(o_orderstatus = 'F' AS INTEGER) AS label,
       {_S_INT} / 100e0 AS score,
       CAST({_S_INT} >= 50 AS INTEGER) AS pred
FROM orders
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, x array<double>, label) from the embeddings table."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")


VECTORS_SQL = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings"

# fixed values: the points stand-in -- radius and coordinate transform of FIXTURES.md
POINT_PRICE_OFFSET = 900.0
POINT_PRICE_SCALE = 20.0


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, id, x array<double>(2), v array<double>(2), value) from the part table."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return p.select(
        F.col("p_brand").alias("group_id"),
        F.col("p_partkey").alias("id"),
        F.array(
            F.col("p_size").cast("double"),
            (F.col("p_retailprice") - POINT_PRICE_OFFSET) / POINT_PRICE_SCALE,
        ).alias("x"),
        F.array(hash01("v0", "p_partkey") * 2 - 1, hash01("v1", "p_partkey") * 2 - 1).alias("v"),
        hash01("value", "p_partkey").alias("value"),
    )


POINTS_SQL = f"""
SELECT p_brand AS group_id, p_partkey AS id,
       [CAST(p_size AS DOUBLE), (p_retailprice - {POINT_PRICE_OFFSET}) / {POINT_PRICE_SCALE}] AS x,
       [{sql_hash01('v0', 'p_partkey')} * 2 - 1, {sql_hash01('v1', 'p_partkey')} * 2 - 1] AS v,
       {sql_hash01('value', 'p_partkey')} AS value
FROM part
"""

TRACE_START = "2024-01-01"


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(iter, agent, value): a search history stand-in from events, one row per (day, event)."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return ev.select(
        F.datediff(F.to_date("ts"), F.lit(TRACE_START).cast("date")).alias("iter"),
        F.col("event_id").alias("agent"),
        F.col("value"),
    )


TRACE_SQL = f"""
SELECT CAST(date_diff('day', DATE '{TRACE_START}', CAST(ts AS DATE)) AS INTEGER) AS iter,
       event_id AS agent, value
FROM events
"""


def trace_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, iter, agent, value): the history stand-in with the event type as the run."""
    ev = read_table(spark, sf_dir, "events").select("event_type", "event_id", "ts", "value")
    return ev.select(F.col("event_type").alias("run"), F.datediff(F.to_date("ts"), F.lit(TRACE_START).cast("date")).alias("iter"),
                     F.col("event_id").alias("agent"), "value")


TRACE_RUNS_SQL = f"""
SELECT event_type AS run, CAST(date_diff('day', DATE '{TRACE_START}', CAST(ts AS DATE)) AS INTEGER) AS iter,
       event_id AS agent, value
FROM events
"""


def reading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, value, props): raw JSON-carrying rows of the events table."""
    return read_table(spark, sf_dir, "events").select("event_id", "ts", "value", "props")


def with_sql(sql_body: str, **ctes: str) -> str:
    """Prefix ``sql_body`` with named CTEs."""
    if not ctes:
        return sql_body
    parts = ",\n".join(f"{name} AS ({body})" for name, body in ctes.items())
    return f"WITH {parts}\n{sql_body}"
