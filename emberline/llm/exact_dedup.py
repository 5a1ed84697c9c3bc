"""Exact dedup as a streaming job with keyed state, in DataFrame operations only.

A file stream folds every row into RocksDB state keyed by the digest of its normalised text, without watermark, so no
state ever expires. The state keeps the digest, the stable identifier of the row that stays (the smallest), that row's
content locator (file and row in it) and the group's size. Each micro-batch writes the groups it touched; the last
state of a digest is its largest count. Then every row that hit a known digest is held byte for byte against the text
that the locator names; rows that differ (a digest collision) are grouped by their full bytes instead.

A group of copies may hold a third of all rows: the state has one row for it (partial sums before the shuffle), and the
byte check deals the group over as many salted pieces as its size asks for, with one copy of the kept text for each.

Defined results: null text counts as empty, and all empty texts are copies of one another; null identifiers sort last;
rows that repeat an identifier are told apart by their locator, so one row of a group stays; an empty table gives none.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import GAP, pick, query, written
from emberline.session import scratch_path

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS_PER_PIECE = 256


def sha256_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State on disk while the query runs, without space set apart in advance (4 MB a partition); the session's own
    settings come back afterwards."""
    own = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _rows(raw: DataFrame, key: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    raw = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    rows = pick(raw, id=key, text=text, file="_file", row="_row").select(
        "id", "file", "row", F.regexp_replace(F.coalesce("text", F.lit("")), GAP, " ").alias("norm"))
    return rows.withColumn("digest", digest(F.col("norm")))


def fold_stream(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text",
                digest: Callable[[Column], Column] = sha256_of, files_per_batch: int = 100_000) -> DataFrame:
    """Runs the stream over all files that are there; digest, keep (missing, id, file, row) and group_size."""
    path = path.rstrip("/")
    several = f"{path[:-1]}[{path[-1]}]"  # as a pattern, so that it may be one file or a folder of files
    log, marks = scratch_path(spark, "dedup-state"), scratch_path(spark, "dedup-stream")
    source = (spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
              .parquet(several))
    state = _rows(source, key, text, digest).groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "file", "row")).alias("keep"),
        F.count(F.lit(1)).alias("group_size"))
    state.limit(0)  # schema only
    spark.createDataFrame([], state.schema).write.parquet(f"{log}/epoch=-1")

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/epoch={epoch}")

    with rocksdb(spark):
        run = (state.writeStream.outputMode("update").option("checkpointLocation", marks)
               .trigger(availableNow=True).foreachBatch(save).start())
        run.awaitTermination()
    return (spark.read.schema(state.schema).parquet(f"{log}/epoch=*").groupBy("digest")
            .agg(F.min("keep").alias("keep"), F.max("group_size").alias("group_size")))


def dedup(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text",
          digest: Callable[[Column], Column] = sha256_of, files_per_batch: int = 100_000) -> DataFrame:
    """One row per input row: id, digest, keep_id, group_size, kept, and its locator (file, row)."""
    groups = written(fold_stream(spark, path, key, text, digest, files_per_batch), "dedup-groups")
    rows = _rows(spark.read.parquet(path), key, text, digest)
    # byte check of the hits: the kept text, named by its locator, is dealt to each piece of its group
    many = groups.where(F.col("group_size") > 1).select(
        "digest", "keep", F.ceil(F.col("group_size") / ROWS_PER_PIECE).cast("int").alias("pieces"))
    hits = rows.join(many, "digest").select(
        "digest", "id", "file", "row", "norm", "pieces",
        ((F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))).alias("keeper"),
        F.pmod(F.xxhash64("file", "row"), F.col("pieces")).cast("int").alias("piece"))
    hits = written(hits, "dedup-hits")
    kept = hits.where("keeper").select("digest", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"),
                                       F.col("norm").alias("kept_norm"))
    differ = hits.where(~F.col("keeper")).join(kept, ["digest", "piece"]).where(F.col("norm") != F.col("kept_norm"))
    differ = written(differ.select("digest", "id", "file", "row", "norm"), "dedup-differ")
    # collided rows: groups of their own by full bytes; the digest's group loses them
    again = differ.groupBy("digest", "norm").agg(
        F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "file", "row")).alias("own_keep"), F.count(F.lit(1)).alias("own_size"))
    moved = differ.join(again, ["digest", "norm"]).select("file", "row", "own_keep", "own_size")
    lost = differ.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
    out = (rows.drop("norm").join(groups, "digest").join(small_or(lost), "digest", "left").join(small_or(moved), ["file", "row"], "left"))
    keep = F.coalesce("own_keep", "keep")
    return out.select("id", "digest", keep["id"].alias("keep_id"),
                      F.coalesce("own_size", F.col("group_size") - F.coalesce("lost", F.lit(0))).cast("long").alias("group_size"),
                      ((F.col("file") == keep["file"]) & (F.col("row") == keep["row"])).alias("kept"), "file", "row")


def small_or(df: DataFrame) -> DataFrame:
    from emberline.llm.common import small

    return small(df, 100_000)


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256 FROM n JOIN g ON n.norm = g.norm
"""


@query("op6_exact_dedup", ORACLE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
