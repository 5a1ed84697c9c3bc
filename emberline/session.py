"""Session construction and shared-storage helpers.

Scratch data (CSV/JSON round trips, saved models, stream checkpoints, lineage cuts)
always goes below ``spark.checkpoint.dir``: on a cluster that is the shared folder
the cluster names; only when it is unset (local tests) do we create one.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "emberline",
                  driver_memory: str = "16g") -> SparkSession:
    """Local session for tests and benchmarks; on a cluster use the cluster's own builder."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; a local one is made only when unset and the master is local."""
    path = spark.conf.get(_CKPT_KEY, None)
    if not path:
        path = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = path.get() if path.isDefined() else None
    if not path and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="emberline-ckpt-")
        spark.conf.set(_CKPT_KEY, path)
    sc_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not sc_dir.isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


_SHIPPED: set = set()
_SHIP_LOCK = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make ``emberline`` importable in Python workers (what ``--py-files`` does at submit time):
    the package is zipped once on the driver and added to the SparkContext, which copies it to every
    executor. Needed by the Arrow-batched operators whose task code lives in the package."""
    sc = spark.sparkContext
    key = sc.applicationId
    with _SHIP_LOCK:
        if key in _SHIPPED:
            return
        pkg_dir = os.path.dirname(os.path.abspath(__file__))
        fd, zpath = tempfile.mkstemp(prefix="emberline-", suffix=".zip")
        os.close(fd)
        with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as zf:
            for root, _, files in os.walk(pkg_dir):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(root, f)
                        zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
        sc.addPyFile(zpath)
        _SHIPPED.add(key)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path in the shared scratch area (never a machine-local temp folder)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/emberline-scratch/{name}-{uuid.uuid4().hex[:12]}"


def stored(df, name: str):
    """The rows written once to the shared scratch folder as Parquet and read back: a lost executor costs a read, and
    what reads them keeps column pruning, pushdown and statistics."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(table_path(sf_dir, name))
