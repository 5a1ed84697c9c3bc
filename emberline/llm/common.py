"""Shared helpers of the training-data operators: clash-free column picks, written tables, checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.session import scratch_path

#: words are runs of anything but space and the ASCII controls 9 to 13
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BROADCAST_ROWS = 500_000
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """``pick(df, out="name")``: the named columns under new names. A column is found by its exact name first,
    then without regard to case, so an extra column that clashes with another in case only does no harm."""
    names = df.columns
    raw = df.toDF(*[f"_c{i}" for i in range(len(names))])
    out = []
    for new, old in columns.items():
        hits = [i for i, n in enumerate(names) if n == old] or [i for i, n in enumerate(names) if n.lower() == old.lower()]
        if not hits:
            raise ValueError(f"no column {old!r} among {names}")
        out.append(F.col(f"_c{hits[0]}").alias(new))
    return raw.select(*out)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def as_documents(df: DataFrame) -> DataFrame:
    return pick(df, **{c: c for c in DOCUMENT_COLUMNS})


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written as Parquet in the shared scratch folder and read back: later steps read it by column,
    and a lost executor costs nothing that came before."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when a count of the (written) table proves that it has at most ``rows`` rows of a few
    bytes; otherwise leave the join to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def id_text(col: str = "doc_id") -> Column:
    return F.col(col).cast("string")


def crc_mod(m: int, col: str = "doc_id") -> Column:
    return F.crc32(id_text(col).cast("binary")) % m


def small_batches(spark: SparkSession) -> None:
    """Python tasks get Arrow batches of about ``BATCH_BYTES`` from here on, unless the session has a bound of its own: 10,000 rows
    of long texts are held several times over, in the JVM's buffers and in each worker."""
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def text_slices(batches: Iterator[Any], chars: int = 2_000_000, text: str = "text") -> Iterator[tuple[Any, list[str]]]:
    """Record batches cut into slices of about ``chars`` characters (one long text may exceed it), with the texts
    as Python strings (null: empty), made slice by slice: bounds the memory of a task whatever the batch size."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, before = 0, 0
        while at < batch.num_rows:
            to = min(int(np.searchsorted(ends, before + chars)) + 1, batch.num_rows)
            part = batch.slice(at, to - at)
            yield part, [t or "" for t in part.column(text).to_pylist()]
            at, before = to, int(ends[to - 1])


def flat_ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(start, start + len)`` of all pairs."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(total)


class Numbering(dict):
    """word -> running number; ``fresh()`` gives the words that have come since the last call."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, word: Any) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def numbers(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def fresh(self) -> list:
        new, self.new = self.new, []
        return new


class Growing:
    """An array that grows at its end without a copy each time; index it like an array."""

    def __init__(self, kind: Any, *shape: int) -> None:
        self.array, self.size = np.zeros((1024, *shape), kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.array):
            larger = np.zeros((2 * (self.size + len(more)), *self.array.shape[1:]), self.array.dtype)
            larger[:self.size] = self.array[:self.size]
            self.array = larger
        self.array[self.size:self.size + len(more)] = more
        self.size += len(more)

    def __getitem__(self, at: Any) -> Any:
        return self.array[at]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    def add(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add
