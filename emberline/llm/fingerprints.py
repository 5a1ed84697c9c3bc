"""Document fingerprints by consistent weighted sampling over word pairs.

Terms are pairs of neighbouring lower-cased words (a text of one word has that word), weighted by how often they come. The
share of equal samples in two fingerprints estimates their generalised Jaccard similarity.

``with_edits`` also fingerprints, for each document, its text with the last half replaced by the beginning of the next
document in ascending order of the key. Spark's range partitioning puts the rows in order; a task streams through its
range and looks one row ahead, so it holds a few batches whatever the range holds. Only the last row of a range lacks its
next document: it is written aside with the number of its range, as is the first text of each range, and the two are
joined by range number (two rows a range). The text crosses the network once and the work is linear in the rows.

Defined results: null text is empty; two empty fingerprints are alike (1), an empty and another are not (0); rows that
repeat a key are ordered by a hash of their text, then by text (so a repeated key is no single range); rows without a
key stand in no order, so they have no edited text (nulls) and are not shuffled; with a single document its next
document is itself; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm import icws
from emberline.llm.word_hashes import mix64
from emberline.llm.common import Growing, Numbering, documents, pick, query, text_slices, written

SAMPLES = 64
SEED = 3
ROWS_PER_RANGE = 65_536
CHARS_PER_RANGE = 16_000_000
_SECOND = np.uint64(0x9FB21C651E98DF25)


class Terms:
    """Texts -> term hashes and weights; remembers the hashes of the words it has met."""

    def __init__(self, limit: int = 500_000) -> None:
        self.limit = limit
        self.numbers, self.hashes = Numbering(), Growing(np.uint64)

    def words(self, text: str) -> np.ndarray:
        if len(self.numbers) > self.limit:
            self.numbers, self.hashes = Numbering(), Growing(np.uint64)
        at = self.numbers.numbers(text.lower().split())
        if fresh := self.numbers.fresh():
            self.hashes.add(np.fromiter(map(xxhash.xxh3_64_intdigest, fresh), np.uint64, len(fresh)))
        return self.hashes[at]

    def pairs(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct terms and how often each comes."""
        h = self.words(text)
        if len(h) > 1:
            h = mix64(h[:-1] * _SECOND + h[1:])
        h = np.sort(h)
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]]))
        return h[first], np.diff(np.append(first, len(h)))


def fingerprint(texts: list[str], terms: Terms, sampler: icws.Sampler) -> np.ndarray:
    """(texts, samples) uint16."""
    sets = [terms.pairs(t) for t in texts]
    cuts = np.cumsum([0, *(len(t) for t, _ in sets)])
    every = np.concatenate([*(t for t, _ in sets), np.zeros(0, np.uint64)])
    times = np.concatenate([*(n for _, n in sets), np.zeros(0, np.int64)])
    # a grows smaller with the weight: weight 1 for all terms, and those that repeat once more with their true weights
    out = sampler.smallest(every, None, cuts)
    if len(many := np.flatnonzero(times > 1)):
        np.minimum(out, sampler.smallest(every[many], np.log(times[many]), np.searchsorted(many, cuts)), out=out)
    return icws.fold16(out)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def edited(text: str, after: str) -> str:
    """The last floor(n / 2) characters replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


MEASURES = {"n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(),
            "near_edited": pa.float64(), "near_next": pa.float64()}


def measured(keys: pa.Array, texts: list[str], after: list[str] | None, draws: icws.Sampler, terms: Terms) -> Iterator[pa.RecordBatch]:
    """key and MEASURES of the texts, each followed by its text in ``after`` (None: by none)."""
    def hexes(prints: np.ndarray) -> list[str]:
        return [x.astype(">u2").tobytes().hex() for x in prints]

    for lo in range(0, len(texts), 32):
        t = texts[lo:lo + 32]
        if after is None:
            parts = [[None] * len(t), hexes(fingerprint(t, terms, draws)), *([[None] * len(t)] * 3)]
        else:
            nxt = after[lo:lo + 32]
            e = [edited(x, y) for x, y in zip(t, nxt)]
            a, b, c = (fingerprint(x, terms, draws) for x in (t, e, nxt[-1:]))
            c = np.concatenate([a[1:], c]) if nxt[:-1] == t[1:] else fingerprint(nxt, terms, draws)
            parts = [[hashlib.sha256(x.encode()).hexdigest() for x in e], hexes(a), hexes(b), alike(a, b).tolist(), alike(a, c).tolist()]
        cols = [pa.array(x, kind) for x, kind in zip([[len(x) for x in t], *parts], MEASURES.values())]
        yield pa.RecordBatch.from_arrays([keys.slice(lo, len(t)), *cols], names=["key", *MEASURES])


def with_edits(df: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES, rows_per_range: int = ROWS_PER_RANGE,
               chars_per_range: int = CHARS_PER_RANGE) -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited, near_next."""
    rows = pick(df, key=key, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    known, order = rows.where(F.col("key").isNotNull()), ("key", "draw", "text")
    n = known.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    ranges = max(1, -(-n["rows"] // rows_per_range), -(-n["chars"] // chars_per_range))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, draws, terms = TaskContext.get().partitionId(), icws.Sampler(samples, SEED), Terms()
        held: tuple[pa.Array, str] | None = None  # the last row so far: its next document is yet to come

        def out(done: pa.RecordBatch, head: str | None = None, last: str | None = None) -> pa.RecordBatch:
            more = [[part] * len(done), [head] * len(done), [last] * len(done)]
            return pa.RecordBatch.from_arrays([*done.columns, *(pa.array(c, k) for c, k in zip(more, (pa.int32(), pa.string(), pa.string())))],
                                              names=["key", *MEASURES, "part", "head", "last"])

        def edge(at: pa.Array, **texts: str) -> pa.RecordBatch:
            return out(pa.RecordBatch.from_arrays([at, *(pa.nulls(1, k) for k in MEASURES.values())], names=["key", *MEASURES]), **texts)

        for batch, texts in text_slices(batches):
            keys = batch.column("key")
            if held is None:
                yield edge(keys.slice(0, 1), head=texts[0])
            else:
                keys, texts = pa.concat_arrays([held[0], keys]), [held[1], *texts]
            for done in measured(keys.slice(0, len(texts) - 1), texts[:-1], texts[1:], draws, terms):
                yield out(done)
            held = keys.slice(len(texts) - 1), texts[-1]
        if held is not None:
            yield edge(held[0], last=held[1])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws, terms = icws.Sampler(samples, SEED), Terms()
        for batch in batches:
            yield from measured(batch.column("key"), batch.column("text").to_pylist(), batch.column("head").to_pylist(), draws, terms)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws, terms = icws.Sampler(samples, SEED), Terms()
        for batch, texts in text_slices(batches):
            yield from measured(batch.column("key"), texts, None, draws, terms)

    ordered = known.withColumn("draw", F.xxhash64("text")).repartitionByRange(ranges, "key", "draw").sortWithinPartitions(*order)
    done = written(ordered.mapInArrow(stream, f"{schema}, part int, head string, last string"), "fingerprints")
    heads = done.where(F.col("head").isNotNull()).select(F.col("part").alias("follower"), "head")
    whole = Window.orderBy("part")  # a number a range
    numbers = done.where(F.col("last").isNotNull()).select("part").withColumn("follower", F.coalesce(
        F.lead("part").over(whole), F.min("part").over(whole)))
    lasts = done.where(F.col("last").isNotNull()).select("part", "key", F.col("last").alias("text"))
    tails = lasts.join(numbers, "part").join(heads, "follower").select("key", "text", "head").mapInArrow(joined, schema)
    rest = rows.where(F.col("key").isNull()).mapInArrow(alone, schema)
    inner = done.where(F.col("n_chars").isNotNull()).select("key", *MEASURES)
    return inner.unionByName(tails).unionByName(rest).withColumnRenamed("key", key)


@query("op3_fingerprints")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(documents(spark, sf_dir))
