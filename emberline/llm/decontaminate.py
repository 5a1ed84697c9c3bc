"""Benchmark decontamination with a broadcast hash set of the normalised n-grams of test items.

A-Z are lower-cased, words are runs of ASCII letters, digits and anything beyond ASCII. A window is ``window`` consecutive
words of an item (an item of fewer words is one window). Every task hashes all words of a slice at once, combines them
to window hashes by running sums, looks these up in the set of item windows and compares the words of every hit with the
item's own, so that equal hashes of different words do no harm. A document word inside any occurrence is hit.

The set is broadcast when the benchmark is measured to have at most ``BOUND`` bytes. A larger one is dealt by Spark into
blocks of about that size, each written as one file in the shared folder; every task then maps the blocks one after
another, so memory stays bounded whatever the benchmark. Documents are read once either way and nothing is shuffled.

``scan`` gives the hits and their spans, ``remove_spans`` and ``remove_documents`` act on them.

Defined results: null and empty texts have no words; items without words have no window; items that share a window are
all named, rows that repeat an item's identifier are one item; windows of an item without identifier hit but name none;
other columns of the documents pass through unchanged; an empty benchmark hits nothing, an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import documents, pick, query, text_slices, written
from emberline.llm.elias_fano import mapped, save
from emberline.llm.word_hashes import mix64, powers, token_spans
from emberline.session import scratch_path

WINDOW = 10
BOUND = 16 << 20  # bytes of item texts that one block of the set holds
SLICE = 2_000_000  # characters that are looked up at a time
U64 = np.uint64
GAP = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])
PLAIN = bytes(32 if GAP[b] else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on (there are k - 1 fewer of them)."""
    if len(h) < k:
        return np.zeros(0, U64)
    up, down = powers(len(h) + 1)
    run = np.concatenate([[U64(0)], np.cumsum(h * up[:len(h)])])
    return mix64((run[k:] - run[:-k]) * down[:len(h) - k + 1] + U64(k))


# ---------------------------------------------------------------- the set of item windows

def build_set(ids: list, texts: list, window: int) -> dict[str, np.ndarray]:
    """Arrays of one block: distinct windows ordered by hash, their place in the normalised words, the items of each."""
    kinds: dict[bytes, int] = {}
    hashes, lengths, ends, owners, body, at = [], [], [], [], [], 0
    names = sorted({str(i) for i in ids if i is not None})
    number = {name: i for i, name in enumerate(names)}
    for ident, text in zip(ids, texts):
        words = words_of((text or "").encode("utf-8", "surrogatepass"))
        if not words:
            continue
        plain = b" ".join(words)
        h, starts, stops = token_spans(np.frombuffer(plain, np.uint8), GAP)
        k = min(window, len(words))
        for i, w in enumerate(window_hashes(h, k).tolist()):
            lo, hi = int(starts[i]), int(stops[i + k - 1])
            kind = kinds.setdefault(plain[lo:hi], len(kinds))
            if kind == len(hashes):
                hashes.append(w)
                lengths.append(k)
                ends.append((at + lo, at + hi))
            if ident is not None:
                owners.append((kind, number[str(ident)]))
        body.append(plain)
        at += len(plain)
    order = np.argsort(np.array(hashes, U64), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    owns = np.unique(np.array(owners, np.int64).reshape(-1, 2), axis=0)
    owns[:, 0] = place[owns[:, 0]]
    owns = owns[np.lexsort((owns[:, 1], owns[:, 0]))]
    name_bytes = [n.encode("utf-8", "surrogatepass") for n in names]
    h = np.array(hashes, U64)[order]
    bits = min(24, max(16, (16 * len(h)).bit_length()))
    sieve = np.zeros(1 << bits, bool)
    sieve[(h >> U64(64 - bits)).astype(np.int64)] = True
    return {"hash": h, "k": np.array(lengths, np.int64)[order], "span": np.array(ends, np.int64).reshape(-1, 2)[order],
            "words": np.frombuffer(b"".join(body), np.uint8), "sieve": sieve,
            "owner_at": np.searchsorted(owns[:, 0], np.arange(len(order) + 1)), "owner": owns[:, 1],
            "name_at": np.cumsum([0, *map(len, name_bytes)]), "names": np.frombuffer(b"".join(name_bytes), np.uint8)}


def item_set(benchmark: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW, bound: int = BOUND) -> list:
    """The blocks of the set: the arrays themselves if the benchmark is small, else paths of their files."""
    items = pick(benchmark, key=key, text=text).select(F.col("key").cast("string").alias("key"), "text")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    if size <= bound:
        rows = items.collect()  # at most ``bound`` bytes, as just measured
        return [build_set([r["key"] for r in rows], [r["text"] for r in rows], window)]
    folder = scratch_path(items.sparkSession, "test-windows")
    blocks = -(-size // bound)

    def build(rows: pa.Table) -> pa.Table:
        return pa.table({"path": [save(folder, "windows", build_set(rows["key"].to_pylist(), rows["text"].to_pylist(), window))]})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("key", "text"), F.lit(blocks)))
    return sorted(r["path"] for r in written(dealt.groupBy("block").applyInArrow(build, "path string"), "test-window-files").collect())


# ---------------------------------------------------------------- the scan

class Hits:
    """Occurrences of item windows in a slice of texts."""

    def __init__(self, texts: list[str], blocks: list) -> None:
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.raw = b"\n".join(parts)
        self.at = np.cumsum([0, *(len(p) + 1 for p in parts)])
        h, self.starts, self.ends = token_spans(np.frombuffer(self.raw, np.uint8), GAP)
        self.cuts = np.searchsorted(self.starts, self.at)
        self.n_words = np.diff(self.cuts)
        steps = np.zeros(len(h) + 1, np.int64)
        self.items: dict[int, set] = {}
        known: dict[int, np.ndarray] = {}
        for block in blocks:
            arrays = mapped(block) if isinstance(block, str) else block
            for k in np.unique(arrays["k"]).tolist():
                if k not in known:
                    known[k] = window_hashes(h, k)
                self._look(arrays, k, known[k], steps)
        self.hit = np.cumsum(steps[:-1]) > 0
        self.n_hit = np.diff(np.concatenate([[0], np.cumsum(self.hit)])[self.cuts])

    def _look(self, a: dict, k: int, w: np.ndarray, steps: np.ndarray) -> None:
        shift = U64(64 - (len(a["sieve"]).bit_length() - 1))
        i = np.flatnonzero(a["sieve"][(w >> shift).astype(np.int64)])
        first = np.searchsorted(a["hash"], w[i])
        first[first == len(a["hash"])] = 0
        same = a["hash"][first] == w[i]
        i, first = i[same], first[same]
        text = np.searchsorted(self.cuts, i, side="right") - 1
        inside = i + k <= self.cuts[text + 1]
        for start, kind, t in zip(i[inside].tolist(), first[inside].tolist(), text[inside].tolist()):
            said = b" ".join(words_of(self.raw[self.starts[start]:self.ends[start + k - 1]]))
            while kind < len(a["hash"]) and a["hash"][kind] == w[start]:
                lo, hi = a["span"][kind]
                if a["words"][lo:hi].tobytes() == said:
                    steps[start] += 1
                    steps[start + k] -= 1
                    own = a["owner"][a["owner_at"][kind]:a["owner_at"][kind + 1]].tolist()
                    self.items.setdefault(t, set()).update(a["names"][a["name_at"][o]:a["name_at"][o + 1]].tobytes().decode("utf-8", "surrogatepass") for o in own)
                    break
                kind += 1

    def spans(self, t: int) -> list[tuple[int, int]]:
        """Bytes of the text from the first to the last word of each run of hit words."""
        lo, hi = self.cuts[t], self.cuts[t + 1]
        edge = np.diff(np.concatenate([[0], self.hit[lo:hi], [0]]).astype(np.int8))
        a, b = np.flatnonzero(edge == 1) + lo, np.flatnonzero(edge == -1) + lo - 1
        return list(zip((self.starts[a] - self.at[t]).tolist(), (self.ends[b] - self.at[t]).tolist()))


def _each(spark: SparkSession, blocks: list):
    """texts -> Hits, with the blocks shared by all tasks of an executor."""
    shared = spark.sparkContext.broadcast(blocks)
    return lambda texts: Hits(texts, shared.value)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
         window: int = WINDOW, bound: int = BOUND) -> DataFrame:
    """key, n_words, n_hit, items (identifiers as sorted strings) and spans (start, end in characters) of every row."""
    rows = pick(docs, key=key, text=text)
    look = _each(docs.sparkSession, item_set(benchmark, item, item_text, window, bound))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, SLICE):
            hits = look(texts)
            items, spans = [[] for _ in texts], [[] for _ in texts]
            for t in np.flatnonzero(hits.n_hit).tolist():
                items[t] = sorted(hits.items[t])
                body = texts[t].encode("utf-8", "surrogatepass")
                done, chars = 0, 0
                for lo, hi in hits.spans(t):
                    start = chars + len(body[done:lo].decode("utf-8", "surrogatepass"))
                    done, chars = hi, start + len(body[lo:hi].decode("utf-8", "surrogatepass"))
                    spans[t].append({"start": start, "end": chars})
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(hits.n_words.astype(np.int64)), pa.array(hits.n_hit.astype(np.int64)),
                                              pa.array(items, pa.list_(pa.string())), pa.array(spans, SPANS)],
                                             names=["key", "n_words", "n_hit", "items", "spans"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>").withColumnRenamed("key", key)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", whole: bool = False, window: int = WINDOW, bound: int = BOUND, **item) -> DataFrame:
    """All columns of the documents, the text without its spans of hit words; with ``whole``, documents with a hit go
    instead. A text without a hit is returned as it is, null included."""
    look = _each(docs.sparkSession, item_set(benchmark, window=window, bound=bound, **item))
    names = docs.columns
    at = names.index(text)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, SLICE, f"c{at}"):
            hits = look(texts)
            if whole:
                batch = batch.filter(pa.array(hits.n_hit == 0))
            elif hits.n_hit.any():
                out = batch.column(at).to_pylist()
                for t in np.flatnonzero(hits.n_hit).tolist():
                    body, done, kept = texts[t].encode("utf-8", "surrogatepass"), 0, []
                    for lo, hi in hits.spans(t):
                        kept.append(body[done:lo])
                        done = hi
                    out[t] = b"".join([*kept, body[done:]]).decode("utf-8", "surrogatepass")
                batch = batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))
            yield batch

    return plain.mapInArrow(run, plain.schema).toDF(*names)


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a hit."""
    return remove_spans(docs, benchmark, whole=True, **options)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw))),
h AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, win)),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
"""


@query("op11_decontaminate", ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
