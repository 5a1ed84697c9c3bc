"""Near-duplicate detection: improved consistent weighted sampling over TF-IDF shingles, banded, then verified.

1. Word document frequencies are counted over all rows, exactly at every size. Words on at least ``COMMON`` of all rows get their own inverse
   document frequency, all others that of the limit, so the table holds at most (words per row) / ``COMMON`` entries and
   may be broadcast at every corpus size. A shingle of five words weighs its count times the mean of its words' values: a
   shingle's own document frequency would be low in proportion to the size of a group of copies, so that in large
   groups the few edited shingles outweighed all others, and near copies of thousands were lost.
2. Each row gets a digest of its words and ``BANDS`` x ``ROWS`` samples; rows of equal digest are one node from here on.
3. Round one: every node of a band's bucket is held against the bucket's first node only, so a bucket with a third of all
   rows costs one pair a node. Pairs are verified by exact weighted Jaccard similarity, in blocks that hold the first
   node's shingles once. The links give components.
4. Round two: buckets whose nodes still lie in different components are completed exactly: nodes outside the bucket's
   largest component are held against all its nodes of other components, in tiles of bounded size. A tile computes all
   its similarities at once, as products of shingle matrices, and returns the links that join components. No link between texts that
   share a band is lost, and no list of pairs is ever made.

Rows meet what their bucket knows (its first node, its components) by (band, part): a bucket has a part for every ``BLOCK``
of its nodes, dealt by the node's hash, so a band that a third of all nodes share is joined in many tasks.

The class of a row is the smallest identifier in its component. Defined results: null text is empty, and texts without
words are copies of one another; texts of fewer than five words are one shingle; rows that repeat an identifier are copies
if their texts are; null identifiers sort last; an empty table gives none. An identifier may be null or repeated, so a row
is found by it and the digest of its text (``mark``), and one row of each class is kept, whatever the identifiers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import icws
from emberline.llm.common import as_documents, documents, flat_ranges, pick, query, small, text_slices, written
from emberline.llm.graph import components
from emberline.llm.word_hashes import mix64, word_hashes

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 4
SEED = 4
COMMON = 1e-3
SPREAD = 0.25
BLOCK = 128
NO_KEY = (1 << 63) - 1  # where an identifier is null
_STEP = np.uint64(0x9FB21C651E98DF25)


def lowered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts (between ASCII white space), and where each text's begin."""
    return word_hashes([t.lower() for t in texts])


def word_weights(docs: DataFrame, text: str = "text", common: float = COMMON, window: int = 3_000_000) -> tuple[np.ndarray, np.ndarray, float]:
    """Hashes of the common words in order, their inverse document frequencies, and the value of all other words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            word, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            return pa.RecordBatch.from_pydict({"word": pa.array(word.view(np.int64)), "n": pa.array(n)})

        for _, texts in text_slices(batches):
            h, cuts = lowered(texts)
            held.extend(np.unique(h[a:b]) for a, b in zip(cuts, cuts[1:]))
            size += len(h)
            if size > window:
                yield out()
                held, size = [], 0
        yield out()

    counts = pick(docs, text=text).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = docs.count()
    limit = max(1.0, common * total)
    found = sorted((r["word"] % (1 << 64), r["n"]) for r in counts.where(F.col("n") >= limit).collect())
    value = lambda n: 1.0 + SPREAD * np.log((total + 1.0) / (n + 1.0)) / np.log((total + 1.0) / (limit + 1.0) + 1.0)
    return np.array([w for w, _ in found], np.uint64), value(np.array([n for _, n in found], float)), float(value(limit))


class Shingles:
    """Texts -> digest, distinct shingle hashes and weights."""

    def __init__(self, words: np.ndarray, values: np.ndarray, other: float) -> None:
        self.words, self.values, self.other = words, values, other

    def __call__(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """Digest of the words, distinct shingles in order, and their weights (count times mean value)."""
        digest, s, one, n = self.counted([text])[0]
        return digest, s, one * n

    def counted(self, texts: list[str]) -> list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        """For each text the same with the weight of one occurrence and the counts apart."""
        h, cuts = lowered(texts)
        v = np.full(len(h), self.other)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            v = np.where(self.words[at] == h, self.values[at], v)
        return [self._of(h[a:b], v[a:b]) for a, b in zip(cuts, cuts[1:])]

    @staticmethod
    def _of(h: np.ndarray, v: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        digest = xxhash.xxh3_128_hexdigest(h.tobytes())
        k = min(WORDS, len(h))
        if not k:
            return digest, h, v, np.zeros(0, np.int64)
        n = len(h) - k + 1
        s, w = np.zeros(n, np.uint64), np.zeros(n)
        for i in range(k):
            s = mix64(s * _STEP + h[i:i + n])
            w += v[i:i + n]
        order = np.argsort(s)
        s, w = s[order], w[order] / k
        first = np.flatnonzero(np.concatenate([np.ones(1, bool), s[1:] != s[:-1]]))
        return digest, s[first], w[first], np.diff(np.append(first, len(s)))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact weighted Jaccard similarity of two (sorted hashes, weights)."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    hit = b[0][at] == a[0]
    both = float(np.minimum(a[1][hit], b[1][at[hit]]).sum())
    return both / (float(a[1].sum()) + float(b[1].sum()) - both)


def similarities(x: list[tuple], y: list[tuple], columns: int = 8192) -> np.ndarray:
    """Exact weighted Jaccard similarities of all (shingles, one, counts) of x with all of y. A shingle's k-th occurrence
    is an element of its own, so what two texts share is a product of 0/1 matrices, taken over blocks of elements."""
    def elements(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(rows)), [int(r[2].sum()) for r in rows])
        h = [np.repeat(r[0], r[2]) for r in rows]
        nth = [flat_ranges(np.zeros(len(r[2]), np.int64), r[2]) for r in rows]
        e = mix64(np.concatenate([*h, np.zeros(0, np.uint64)]) + np.concatenate([*nth, np.zeros(0, np.int64)]).astype(np.uint64) * _STEP)
        return e, owner, np.concatenate([*(np.repeat(r[1], r[2]) for r in rows), np.zeros(0)])

    (ex, ox, wx), (ey, oy, _) = elements(x), elements(y)
    kinds, first = np.unique(ex, return_index=True)
    kinds, weight = kinds[np.isin(kinds, ey)], wx[first][np.isin(kinds, ey)]
    both = np.zeros((len(x), len(y)))
    if len(kinds):
        def placed(e: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(kinds, e), len(kinds) - 1)
            hit = kinds[at] == e
            order = np.argsort(at[hit], kind="stable")
            return at[hit][order], owner[hit][order]

        (ax, ox), (ay, oy) = placed(ex, ox), placed(ey, oy)
        for lo in range(0, len(kinds), columns):
            hi = min(len(kinds), lo + columns)
            m = [np.zeros((len(r), hi - lo), np.float32) for r in (x, y)]
            for part, a, o in ((m[0], ax, ox), (m[1], ay, oy)):
                p, q = np.searchsorted(a, [lo, hi])
                part[o[p:q], a[p:q] - lo] = 1
            m[0] *= weight[lo:hi].astype(np.float32)
            both += m[0] @ m[1].T
    sx, sy = (np.array([float((r[1] * r[2]).sum()) for r in rows]) for rows in (x, y))
    union = sx[:, None] + sy[None, :] - both
    return np.where(union > 0, both / np.maximum(union, 1e-12), 1.0)


def marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, mark): the key as a number and the digest of the text."""
    return pick(docs, key=key, text=text).select(F.coalesce("key", F.lit(NO_KEY)).cast("long").alias("key"), "text", mark_of(F.col("text")).alias("mark"))


def mark_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def signed(docs: DataFrame, model, key: str, text: str) -> DataFrame:
    """key, mark, tag (a number of the row's own), node (digest of the words), bands array<long>; one row per row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, sampler = Shingles(*model.value), icws.Sampler(BANDS * ROWS, SEED)
        for batch, texts in text_slices(batches):
            sets = [(d, s, one * n) for d, s, one, n in shingles.counted(texts)]
            cuts = np.cumsum([0, *(len(s) for _, s, _ in sets)])
            terms = np.concatenate([*(s for _, s, _ in sets), np.zeros(0, np.uint64)])
            logs = np.log(np.concatenate([*(w for _, _, w in sets), np.zeros(0)]))
            x = icws.fold16(sampler.smallest(terms, logs, cuts))
            full = x.astype(np.uint64).reshape(len(texts), BANDS, ROWS)
            band = full[:, :, 0]
            for i in range(1, ROWS):
                band = band << np.uint64(16) | full[:, :, i]
            band = mix64(band + np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP).view(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32()), pa.array(band.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("mark"), batch.column("tag"),
                                              pa.array([d for d, _, _ in sets], pa.string()), flat],
                                             names=["key", "mark", "tag", "node", "bands"])

    rows = marked(docs, key, text).withColumn("tag", F.monotonically_increasing_id())
    return rows.mapInArrow(run, "key long, mark binary, tag long, node string, bands array<long>")


def texts_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """(node, text) of the wanted nodes, each once: the text of the row that stands for it in ``nodes`` (node, key, mark).
    Rows that repeat both key and text are dropped before any join brings texts together."""
    ids = small(written(nodes.select("node", "key", "mark").join(wanted, "node", "left_semi"), f"{name}-ids"))
    found = written(marked(docs, key, text).join(ids, ["key", "mark"]).select("node", "text"), f"{name}-found")
    again = small(written(found.groupBy("node").count().where("count > 1").select("node"), f"{name}-again"))
    once = found.join(again, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))
    return written(found.join(again, "node", "left_anti").unionByName(once), f"{name}-texts")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, model, key: str, text: str, threshold: float, name: str) -> DataFrame:
    """(a, b) node pairs -> those whose texts reach the threshold. The pairs of a node are dealt to blocks; a block gets
    the node's text once and the texts of its partners."""
    # a's partners in blocks of about BLOCK, by the partner's hash
    size = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = pairs.join(size, "a").select("a", "b", "blocks", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"))
    dealt = written(dealt, f"{name}-pairs")
    texts = texts_of(docs, nodes, dealt.select(F.col("a").alias("node")).union(dealt.select(F.col("b").alias("node"))).distinct(), key, text, name)
    firsts = dealt.select("a", "block", F.col("a").alias("node")).distinct().join(texts, "node").select(
        "a", "block", F.lit(None).cast("string").alias("b"), "text")
    others = dealt.select("a", "block", "b", F.col("b").alias("node")).join(texts, "node").select("a", "block", "b", "text")

    def run(table: pa.Table) -> pa.Table:
        shingles = Shingles(*model.value)
        a = table.column("a")[0].as_py()
        found: list[str] = []
        mine = None
        batch = list(zip(table.column("b").to_pylist(), table.column("text").to_pylist()))
        for b, t in batch:
            if b is None and mine is None and (x := shingles(t or ""))[0] == a:
                mine = x[1:]
        for b, t in batch:
            if b is not None and mine is not None and b not in found and (x := shingles(t or ""))[0] == b and similarity(mine, x[1:]) >= threshold:
                found.append(b)
        return pa.table({"a": pa.array([a] * len(found), pa.string()), "b": pa.array(found, pa.string())})

    return written(firsts.unionByName(others).groupBy("a", "block").applyInArrow(run, "a string, b string"), f"{name}-links")


def part_of(node: str, size: Column) -> Column:
    """The part of its bucket (``size`` rows in all) that a node is dealt to, by its hash."""
    return F.pmod(F.xxhash64(node), F.ceil(size / BLOCK)).cast("int")


def by_part(buckets: DataFrame) -> DataFrame:
    """A row for each part of a bucket of ``n`` rows, so that joins by (band, part) split hot buckets."""
    return buckets.withColumn("part", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / BLOCK) - 1).cast("int"))))


def classified(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key (null: ``NO_KEY``), mark, class_id (smallest key of the class), class_size, kept (for one row of each class, of
    those with the smallest key)."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(word_weights(docs, text))
    rows = written(signed(docs, model, key, text), "near-rows")
    nodes = rows.groupBy("node").agg(F.min(F.struct("key", "mark", "tag")).alias("head"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    nodes = written(nodes.select("node", "head.*", "n", "bands"), "near-nodes")
    banded = nodes.select("node", "key", F.explode("bands").alias("band"))
    firsts = banded.groupBy("band").agg(F.min(F.struct("key", "node")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = written(firsts.select("band", F.col("f.node").alias("a"), "n"), "near-buckets")
    hot = small(written(firsts.where(F.col("n") > BLOCK).select("band", F.col("n").alias("size")), "near-hot"))
    banded = banded.join(hot, "band", "left").withColumn("part", part_of("node", F.coalesce("size", F.lit(1))))
    members = written(banded.join(by_part(firsts), ["band", "part"]).select("band", "n", "a", F.col("node").alias("b")), "near-members")
    one = members.where("a <> b").select("a", "b").distinct()
    links = verified(one, docs, nodes, model, key, text, threshold, "near-one")
    comp = components(links, "near-one-comp")
    # what is still apart
    m = members.join(comp, members["b"] == comp["node"], "left").select("band", "n", "b", F.coalesce("label", "b").alias("label"))
    m = written(m, "near-placed")
    parts = m.groupBy("band", "label").agg(F.count(F.lit(1)).alias("k"))
    apart = parts.groupBy("band").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("n")).where("parts > 1")
    apart = apart.select("band", "n", F.col("top.label").alias("top"), F.ceil(F.col("n") / BLOCK).cast("int").alias("all_blocks"),
                         F.ceil((F.col("n") - F.col("top.k")) / BLOCK).cast("int").alias("few_blocks"))
    # written first: an aggregate and a join by the same key in one stage would keep a hot bucket in one task
    apart = by_part(written(apart, "near-apart-buckets")).drop("n")
    left = m.select("band", F.col("b").alias("node"), "b", "label", part_of("b", F.col("n")).alias("part"))
    left = written(left.join(apart, ["band", "part"]).drop("part"), "near-apart")
    texts = texts_of(docs, nodes, left.select("node").distinct(), key, text, "near-two")
    block = lambda n: F.pmod(F.xxhash64("b"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["band", "i", "j", "few", "b", "node", "label"]
    few = left.where("label <> top").withColumn("i", block("few_blocks")).withColumn("j", spread("all_blocks")).withColumn("few", F.lit(True))
    every = left.withColumn("j", block("all_blocks")).withColumn("i", spread("few_blocks")).withColumn("few", F.lit(False))

    def tile(table: pa.Table) -> pa.Table:
        shingles, sides = Shingles(*model.value), ({}, {})
        for few_side, b, label, t in zip(*(table.column(c).to_pylist() for c in ("few", "b", "label", "text"))):
            if b not in (side := sides[not few_side]) and (x := shingles.counted([t or ""])[0])[0] == b:
                side[b] = (label, x[1:])
        out = set()
        if sides[0] and sides[1]:
            like = similarities([x for _, x in sides[0].values()], [y for _, y in sides[1].values()])
            xs, ys = (list(zip(s, (label for label, _ in s.values()))) for s in sides)
            # a link between components that the tile has joined already says nothing new
            joined: dict[str, str] = {}

            def find(label: str) -> str:
                while label in joined:
                    label = joined[label]
                return label

            for p, q in zip(*np.nonzero(like >= threshold)):
                a, b = sorted((find(xs[p][1]), find(ys[q][1])))
                if a != b:
                    joined[b] = a
                    out.add((min(xs[p][0], ys[q][0]), max(xs[p][0], ys[q][0])))
        rows = sorted(out)
        return pa.table({"a": pa.array([r[0] for r in rows], pa.string()), "b": pa.array([r[1] for r in rows], pa.string())})

    two = few.select(cols).unionByName(every.select(cols)).join(texts, "node").groupBy("band", "i", "j").applyInArrow(tile, "a string, b string")
    comp = components(links.union(two), "near-comp")
    placed = nodes.select("node", "key", "mark", "tag", "n").join(comp, "node", "left").withColumn("label", F.coalesce("label", "node"))
    placed = written(placed, "near-placed-nodes")
    heads = placed.groupBy("label").agg(F.min(F.struct("key", "mark", "tag")).alias("head"), F.sum("n").alias("class_size"))
    named = placed.select("node", "label").join(heads, "label").select("node", F.col("head.key").alias("class_id"), F.col("head.tag").alias("head"), "class_size")
    return rows.select("key", "mark", "tag", "node").join(named, "node").select("key", "mark", "class_id", "class_size", (F.col("tag") == F.col("head")).alias("kept"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, class_id (smallest key of the class), class_size, kept (for one row of each class)."""
    null = lambda c: F.nullif(F.col(c), F.lit(NO_KEY))
    return classified(docs, key, text, threshold).select(null("key").alias(key), null("class_id").alias("class_id"), "class_size", "kept")


def keep_one(df: DataFrame) -> DataFrame:
    """Documents without near duplicates: of each class one document with the smallest identifier stays."""
    docs = as_documents(df)
    kept = classified(docs).where("kept").select(F.col("key").alias("_id"), F.col("mark").alias("_mark"))
    keyed = docs.withColumn("_id", F.coalesce("doc_id", F.lit(NO_KEY)).cast("long")).withColumn("_mark", mark_of(F.col("text")))
    return keyed.join(kept, ["_id", "_mark"]).dropDuplicates(["_id", "_mark"]).select(*docs.columns)


@query("op4_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir))
