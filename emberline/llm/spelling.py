"""Spelling variants by sorted-list dynamic programming.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. With p the first place at
which they differ and m the length of the shorter, they have the same p first code points and the same m - p - 1 (or
m - p) last ones. So for a region [a, b) of places, near words that first differ there have the same first a and the same
last m - b code points: each word is listed under (m, a, first a, last m - b) for m its length and one less, for the regions
of the first and of the second half, and near words meet in exactly one list as such.

Spark counts the lists, deals them by a hash into buckets and sorts each bucket; a list longer than ``LONGEST`` has its
region halved again (so its words part by longer fixed ends) until it is short enough or the region is one place, where
a list holds at most one word for each code point that can stand there. Nothing is capped and no list is held whole unless short.

Within a bucket the lists lie one after the other in sorted order. The search goes down all of them by depth: it keeps
pairs (range of words that agree up to this depth, query word) with the three cells of the banded edit matrix between the
range's common prefix and the query, so a row is computed once for all words that share the prefix, which adjacent
common-prefix lengths tell. A pair whose row has no cell of at most one edit is dropped, and with it the whole range.

Words are at least ``SHORTEST`` code points and came ``LEAST`` times. A word's form is its most frequent near word, if that came
``TIMES`` as often; roots follow forms by pointer jumping, which ends, as frequency grows along every step.

Defined results: null and empty texts have no words; a null identifier is the empty string in ``noisy_words``; rows that
repeat count each time; of equally frequent near words the first in code-point order is the form; a word without form
is its own root; an empty table gives none.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import documents, flat_ranges, pick, query, small, text_slices, written

SHORTEST, LEAST, TIMES, NOISE = 7, 2, 10, 31
LONGEST = 20_000  # words of a list that is searched as it is
BUCKET = 60_000  # words of the lists that one task searches at a time, about
PAIRS = 100_000  # pairs of ranges and queries that are carried on at a time
DISTINCT = 200_000  # words that a task counts before it passes them on
RUN = "A-Za-zÀ-ÿ"
SMALL = {c: c + 32 for c in range(65, 91)}
FAR = 9


# ---------------------------------------------------------------- words

def noisy_runs(ident: str, runs: Counter, shortest: int) -> Iterator[tuple[str, int]]:
    """A document's runs, A-Z lower-cased, with one code point less where the checksum of document and run asks for it."""
    low: Counter = Counter()
    for run, n in runs.items():
        low[run.lower() if run.isascii() else run.translate(SMALL)] += n
    for run, n in low.items():
        h = zlib.crc32(f"{ident}:{run}".encode())
        if h % NOISE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= shortest:
            yield run, n


def noisy_words(df: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): the runs of letters of all texts with their planted misspellings, from ``least`` occurrences on."""
    rows = pick(df, key=key, text=text).select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), "text")
    long_run = re.compile(f"[{RUN}]{{{shortest},}}")  # a run too short stays so without a code point

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        give = lambda: pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
        for batch, texts in text_slices(batches):
            for ident, t in zip(batch.column("key").to_pylist(), texts):
                for word, n in noisy_runs(ident, Counter(long_run.findall(t)), shortest):
                    counts[word] += n
                if len(counts) > DISTINCT:
                    yield give()
                    counts.clear()
        if counts:
            yield give()

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# ---------------------------------------------------------------- lists

def listed(words: DataFrame) -> DataFrame:
    """Each word for every shorter length m it can have in a pair and both halves: (word, n, m, a, b)."""
    m = F.explode(F.when(F.char_length("word") > 1, F.array(F.char_length("word"), F.char_length("word") - 1)).otherwise(F.array(F.char_length("word"))))
    half = F.expr("m div 2")
    regions = F.array(F.struct(F.lit(0).alias("a"), half.alias("b")), F.struct(half.alias("a"), F.col("m").alias("b")))
    return words.select("word", "n", m.alias("m")).select("word", "n", "m", F.explode(regions).alias("r")).where("r.a < r.b or r.b = m").select(
        "word", "n", "m", "r.a", "r.b")


def halved(rows: DataFrame) -> DataFrame:
    """The same words in lists of half the region."""
    cut = F.expr("(a + b) div 2")
    regions = F.array(F.struct("a", cut.alias("b")), F.struct(cut.alias("a"), "b"))
    return rows.select("word", "n", "m", F.explode(regions).alias("r")).select("word", "n", "m", "r.a", "r.b")


def list_key() -> Column:
    """What all words of a list share."""
    return F.concat_ws("\u0000", F.col("m").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"), F.expr("substring(word, 1, a)"), F.expr("right(word, m - b)"))


def short_lists(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(word, n, m, a, b, key) with lists of at most ``longest`` words, or of one place."""
    n = words.count()
    done, rows, total = None, listed(words), 4 * n
    while True:
        rows = rows.withColumn("key", list_key())
        dealt = max(1, 2 * total // longest)
        hashed = F.pmod(F.xxhash64("key"), F.lit(dealt))
        # a list that is too long lies in a cell of the hash that is too full; most often there is none
        full = written(rows.groupBy(hashed.alias("cell")).count().where(F.col("count") > longest), "spelling-full")
        long_ = None
        if full.limit(1).count():
            inside = rows.withColumn("cell", hashed).join(small(full), "cell", "left_semi").where("b - a > 1")
            long_ = written(inside.groupBy("key").count().where(F.col("count") > longest).select("key"), "spelling-long")
            long_ = long_ if long_.limit(1).count() else None
        kept = rows if long_ is None else rows.join(small(long_), "key", "left_anti").select(rows.columns)
        done = kept if done is None else done.unionByName(kept)
        if long_ is None:
            return done
        rows = written(halved(rows.join(small(long_), "key", "left_semi")), "spelling-halves")
        total = rows.count()


# ---------------------------------------------------------------- the search

def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words (and three zeros) and where each begins."""
    cuts = np.cumsum([0, *map(len, words)])
    return np.concatenate([np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), np.zeros(3, np.uint32)]), cuts


def near_pairs(words: list[str], group: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of near words of one list, i of length m, whose first difference lies in the list's region. ``words`` are
    sorted within their list, ``group`` numbers the lists in order; m, a and b are given for each word."""
    text, cuts = code_points(words)
    size = np.diff(cuts)
    at = lambda w, d: np.where(d < size[w], text[cuts[w] + np.minimum(d, size[w])], 0)  # noqa: E731 (a place beyond the end matches nothing)
    count = len(words)
    # common prefix of each word with the one before; -1 where a list begins
    common = np.full(count + 1, -1, np.int64)
    same = np.flatnonzero(np.diff(group, prepend=-1) == 0)
    common[same] = a[same]
    live = same
    while len(live):
        d = common[live]
        live = live[(d < size[live]) & (d < size[live - 1]) & (at(live, d) == at(live - 1, d)) & (at(live, d) > 0)]
        common[live] += 1
    first = np.flatnonzero(common[:-1] < 0)
    last = np.append(first[1:], count)
    found_i, found_j = [], []
    # every query of length m starts at its whole list, at the depth up to which all agree
    of = np.searchsorted(first, np.arange(count), side="right") - 1
    queries = np.flatnonzero((size == m) & (last[of] - first[of] > 1))
    heads: dict[int, np.ndarray] = {}  # depth -> words that differ from the one before within the next code point
    for depth in np.unique(a[queries]).tolist():
        stack = []
        for q in np.array_split(same_depth := queries[a[queries] == depth], max(1, 10 * len(same_depth) // PAIRS)):
            stack.append((depth, q, first[of[q]], last[of[q]], np.ones(len(q), np.int8), np.zeros(len(q), np.int8), np.ones(len(q), np.int8)))
        while stack:
            d, *state = stack.pop()
            if len(state[0]) > PAIRS:
                half = len(state[0]) // 2
                stack += [(d, *(x[half:] for x in state)), (d, *(x[:half] for x in state))]
                continue
            q, begin, end, r0, r1, r2 = state
            # the word that ends here comes first in its range
            over = size[begin] == d
            if over.any():
                o = np.flatnonzero(over)
                gap = size[q[o]] - d + 1
                value = np.where(gap == 0, r0[o], np.where(gap == 1, r1[o], np.where(gap == 2, r2[o], FAR)))
                hit = o[value == 1]
                found_i.append(q[hit])
                found_j.append(begin[hit])
                begin = begin + over
                go = np.flatnonzero(begin < end)
                q, begin, end, r0, r1, r2 = (x[go] for x in (q, begin, end, r0, r1, r2))
            if not len(q):
                continue
            # the parts of each range whose words agree in one code point more
            if d not in heads:
                heads[d] = np.flatnonzero(common <= d)  # the end of all words too
            lo = np.searchsorted(heads[d], begin)
            parts = np.searchsorted(heads[d], end) - lo
            at_head, pair = flat_ranges(lo, parts), np.repeat(np.arange(len(q)), parts)
            word, stop = heads[d][at_head], np.minimum(heads[d][at_head + 1], end[pair])
            q, r0, r1, r2 = q[pair], r0[pair], r1[pair], r2[pair]
            c = text[cuts[word] + d]
            n0 = np.minimum(r0 + (at(q, d - 1) != c if d else 1), r1 + 1)
            n1 = np.minimum(np.minimum(r1 + (at(q, d) != c), r2 + 1), n0 + 1)
            n2 = np.minimum(r2 + (at(q, d + 1) != c), n1 + 1)
            n0, n1, n2 = (np.where(d + x > size[q], FAR, n).astype(np.int8) for x, n in enumerate((n0, n1, n2)))
            go = np.flatnonzero(np.minimum(np.minimum(n0, n1), n2) <= 1)
            if len(go):
                stack.append((d + 1, q[go], word[go], stop[go], n0[go], n1[go], n2[go]))
    i, j = np.concatenate([np.zeros(0, np.int64), *found_i]), np.concatenate([np.zeros(0, np.int64), *found_j])
    # the list in whose region the words first differ is the one that gives the pair
    p = a[i].astype(np.int64)
    live = np.arange(len(i))
    while len(live):
        live = live[(p[live] < m[i[live]]) & (at(i[live], p[live]) == at(j[live], p[live]))]
        p[live] += 1
    mine = (p < b[i]) | (b[i] == m[i])
    return i[mine], j[mine]


def links(words: DataFrame, longest: int = LONGEST, bucket: int = BUCKET) -> DataFrame:
    """(word, near, near_n): every ordered pair of near words, once. ``words``: a written table (word, n)."""
    rows = short_lists(words, longest)
    buckets = max(1, 4 * words.count() // bucket)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("word", "ascending")])
        key = table["key"].combine_chunks().dictionary_encode()
        group = key.indices.to_numpy(zero_copy_only=False)  # numbered as they come, so in order
        said, n = table["word"].to_pylist(), table["n"].to_numpy()
        i, j = near_pairs(said, group, *(table[c].to_numpy() for c in ("m", "a", "b")))
        # a pair of one length is found from both sides, one of two lengths from the shorter word only
        both = np.flatnonzero(np.fromiter(map(len, said), np.int64, len(said))[j] > table["m"].to_numpy()[i])
        i, j = np.concatenate([i, j[both]]), np.concatenate([j, i[both]])
        word = table["word"].combine_chunks()
        return pa.table({"word": word.take(pa.array(i)), "near": word.take(pa.array(j)), "near_n": n[j]})

    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(run, "word string, near string, near_n long")


# ---------------------------------------------------------------- forms and roots

def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): the end of every chain of forms. Each round doubles the steps taken."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        jump = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = written(now.join(jump, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(words: DataFrame, times: int = TIMES, longest: int = LONGEST, bucket: int = BUCKET) -> DataFrame:
    """(word, n) of distinct words -> word, form, root, n, n_near, form_n."""
    words = written(words, "spelling-words")
    near = links(words, longest, bucket).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best"))
    best = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.minus")).alias("near_n"))
    is_form = F.coalesce(F.col("near_n") >= times * F.col("n"), F.lit(False))
    best = written(best.select("word", "n", "n_near", F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "spelling-forms")
    ends = roots(best.where(F.col("form").isNotNull()).select("word", "form"))
    return best.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(noisy_words(documents(spark, sf_dir)))
