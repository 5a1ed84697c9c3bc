"""Language-model scoring with an Elias-Fano n-gram trie.

Tokens are runs of anything but ASCII white space, A-Z lower-cased, then one end token. The model is an interpolated
n-gram model with absolute discounting:

    p(w | context) = max(c(context w) - D, 0) / c(context) + rest(context) * p(w | shorter context)

over the n-grams that came at least ``least`` times: all of them in the query (``WHOLE``), with the discount D from how
many came once and twice; ``rest`` is what the kept n-grams leave, so every context's probabilities sum to one. The unigram term is (c + 0.5) / (N + 0.5 (V + 1)), N tokens of V kinds, for any word.

Building, one shuffle a level:
* words are counted by their 64-bit hash (made for all bytes of a slice at once); a word's number is its rank among all
  sorted hashes;
* for level k each task turns its rows into (parent node, word) keys by searching the levels that are done and sums them
  up in windows. The sums are dealt by ranges of the parent, cut where a bounded sample of texts says that they hold
  about the same number of keys, so the task that adds up a range has its keys in their final order: it writes the shard
  of nodes and the totals and child counts of its contexts at once. With a cutoff, an n-gram can only reach it if its
  beginning and its end do, so all others are left out before the shuffle;
* how many n-grams came once and twice, over all ranges, gives the discount; a second pass over the shards' files adds
  the quantised ratios and the contexts: a set of bits over the nodes before, quantised rests, and on the first level
  Elias-Fano coded monotone pointers to the first child. From the third level on a word is written relative to its context:
  as its place among the successors of the word before it.
Shards are files in the shared folder; nothing of the model passes through the driver but their names and sizes. Every
scoring task maps those it comes to. A lost executor's tasks write new files under new names.

Defined results: null text is empty, a text without words is its end token alone; rows with a null identifier are
training rows; with no training rows every probability is the unigram formula's (1); an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import crc_mod, documents, pick, query, text_slices, written
from emberline.llm.elias_fano import BitSet, EliasFano, encode, encode_set, mapped, save
from emberline.llm.word_hashes import mix64, word_hashes
from emberline.session import scratch_path

ORDER = 3
WHOLE = 1  # least count that keeps every n-gram
LEAST = 2  # n-grams of two and more words are kept from this count on where the caller names none
WINDOW = 3_000_000  # keys that a task sums up at a time
RANGE_ROWS = 3_000  # rows for each range in which the sums of all tasks meet
SAMPLE = 4_096  # texts, about, from which the ranges' bounds are taken (they change no result)
MARKS = 256  # keys that each task of the sample passes on
SLICE = 3_000_000  # characters that are looked up at a time
U64 = np.uint64
END = U64(0x2545F4914F6CDD1D)  # the end token


def read_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, ends included, and where each text's tokens begin."""
    h, cuts = word_hashes(texts)
    out = np.full(len(h) + len(texts), END, U64)
    out[np.arange(len(h)) + np.repeat(np.arange(len(texts)), np.diff(cuts))] = h
    return out, cuts + np.arange(len(cuts))


# ---------------------------------------------------------------- shards

def small_counts(c: np.ndarray) -> dict[str, np.ndarray]:
    big = np.flatnonzero(c > 254)
    return {"c8": np.minimum(c, 255).astype(np.uint8), "big_at": big.astype(np.int64), "big_c": c[big].astype(np.int64)}


def counts_at(p: dict[str, np.ndarray], i: np.ndarray | slice) -> np.ndarray:
    c = p["c8"][i].astype(np.int64)
    if len(big := np.flatnonzero(c == 255)):
        c[big] = p["big_c"] if isinstance(i, slice) else p["big_c"][np.searchsorted(p["big_at"], i[big])]
    return c


def quantised(x: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Logarithms of positive numbers in 255 equal steps between the smallest and the largest; code 0 is 0 itself."""
    ln = np.log(np.maximum(x, 1e-12))
    lo, hi = (float(ln.min()), float(ln.max())) if len(x) else (0.0, 0.0)
    step = (hi - lo) / 254 or 1.0
    code = np.where(x > 1e-12, 1 + np.rint((ln - lo) / step), 0).astype(np.uint8)
    return {f"{name}8": code, f"{name}_of": np.concatenate([[0.0], np.exp(lo + step * np.arange(255))])}


class Shards:
    """Sorted shards of one table, seen as one sorted sequence. A shard's files are opened when a search first comes to it."""

    def __init__(self, rows: list) -> None:
        """rows: (paths, first key, entries, sum) in order."""
        self.paths = [r[0] for r in rows]
        self.open: dict[int, tuple] = {}
        self.first = np.array([r[1] for r in rows], U64)
        self.base = np.cumsum([0, *(r[2] for r in rows)])
        self.sums = np.cumsum([0, *(r[3] for r in rows)])

    def part(self, s: int) -> tuple:
        """Arrays, keys and pointers of a shard."""
        if s not in self.open:
            p = {k: a for path in self.paths[s] for k, a in mapped(path).items()}
            of = lambda mark: {k[2:]: a for k, a in p.items() if k.startswith(mark)}
            self.open[s] = p, (EliasFano if "k_head" in p else BitSet)(of("k_")), EliasFano(of("p_")) if "p_head" in p else None
        return self.open[s]

    def _each(self, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        n = len(self.paths)
        if n == 1:
            yield 0, np.flatnonzero(shard == 0)
            return
        if n <= 8:  # a pass a shard costs less than sorting
            yield from ((s, at) for s in range(n) if len(at := np.flatnonzero(shard == s)))
            return
        order = np.argsort(shard.astype(np.int16) if n < 1 << 15 else shard, kind="stable")  # 16 bits: by counting
        cuts = np.searchsorted(shard[order], np.arange(n + 1))
        for s in range(n):
            if cuts[s] < cuts[s + 1]:
                yield s, order[cuts[s]:cuts[s + 1]]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in the whole sequence, -1 where it is not. Equal keys are searched once and all in rising order, so
        that a search finds what it reads in the processor's cache, as the one before it has been there."""
        out = np.full(len(keys), -1, np.int64)
        if not self.paths or not len(keys):
            return out
        order = np.argsort(keys)
        rising = keys[order]
        new = np.concatenate([[True], rising[1:] != rising[:-1]])
        kinds = rising[new]
        place = np.full(len(kinds), -1, np.int64)
        cuts = np.append(np.searchsorted(kinds, self.first), len(kinds))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            i, hit = self.part(s)[1].successor(kinds[cuts[s]:cuts[s + 1]] - self.first[s])
            place[cuts[s]:cuts[s + 1]] = np.where(hit, self.base[s] + i, -1)
        out[order] = place[np.cumsum(new) - 1]
        return out

    def _local(self, places: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if len(places):
            for s, at in self._each(np.searchsorted(self.base, places, side="right") - 1):
                yield s, at, places[at] - self.base[s]

    def counts(self, places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(places), np.int64)
        for s, at, i in self._local(places):
            out[at] = counts_at(self.part(s)[0], i)
        return out

    def numbers(self, places: np.ndarray, name: str) -> np.ndarray:
        out = np.zeros(len(places))
        for s, at, i in self._local(places):
            p = self.part(s)[0]
            out[at] = p[f"{name}_of"][p[f"{name}8"][i]]
        return out

    def begins(self, places: np.ndarray) -> np.ndarray:
        """Index of the first child."""
        out = np.zeros(len(places), np.int64)
        for s, at, i in self._local(places):
            out[at] = self.sums[s] + self.part(s)[2].values(i).astype(np.int64)
        return out


# ---------------------------------------------------------------- the trie

class Trie:
    def __init__(self, model: dict) -> None:
        self.m = model
        self.words = Shards(model["words"])
        self.nodes = [Shards(x) for x in model["nodes"]]
        self.contexts = [Shards(x) for x in model["contexts"]]

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the tokens (ends included; -1: unknown) of all texts and where each text's begin; looks up what
        is known of each distinct word once."""
        h, cuts = read_tokens(texts)
        kinds, which = np.unique(np.append(h, END), return_inverse=True)
        ids = self.words.find(kinds)
        c = np.zeros(len(ids), np.int64)
        known = np.flatnonzero(ids >= 0)
        c[known] = self.words.counts(ids[known])
        begin, rest, parent = np.zeros(len(ids), np.int64), np.ones(len(ids)), np.zeros(len(ids), bool)
        if self.contexts:
            ctx = self.contexts[0].find(ids[known].astype(U64))
            has = known[ctx >= 0]
            parent[has] = True
            begin[has], rest[has] = self.contexts[0].begins(ctx[ctx >= 0]), self.contexts[0].numbers(ctx[ctx >= 0], "rest")
        self.id, self.c, self.begin, self.rest, self.parent, self.end = ids, c, begin, rest, parent, which[-1]
        return which[:-1], cuts

    def before(self, flat: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The token before each token; the end token before a text's first."""
        out = np.concatenate([[self.end], flat[:-1]])
        out[cuts[:-1]] = self.end
        return out

    def walk(self, flat: np.ndarray, cuts: np.ndarray, levels: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each level from the second on: node of every token's n-gram (-1: none), node of its context (-1: none),
        the key under which the n-gram is or would be stored (parent, word), and which tokens have one. The context of a text's
        first token is the end token; longer contexts do not reach beyond that."""
        before = self.before(flat, cuts)
        ids, prev = self.id[flat], self.id[before]
        parent, word = prev, ids
        able = (parent >= 0) & (word >= 0)
        if self.m["least"] > WHOLE:
            able &= (self.c[flat] >= self.m["least"]) & (self.c[before] >= self.m["least"])
        for k in range(levels):
            node = np.full(len(flat), -1, np.int64)
            if k < len(self.nodes):
                bits = U64(self.m["bits"][k])
                look = np.flatnonzero(able & self.parent[before] if k == 0 else able)
                node[look] = self.nodes[k].find(parent[look].astype(U64) << bits | word[look].astype(U64))
            yield node, parent, word, able
            if k == 0:
                relative = node - self.begin[before]
            parent = np.concatenate([[-1], node[:-1]])
            parent[cuts[:-1]] = -1
            word = relative
            able = (parent >= 0) & (node >= 0)

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """n_tokens, n_known, base score and score of each text."""
        m = self.m
        flat, cuts = self.read(texts)
        p = (self.c + 0.5) / (m["N"] + 0.5 * (m["V"] + 1))
        p, base = p[flat], np.log10(p)[flat]
        before = self.before(flat, cuts)
        for k, (node, parent, _, _) in enumerate(self.walk(flat, cuts, len(self.nodes))):
            if k == 0:
                p = p * self.rest[before]
            else:
                has = np.flatnonzero(parent >= 0)
                ctx = self.contexts[k].find(parent[has].astype(U64))
                has, ctx = has[ctx >= 0], ctx[ctx >= 0]
                p[has] *= self.contexts[k].numbers(ctx, "rest")
            hit = np.flatnonzero(node >= 0)
            p[hit] += self.nodes[k].numbers(node[hit], "ratio")
        total = lambda x: np.add.reduceat(x, cuts[:-1]) if len(cuts) > 1 else np.zeros(0)
        return np.diff(cuts), total((self.c[flat] > 0).astype(np.int64)), total(base), total(np.log10(p))


_TRIES: dict[str, Trie] = {}


def loaded(shared) -> Trie:
    model = shared.value
    if model["name"] not in _TRIES:
        _TRIES.clear()
        _TRIES[model["name"]] = Trie(model)
    return _TRIES[model["name"]]


def planes(x: np.ndarray) -> bytes:
    """Numbers as bytes, all lowest bytes first, then the next ones; planes of zeros at the end are left out."""
    p = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    k = max(1, int(np.flatnonzero(p.any(axis=1)).max(initial=0)) + 1)
    return bytes([k]) + p[:k].tobytes()


def unplanes(b: bytes, n: int) -> tuple[np.ndarray, int]:
    out = np.zeros((n, 8), np.uint8)
    k = b[0]
    out[:, :k] = np.frombuffer(b, np.uint8, n * k, 1).reshape(k, n).T
    return out.reshape(-1).view("<u8"), 1 + n * k


def signed(key: int) -> int:
    return int(key) - (1 << 63)


def unsigned(rows: list, *names: str) -> list[dict]:
    """Rows of shards as dictionaries, their first keys unsigned again, in order."""
    rows = [r.asDict() for r in rows]
    for r in rows:
        r.update({n: r[n] + (1 << 63) for n in names})
    return sorted(rows, key=lambda r: r[names[0]])


def range_bounds(sample: DataFrame, make, ranges: int, bits: int) -> np.ndarray:
    """First parent of each range, such that ranges hold about as many distinct keys of the sampled texts each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [np.unique(make(texts)) for _, texts in text_slices(batches, SLICE)]
        if kinds and len(keys := np.unique(np.concatenate(kinds))):
            some = keys[np.linspace(0, len(keys) - 1, min(MARKS, len(keys))).astype(np.int64)]
            yield pa.RecordBatch.from_pydict({"mark": [signed(k) for k in some.tolist()], "weight": [len(keys) / len(some)] * len(some)})

    rows = sample.mapInArrow(run, "mark long, weight double").collect()  # MARKS a task
    marks = np.array([r["mark"] + (1 << 63) for r in rows], U64)
    order = np.argsort(marks, kind="stable")
    weight = np.cumsum(np.array([r["weight"] for r in rows])[order])
    if not len(marks):
        return np.zeros(1, U64)
    at = np.searchsorted(weight, weight[-1] * np.arange(1, ranges) / ranges)
    return np.unique(np.concatenate([np.zeros(1, U64), marks[order][at] >> U64(bits) << U64(bits)]))


def summed(rows: DataFrame, make, bounds: np.ndarray, finish, kind: str, name: str) -> list:
    """Runs ``make(texts)`` -> keys over slices, counts the keys and gives every range's sorted keys and counts to
    ``finish``, which returns one row about the files it has written, or none. A task sums up by window and sends each
    range's keys as steps from one to the next, in as few bytes as they need."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.append(np.searchsorted(key, bounds), len(key))
            some = np.flatnonzero(np.diff(cuts))
            blobs = [(int(cuts[i + 1] - cuts[i])).to_bytes(8, "little") + planes(np.diff(key[cuts[i]:cuts[i + 1]], prepend=U64(0)))
                     + planes(n[cuts[i]:cuts[i + 1]]) for i in some]
            return pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "blob": pa.array(blobs, pa.binary())})

        for _, texts in text_slices(batches, SLICE):
            held.append(make(texts))
            size += len(held[-1])
            if size > WINDOW:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def merge(table: pa.Table) -> pa.Table:
        keys, counts = [], []
        for b in table.column("blob").to_pylist():
            n = int.from_bytes(b[:8], "little")
            steps, end = unplanes(b[8:], n)
            keys.append(np.cumsum(steps, dtype=U64))
            counts.append(unplanes(b[8 + end:], n)[0].astype(np.int64))
        key, n = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key, kind="stable")  # merges the sorted runs
        key, n = key[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        row = finish(key[first], np.add.reduceat(n, first))
        return pa.table({f.split()[0]: [] if row is None else [row[f.split()[0]]] for f in kind.split(", ")}, schema=arrow_schema)

    arrow_schema = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in kind.split(", ")])
    parts = rows.mapInArrow(run, "bucket int, blob binary").groupBy("bucket").applyInArrow(merge, kind)
    return written(parts, name).collect()


def train(rows: DataFrame, text: str = "text", order: int = ORDER, least: int = LEAST) -> dict:
    """The model: names and sizes of its shards (a few numbers a shard). N-grams of two and more words that came less
    than ``least`` times are left out; ``WHOLE`` keeps all."""
    spark = rows.sparkSession
    folder = scratch_path(spark, "lm-trie")
    rows = pick(rows, text=text)
    n_rows = rows.count()
    ranges = max(1, n_rows // RANGE_ROWS)
    sample = written(rows.where(F.pmod(F.xxhash64("text"), F.lit(max(1, n_rows // SAMPLE))) == 0), "lm-sample")
    cores = spark.sparkContext.defaultParallelism

    def word_shard(key: np.ndarray, n: np.ndarray) -> dict:
        own = encode(key - key[0], int(key[-1] - key[0]) + 1)
        path = save(folder, "words", {f"k_{x}": a for x, a in own.items()} | small_counts(n))
        return {"path": path, "first": signed(key[0]), "n": len(key), "total": int(n.sum())}

    # hashes are even by themselves
    even = np.arange(ranges, dtype=U64) * U64(((1 << 64) - 1) // ranges)
    words = unsigned(summed(rows, lambda texts: read_tokens(texts)[0], even, word_shard, "path string, first long, n long, total long", "lm-words"), "first")
    N, V = sum(r["total"] for r in words), sum(r["n"] for r in words)
    model = {"name": folder, "N": N, "V": V, "bits": [], "nodes": [], "contexts": [], "discount": [], "least": least,
             "words": [([r["path"]], r["first"], r["n"], r["total"]) for r in words]}
    for k in range(order - 1 if V else 0):
        shared = spark.sparkContext.broadcast(dict(model))  # names of files only
        # the width of a word: its number, or from the third level on its place among its context's successors
        widest = V if k == 0 else model["most"]
        bits = max(1, int(widest).bit_length())

        def keys_of(texts: list[str], k: int = k, bits: int = bits, shared=shared) -> np.ndarray:
            trie = loaded(shared)
            flat, cuts = trie.read(texts)
            for level, (_, parent, word, able) in enumerate(trie.walk(flat, cuts, k + 1)):
                if level == k:
                    return parent[able].astype(U64) << U64(bits) | word[able].astype(U64)
            raise AssertionError

        def node_shard(key: np.ndarray, n: np.ndarray, k: int = k, bits: int = bits, shared=shared) -> dict | None:
            key, n = key[n >= least], n[n >= least]
            if not len(key):
                return None
            parent = key >> U64(bits)
            begin = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
            children = np.diff(np.append(begin, len(key)))
            trie = loaded(shared)
            total = (trie.words if not trie.nodes else trie.nodes[-1]).counts(parent[begin].astype(np.int64))
            own = encode(key - key[0], int(key[-1] - key[0]) + 1)
            about = {f"k_{x}": a for x, a in encode_set(parent[begin] - parent[0]).items()}
            return {"path": save(folder, f"nodes{k}", {f"k_{x}": a for x, a in own.items()} | small_counts(n)),
                    "work": save(folder, f"work{k}", about | {"total": total.astype(np.uint32 if total.max() < 1 << 32 else np.int64),
                                                              "children": children.astype(np.uint32)}),
                    "first": signed(key[0]), "n": len(key), "total": int(n.sum()), "ones": int((n == least).sum()), "twos": int((n == least + 1).sum()),
                    "parent": signed(parent[0]), "contexts": len(begin), "most": int(children.max())}

        kind = "path string, work string, first long, n long, total long, ones long, twos long, parent long, contexts long, most long"
        nodes = unsigned(summed(rows, keys_of, range_bounds(sample, keys_of, ranges, bits), node_shard, kind, f"lm-level-{k}"), "first", "parent")
        if not nodes:
            break
        ones, twos = sum(r["ones"] for r in nodes), sum(r["twos"] for r in nodes)
        discount = min(0.95, max(0.3, ones / (ones + 2.0 * twos or 1.0)))

        def smoothed(batches: Iterator[pa.RecordBatch], k: int = k, discount: float = discount) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ratios, contexts = [], []
                for path, work in zip(batch.column("path").to_pylist(), batch.column("work").to_pylist()):
                    w = mapped(work)
                    n, children, total = counts_at(mapped(path), slice(None)), w["children"].astype(np.int64), np.maximum(w["total"].astype(np.int64), 1)
                    begin = np.cumsum(children) - children
                    rest = 1 - (np.add.reduceat(n, begin) - discount * children) / total
                    pointers = {f"p_{x}": a for x, a in encode(begin.astype(U64), int(begin[-1]) + 1).items()} if k == 0 else {}
                    ratios.append(save(folder, f"ratios{k}", quantised((n - discount) / np.repeat(total, children), "ratio")))
                    contexts.append(save(folder, f"contexts{k}", {x: a for x, a in w.items() if x.startswith("k_")} | quantised(np.maximum(rest, 1e-6), "rest") | pointers))
                yield pa.RecordBatch.from_pydict({"path": batch.column("path"), "ratio": ratios, "context": contexts})

        names = spark.createDataFrame([(r["path"], r["work"]) for r in nodes], "path string, work string")
        made = written(names.repartition(min(len(nodes), 4 * cores)).mapInArrow(smoothed, "path string, ratio string, context string"), f"lm-smoothed-{k}")
        added = {r["path"]: r for r in made.collect()}
        model |= {"name": f"{folder}#{k}", "bits": [*model["bits"], bits], "discount": [*model["discount"], discount],
                  "nodes": [*model["nodes"], [([r["path"], added[r["path"]]["ratio"]], r["first"], r["n"], r["total"]) for r in nodes]],
                  "contexts": [*model["contexts"], [([added[r["path"]]["context"]], r["parent"], r["contexts"], r["n"]) for r in nodes]],
                  "most": max(max(r["most"] for r in nodes), model.get("most", 0))}
    return model


def score(df: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, base_score, score."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = pick(df, key=key, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, SLICE):
            n, known, base, own = loaded(shared).score(texts)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)),
                                              pa.array(base.astype(float)), pa.array(own.astype(float))],
                                             names=["key", "n_tokens", "n_known", "base_score", "score"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_tokens long, n_known long, base_score double, score double").withColumnRenamed("key", key)


def held_out(col: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(5, col) == 1, F.lit(False))


@query("op9_lm_scoring")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out()), least=WHOLE)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known",
                                     F.lit(model["N"]).cast("long").alias("train_tokens"), "base_score", "score")
