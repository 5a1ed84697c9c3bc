"""Byte-level BPE encoding and decoding through a minimal acyclic transducer lexicon.

1. Word counts: each task counts the pre-tokenised words of its rows and sends on, for every window of about a million
   words, those that came at least twice (lossy counting: a word loses less than one count in a million per window;
   a task's only window is sent in full, so small tables count exactly). Words with at least ``min_share`` of all words
   form the lexicon, so it has at most 1 / ``min_share`` entries at every corpus size; these only are collected.
2. The words are compiled into a minimal acyclic automaton over bytes: equal suffixes share states. Every edge carries a
   number, and the sum along a word's path is the word's number, which points at its token ids: the transducer's output.
3. States, edges, outputs, the merge table and the token bytes lie in one file in the shared folder, which all tasks map
   into memory.
4. Unseen words are merged exactly: all words of one length at once, always the leftmost pair of the lowest rank.

The result does not depend on the lexicon. Defined results: null text is encoded as empty; strings of the vocabulary's
special tokens inside texts become their ids, as the tokenizers library does by default; an empty table gives none.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import Growing, Numbering, documents, flat_ranges, pick, query, text_slices, written
from emberline.llm.elias_fano import mapped as map_file, save
from emberline.session import scratch_path

MIN_SHARE = 1e-5
WINDOW = 1_000_000
LONGEST = 48  # bytes of the longest word that the lexicon holds and that is merged in bulk
KNOWN_WORDS = 400_000  # words whose ids a task remembers before it starts afresh
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: code points whose class differs between Unicode versions, and all beyond the basic plane: the library splits such texts
UNSURE = regex.compile("[\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7f1\uab6c\uab6d\U00010000-\U0010ffff]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def words_of(text: str) -> list[str]:
    if text.isascii() or not UNSURE.search(text):
        return SPLIT.findall(text)
    from tokenizers import pre_tokenizers

    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return [text[a:b] for _, (a, b) in cut.pre_tokenize_str(text)]


def pieces(text: str, specials: list[str]) -> list:
    """Words, and one-element tuples for special tokens (the leftmost, then the longest, comes first)."""
    if not any(s in text for s in specials):
        return words_of(text)
    out: list = []
    for k, part in enumerate(regex.split("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")", text)):
        out.extend([(part,)] if k % 2 else words_of(part))
    return out


# ---------------------------------------------------------------- vocabulary and lexicon

def byte_alphabet() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others
    for code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    vocab, letters = j["model"]["vocab"], byte_alphabet()
    merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in j["model"]["merges"]]
    special = {x["content"]: x["id"] for x in j["added_tokens"]}
    words = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for s, i in vocab.items():
        words[i] = bytes(letters[c] for c in s) if all(c in letters for c in s) else s.encode()
    for s, i in special.items():
        words[i] = s.encode()
    single = np.zeros(256, np.int32)
    for c, b in letters.items():
        single[b] = vocab[c]
    return {"special": special, "tokens": words, "single": single,
            "merges": np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64)}


def minimal_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """Sorted distinct words -> states and edges (sorted by state and byte) whose numbers sum up to a word's place.
    Only the path of the last word is open; what a new word leaves behind is closed and shared with its equal."""
    shared: dict[tuple, int] = {}
    edges_of: list[tuple] = []
    final: list[bool] = []
    below: list[int] = []

    def close(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if (s := shared.get(key)) is None:
            s = shared[key] = len(final)
            final.append(node[0])
            edges_of.append(key[1])
            below.append(int(node[0]) + sum(below[t] for _, t in key[1]))
        return s

    path: list[list] = [[False, []]]
    last = b""
    for w in [*words, None]:
        same = 0
        if w is not None:
            while same < min(len(w), len(last)) and w[same] == last[same]:
                same += 1
        while len(path) > same + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], close(node)))
        if w is not None:
            path.extend([False, []] for _ in w[same:])
            path[-1][0] = True
            last = w
    root = close(path[0])
    key, to, number = [], [], []
    for s, edges in enumerate(edges_of):
        n = int(final[s])
        for label, t in edges:
            key.append(s << 8 | label)
            to.append(t)
            number.append(n)
            n += below[t]
    return {"edge": np.array(key, np.int64), "to": np.array(to, np.int32), "number": np.array(number, np.int32),
            "final": np.array(final, np.uint8), "root": np.array([root], np.int32)}


class Merger:
    """Exact merging of words that the lexicon does not hold."""

    def __init__(self, single: np.ndarray, merges: np.ndarray) -> None:
        self.single, self.out = single, merges[:, 2].astype(np.int32)
        pairs = merges[:, 0] << 32 | merges[:, 1]
        self.order = np.argsort(pairs, kind="stable")
        self.pairs = pairs[self.order]
        self.slots = self._table()

    def _table(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Open hash table with one probe for almost all pairs; the few that collide stay in the sorted list."""
        bits = max(12, int(len(self.pairs)).bit_length() + 4)
        key, value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        slot = self._slot(self.pairs, bits)
        key[slot[::-1]], value[slot[::-1]] = self.pairs[::-1], self.order[::-1]
        lost = key[slot] != self.pairs
        self.lost, self.lost_rank = self.pairs[lost], self.order[lost]
        return key, value, bits

    @staticmethod
    def _slot(pairs: np.ndarray, bits: int) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of merges where there is none."""
        key, value, bits = self.slots
        pair = left.astype(np.int64) << 32 | right
        slot = self._slot(pair, bits)
        hit = key[slot] == pair
        rank = np.where(hit, value[slot], len(self.out))
        if len(self.lost):
            miss = np.flatnonzero(~hit)
            flat = pair.ravel()[miss] if pair.ndim == 1 else pair[~hit]
            at = np.minimum(np.searchsorted(self.lost, flat), len(self.lost) - 1)
            found = np.where(self.lost[at] == flat, self.lost_rank[at], len(self.out))
            rank[~hit] = found
        return rank

    def same_length(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, ids) blocks for a matrix of byte ids with one word a row."""
        done, rows = [], np.arange(len(ids))
        while len(rows):
            if ids.shape[1] < 2:
                done.append((rows, ids))
                break
            rank = self.ranks(ids[:, :-1], ids[:, 1:])
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), at]
            go = best < len(self.out)
            if not go.all():
                done.append((rows[~go], ids[~go]))
            rows, ids, at, best = rows[go], ids[go], at[go], best[go]
            keep = np.arange(ids.shape[1] - 1)[None, :]
            ids = np.take_along_axis(ids, keep + (keep > at[:, None]), axis=1)
            ids[np.arange(len(rows)), at] = self.out[best]
        return done

    def long_word(self, word: bytes) -> list[int]:
        """One word of any length, by a heap of pairs over a linked list."""
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before, none = list(range(1, n + 1)), list(range(-1, n - 1)), len(self.out)
        arr = np.array(ids)
        first = self.ranks(arr[:-1], arr[1:])
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r < none]
        heapq.heapify(heap)
        seen: dict[tuple[int, int], int] = {}

        def rank(a: int, b: int) -> int:
            if (a, b) not in seen:
                seen[a, b] = int(self.ranks(np.array([a]), np.array([b]))[0])
            return seen[a, b]

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.out[r]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (x := rank(ids[i], ids[after[i]])) < none:
                    heapq.heappush(heap, (x, i, ids[i], ids[after[i]]))
            if (p := before[i]) >= 0 and (x := rank(ids[p], ids[i])) < none:
                heapq.heappush(heap, (x, p, ids[p], ids[i]))
        return [i for i in ids if i >= 0]

    def words(self, words: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(words)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lens):
            rows = np.flatnonzero(lens == n)
            if n > LONGEST:
                for r in rows:
                    out[r] = np.array(self.long_word(words[r]), np.int32)
            elif n:
                raw = np.frombuffer(b"".join(words[r] for r in rows), np.uint8).reshape(len(rows), n)
                for some, ids in self.same_length(self.single[raw]):
                    for r, x in zip(rows[some], ids):
                        out[r] = x
            else:
                for r in rows:
                    out[r] = np.zeros(0, np.int32)
        return out


def frequent_words(docs: DataFrame, text: str, min_share: float, window: int = WINDOW) -> list[tuple[str, int]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n, windows, total = Counter(), 0, 0, 0

        def out(least: int) -> pa.RecordBatch:
            kept = [(w, k) for w, k in seen.items() if k >= least]
            return pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in kept], pa.string()), "n": pa.array([k for _, k in kept], pa.int64())})

        for _, texts in text_slices(batches):
            for t in texts:
                words = words_of(t)
                n += len(words)
                seen.update(words)
            if n >= window:
                yield out(2)
                windows, total, n = windows + 1, total + n, 0
                seen.clear()
        yield out(2 if windows else 1)
        yield pa.RecordBatch.from_pydict({"word": pa.array([None], pa.string()), "n": pa.array([total + n], pa.int64())})

    counts = pick(docs, text=text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # the number of all words is the null word's row; it also sets the bar, in one pass over the counts
    counts = counts.where(F.col("word").isNull() | ((F.col("n") >= 2) & (F.octet_length("word") <= LONGEST)))
    counts = written(counts, "bpe-words")
    total = (counts.where(F.col("word").isNull()).agg(F.sum("n")).first()[0]) or 0
    return [(r["word"], r["n"]) for r in counts.where(F.col("word").isNotNull() & (F.col("n") >= min_share * total)).collect()]


def compile_lexicon(vocabulary: str, words: list[str]) -> dict[str, np.ndarray]:
    """The arrays of the lexicon's file."""
    v = read_vocabulary(vocabulary)
    raw = sorted({w.encode() for w in words} - {b""})
    ids = Merger(v["single"], v["merges"]).words(raw)
    return minimal_automaton(raw) | {
        "ids": np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32), "ids_at": np.cumsum([0, *map(len, ids)]).astype(np.int64),
        "single": v["single"], "merges": v["merges"],
        "token_bytes": np.frombuffer(b"".join(v["tokens"]), np.uint8), "token_at": np.cumsum([0, *map(len, v["tokens"])]).astype(np.int64),
        "special": np.frombuffer(json.dumps(v["special"]).encode(), np.uint8),
    }


class Lexicon:
    """The mapped file."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        for name, a in arrays.items():
            setattr(self, name, a)
        self.special: dict[str, int] = json.loads(arrays["special"].tobytes())
        self.merger = Merger(np.asarray(self.single), np.asarray(self.merges))

    def places(self, words: list[bytes]) -> np.ndarray:
        """Number of each word in the lexicon, -1 where it has none: all words walk the automaton side by side."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        starts = np.cumsum(lens) - lens
        place, state = np.zeros(len(words), np.int64), np.full(len(words), int(self.root[0]), np.int64)
        state[(lens > LONGEST) | (lens == 0)] = -1
        live = np.flatnonzero(state >= 0)
        edge, k = self.edge, 0
        while len(live) and len(edge):
            live = live[(lens[live] > k)]
            key = state[live] << 8 | raw[starts[live] + k]
            at = np.minimum(np.searchsorted(edge, key), len(edge) - 1)
            hit = edge[at] == key
            state[live[~hit]] = -1
            live, at = live[hit], at[hit]
            place[live] += self.number[at]
            state[live] = self.to[at]
            k += 1
        ends = (state >= 0) & (self.final[np.maximum(state, 0)] > 0) if len(edge) else np.zeros(len(words), bool)
        return np.where(ends, place, -1)

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        place = self.places(words)
        out: list = [self.ids[self.ids_at[p]:self.ids_at[p + 1]] if p >= 0 else None for p in place.tolist()]
        unseen = [i for i, p in enumerate(place) if p < 0]
        for i, ids in zip(unseen, self.merger.words([words[i] for i in unseen])):
            out[i] = ids
        return out


class Encoder:
    """Texts -> flat ids and lengths, remembering the ids of the words it has met."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.specials = lexicon, list(lexicon.special)
        self.forget()

    def forget(self) -> None:
        self.numbers, self.flat, self.at, self.len = Numbering(), Growing(np.int32), Growing(np.int64), Growing(np.int64)

    def learn(self) -> None:
        if not (new := self.numbers.fresh()):
            return
        ids = iter(self.lexicon.encode([w.encode() for w in new if not isinstance(w, tuple)]))
        found = [np.array([self.lexicon.special[w[0]]], np.int32) if isinstance(w, tuple) else next(ids) for w in new]
        lens = np.fromiter(map(len, found), np.int64, len(found))
        self.at.add(self.flat.size + np.cumsum(lens) - lens)
        self.len.add(lens)
        self.flat.add(np.concatenate(found))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.numbers) > KNOWN_WORDS:
            self.forget()
        parts = [pieces(t, self.specials) for t in texts]
        numbers = [self.numbers.numbers(p) for p in parts]
        self.learn()
        flat = np.concatenate([*numbers, np.zeros(0, np.int64)])
        lens = self.len[flat]
        ids = self.flat[flat_ranges(self.at[flat], lens)]
        ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), lens]))
        cuts = ends[np.cumsum([0, *map(len, parts)])]
        return ids, cuts


_MAPPED: dict[str, Lexicon] = {}


def mapped(path: str) -> Lexicon:
    if path not in _MAPPED:
        _MAPPED.clear()
        _MAPPED[path] = Lexicon(map_file(path))
    return _MAPPED[path]


def build_lexicon(docs: DataFrame, text: str = "text", vocabulary: str | None = None, min_share: float = MIN_SHARE) -> str:
    """Counts and compiles the lexicon into a file of the shared folder; its path is what ``encode`` and ``decode`` take."""
    words = [w for w, _ in frequent_words(docs, text, min_share)]
    return save(scratch_path(docs.sparkSession, "bpe-lexicon"), "lexicon", compile_lexicon(vocabulary or default_vocabulary(), words))


def encode(df: DataFrame, lexicon: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int>."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch, texts in text_slices(batches, 1_000_000):
            encoder = encoder or Encoder(mapped(lexicon))
            ids, cuts = encoder(texts)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))],
                                             names=["key", "ids"])

    rows = pick(df, key=key, text=text)
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def decode(df: DataFrame, lexicon: str, key: str = "doc_id", ids: str = "ids", limit: int = 500_000) -> DataFrame:
    """key, ids, text: the tokens' bytes joined and read as UTF-8, bytes that are none as U+FFFD."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = None
        for whole in batches:
            sizes = np.cumsum(whole.column("ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            cuts = np.unique(np.searchsorted(sizes, np.arange(0, (sizes[-1] if len(sizes) else 0) + 1, limit), side="right"))
            for a, b in zip([0, *cuts], [*cuts, whole.num_rows]):
                if a == b:
                    continue
                batch = whole.slice(a, b - a)
                x = x or mapped(lexicon)
                col = batch.column("ids")
                flat = col.flatten().to_numpy()
                at = np.asarray(x.token_at)
                lens = at[flat + 1] - at[flat]
                raw = np.asarray(x.token_bytes)[flat_ranges(at[flat], lens)].tobytes()
                ends = np.concatenate([[0], np.cumsum(lens)])
                rows = np.concatenate([[0], np.cumsum(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
                edge = ends[rows]
                texts = [raw[p:q].decode("utf-8", "replace") for p, q in zip(edge, edge[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("key"), col, pa.array(texts, pa.string())], names=["key", "ids", "text"])

    rows = pick(df, key=key, ids=ids)
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids array<int>, text string").withColumnRenamed("key", key)


@query("op1_bpe_lexicon")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lexicon = build_lexicon(docs)
    back = decode(encode(docs, lexicon), lexicon)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
