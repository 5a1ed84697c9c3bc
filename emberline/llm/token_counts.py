"""Token counts by overlap resynchronisation.

A huge document is never encoded in one piece: it is cut into chunks that overlap, the library encodes each chunk with
offsets, and two neighbours are spliced at a boundary in their overlap that is proven stable. A place is proven when white
space that no token holds stands there: the vocabulary's normaliser, splitter and merges never look across white space, so
the tokens on its two sides are those of the whole text. The splice must also be common to both chunks: no token of either
crosses the place, and from there up to the last white space of the overlap both have the same tokens at the same offsets.
(A chunk's ends may tear a word, whose tokens are then not those of the whole text; they lie outside that stretch.) Where
the overlap holds no such place, it is widened (doubled) until it does; a text without one ends up in a single chunk.

A text of a chunk at most needs no splice. Such texts are counted word by word, and the words that a task has met are
remembered with their number of tokens.

Null text counts 0; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import Growing, Numbering, documents, pick, query, text_slices

CHUNK = 16_384
OVERLAP = 256
LIMIT = 2048
#: white space in every Unicode version and in the vocabulary's own class, never part of a token or a special string
BLANK = regex.compile(r"[ \t\n\r]+")
WORDS = regex.compile(r"[^ \t\n\r]+")
SEPARATORS = regex.compile("[\x1c-\x1f]")  # white space to Python, but not to the vocabulary
KNOWN_WORDS = 800_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Encoder:
    """The library's encoding: ``encode`` of a chunk with places in the text, ``counts`` of short texts' tokens word by word."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        self.forget()

    def forget(self) -> None:
        self.numbers, self.size = Numbering(), Growing(np.int64)

    def learn(self) -> None:
        if not (fresh := self.numbers.fresh()):
            return
        # new words are encoded together, a blank between two of them; a token belongs to the word in which it begins
        cuts = np.flatnonzero(np.diff(np.cumsum([len(w) + 1 for w in fresh]) // CHUNK, prepend=0)).tolist()
        groups = [fresh[a:b] for a, b in zip([0, *cuts], [*cuts, len(fresh)]) if a < b]
        for words, e in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            lens = np.fromiter(map(len, words), np.int64, len(words))
            starts = np.cumsum(lens + 1) - lens - 1
            word = np.searchsorted(starts, spans_of(e)[:, 0], side="right") - 1
            self.size.add(np.bincount(word, minlength=len(words)))

    def counts(self, texts: list[str]) -> np.ndarray:
        if len(self.numbers) > KNOWN_WORDS:
            self.forget()
        numbers = [self.numbers.numbers(WORDS.findall(t) if SEPARATORS.search(t) else t.split()) for t in texts]
        self.learn()
        return np.array([int(self.size[x].sum()) for x in numbers], np.int64)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and (start, end) of every token."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(e.ids, np.int32), spans_of(e)


def spans_of(encoding) -> np.ndarray:
    return np.fromiter(chain.from_iterable(encoding.offsets), np.int64, 2 * len(encoding)).reshape(-1, 2)


def splice(text: str, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], lo: int, hi: int) -> int | None:
    """The first place in the overlap [lo, hi) where a word starts after white space and which both chunks' (ids, spans by
    their places in the text) prove: no token of either crosses it, and they agree from it up to the last white space."""
    blanks = list(BLANK.finditer(text, lo, hi))
    if not blanks:
        return None
    sure = blanks[-1].start()
    (li, ls), (ri, rs) = ((ids[near], at[near]) for ids, at in (left, right) for near in [(at[:, 1] >= lo) & (at[:, 0] <= hi)])
    for p in (m.end() for m in blanks):
        if p == len(text) or any(((s[:, 0] < p) & (p < s[:, 1])).any() for s in (ls, rs)):
            continue
        a, b = ((s[:, 0] >= p) & (s[:, 1] <= sure) for s in (ls, rs))
        if np.array_equal(li[a], ri[b]) and np.array_equal(ls[a], rs[b]):
            return p
    return None


def chunk_tokens(encoder: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and spans (in the whole text) of one stretch after another; together they are the whole text's encoding."""
    def spans(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        ids, at = encoder.encode(text[a:b])
        return ids, at + a

    start = done = 0  # the stretch before ``done`` is out
    end = min(len(text), chunk)
    ids, at = spans(start, end)
    while end < len(text):
        wide, p = overlap, None
        while p is None:
            lo = max(done, end - wide)
            stop = min(len(text), max(end, lo + chunk))
            new_ids, new_at = spans(lo, stop)
            p = splice(text, (ids, at), (new_ids, new_at), lo, end)
            if p is not None:
                break
            if lo > done:
                wide *= 2
                continue
            # the overlap is all that the left chunk has: both become one longer chunk
            wide, end = overlap, min(len(text), end + max(chunk, end - done))
            ids, at = spans(done, end)
            if end == len(text):
                break
        if p is None:
            break
        own = at[:, 1] <= p
        yield ids[own], at[own]
        keep = new_at[:, 0] >= p
        ids, at, end, done = new_ids[keep], new_at[keep], stop, p
    yield ids, at


_LOADED: dict = {}


def counts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None,
           chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens, n_chunks. The vocabulary file is shipped to the executors."""
    path = vocabulary or default_vocabulary()
    df.sparkSession.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch, texts in text_slices(batches, 500_000):
            if name not in _LOADED:
                _LOADED[name] = Encoder(load(SparkFiles.get(name)))
            encoder = _LOADED[name]
            n, k = np.zeros(len(texts), np.int64), np.ones(len(texts), np.int64)
            short = [i for i, x in enumerate(texts) if len(x) <= chunk]
            n[short] = encoder.counts([texts[i] for i in short])
            for i, x in enumerate(texts):
                if len(x) > chunk:
                    sizes = [len(ids) for ids, _ in chunk_tokens(encoder, x, chunk, overlap)]
                    n[i], k[i] = sum(sizes), len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_bytes"), pa.array(n), pa.array(k)],
                                             names=["key", "n_bytes", "n_tokens", "n_chunks"])

    rows = pick(df, key=key, text=text).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, n_chunks long").withColumnRenamed("key", key)


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
