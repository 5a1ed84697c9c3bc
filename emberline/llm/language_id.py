"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

1. Character 1- to 3-grams of the lower-cased letters (everything else is one blank) are hashed to ``BUCKETS`` features;
   document frequencies are summed over all training rows, one array a task.
2. The classifier learns from a bounded sample: of ``SAMPLE`` rows (about), every language has an equal part, the
   training rows with the smallest hash draws. Their feature vectors, not their texts, come to the driver.
3. Training is follow-the-regularised-leader, one row at a time, with per-coordinate steps and an elastic net (L1 keeps
   the weights sparse, L2 bounds them).
4. A fifth of the sample is set apart; one temperature is fitted on it, so that the score is a calibrated probability.

Rows without a letter get ``und`` with score 0. Defined results: null text has no letter; null labels and rows outside
the training set teach nothing; with no training rows at all every row is ``und``; an empty table gives none. Equal
languages by code point order decide ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import as_documents, crc_mod, documents, pick, query, small_batches, text_slices, written

BITS = 14
BUCKETS = 1 << BITS
SAMPLE = 3000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-3, 1e-4
PIECE = 500_000  # characters handled at once
SEED = "lang"

_LETTER: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point: is it a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def features(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams; None where the text has no letter. Long texts are summed piece by piece."""
    table, total, any_letter, tail = letter_table(), np.zeros(BUCKETS, np.int64), False, np.full(1, 32, np.uint32)
    low = text.lower()
    for at in range(0, max(1, len(low)), PIECE):
        x = np.frombuffer(low[at:at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        ok = table[x]
        any_letter |= bool(ok.any())
        x = np.concatenate([tail, np.where(ok, x, 32)])
        if at + PIECE >= len(low):
            x = np.concatenate([x, np.full(1, 32, np.uint32)])
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != 32) | (x[:-1] != 32)  # one blank for a run of others
        x = x[keep]
        h1 = x * np.uint32(0x9E3779B1)
        h2 = (h1[:-1] ^ np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35) + h1[1:]
        h3 = (h2[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1) + h1[2:]
        own = h1[1:] if at else h1  # pieces overlap by their last two characters
        for h in (own[x[-len(own):] != 32], h2, h3):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            total += np.bincount(h >> np.uint32(32 - BITS), minlength=BUCKETS)
        tail = x[-2:]
    return total if any_letter else None


def vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero places and their TF-IDF values (1 + log tf), of length 1."""
    at = np.flatnonzero(counts)
    v = (1.0 + np.log(counts[at])) * idf[at]
    return at, v / max(np.sqrt((v * v).sum()), 1e-12)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (classes, BUCKETS)."""
    z, n = np.zeros((n_classes, BUCKETS)), np.zeros((n_classes, BUCKETS))

    def weights(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(nn)) / ALPHA + L2))

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            zz, nn = z[:, at], n[:, at]
            w = weights(zz, nn)
            s = w @ v
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            g = p[:, None] * v[None, :]
            g2 = g * g
            z[:, at] = zz + g - (np.sqrt(nn + g2) - np.sqrt(nn)) / ALPHA * w
            n[:, at] = nn + g2
    return weights(z, n)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The one number that scores are divided by for the best likelihood, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = scores / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    a, b, g = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(train: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE) -> dict:
    """Languages, idf, weights and temperature. ``sample`` bounds the rows that the classifier sees; document
    frequencies cover every row."""
    small_batches(train.sparkSession)
    rows = pick(train, key=key, text=text, label=label).where(F.col("label").isNotNull())
    draw = F.conv(F.substring(F.md5(F.concat(
        F.lit(f"{SEED}:"), F.coalesce(F.col("key").cast("string"), F.lit("~")), F.lit(":"), F.xxhash64("text").cast("string"))), 1, 12), 16, 10).cast("double") / float(16 ** 12)
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return {"languages": [], "idf": np.ones(BUCKETS), "weights": np.zeros((0, BUCKETS)), "temperature": 1.0}
    share = F.element_at(F.create_map(*[F.lit(x) for k in sorted(n) for x in (k, min(1.0, sample / len(n) / n[k]))]), F.col("label"))
    sampled = rows.select("text", F.when(draw < share, F.col("label")).alias("label"), draw.alias("draw"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs = np.zeros(BUCKETS, np.int64), 0
        names = ["kind", "label", "draw", "at", "n"]

        def out(kind: str, label: str | None, draw: float, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a, pa.int32())) for a in (at, n)]
            return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([label], pa.string()), pa.array([draw], pa.float64()), *lists], names=names)

        for batch, texts in text_slices(batches):
            labels, draws = batch.column("label").to_pylist(), batch.column("draw").to_pylist()
            for t, label, d in zip(texts, labels, draws):
                x = features(t)
                if x is None:
                    continue
                at = np.flatnonzero(x)
                df[at] += 1
                docs += 1
                if label is not None:
                    yield out("row", label, d, at, x[at])
        at = np.flatnonzero(df)
        yield out("df", None, float(docs), at, df[at])

    got = written(sampled.mapInArrow(gather, "kind string, label string, draw double, at array<int>, n array<int>"), "language-features")
    of_tasks = got.where("kind = 'df'")  # an array a task: added up on the cluster, so the driver gets a row a bucket
    counts = of_tasks.select(F.explode(F.arrays_zip("at", "n")).alias("c")).groupBy("c.at").agg(F.sum("c.n").alias("n")).toArrow()
    df = np.zeros(BUCKETS)
    df[counts.column("at").to_numpy()] = counts.column("n").to_numpy()
    total = of_tasks.agg(F.coalesce(F.sum("draw"), F.lit(0.0))).first()[0]
    # rows that repeat key and text share a draw and count once, so the sample stays near its bound however often they repeat
    chosen = got.where("kind = 'row'").dropDuplicates(["label", "draw"]).select("label", "draw", "at", "n").toArrow()
    labels, draws = (chosen.column(c).to_pylist() for c in ("label", "draw"))
    at_col, n_col = chosen.column("at"), chosen.column("n")
    rows_at = [(draws[i], labels[i], at_col[i].values.to_numpy(), n_col[i].values.to_numpy()) for i in range(len(labels))]
    idf = 1.0 + np.log((total + 1.0) / (df + 1.0))
    rows_at.sort(key=lambda r: (r[0], r[1]))
    languages = sorted({r[1] for r in rows_at})
    if not languages:
        return {"languages": [], "idf": idf, "weights": np.zeros((0, BUCKETS)), "temperature": 1.0}
    y = np.array([languages.index(r[1]) for r in rows_at])
    vectors = []
    for _, _, at, k in rows_at:
        v = (1.0 + np.log(k)) * idf[at]
        vectors.append((at, v / max(np.sqrt((v * v).sum()), 1e-12)))
    own = np.arange(len(y)) % 5 != 4
    w = ftrl([v for v, o in zip(vectors, own) if o], y[own], len(languages))
    scores = np.array([w[:, at] @ v for (at, v), o in zip(vectors, own) if not o]).reshape(-1, len(languages))
    return {"languages": languages, "idf": idf, "weights": w, "temperature": temperature(scores, y[~own])}


def predict(df: DataFrame, model: dict, key: str = "doc_id", text: str = "text", more: tuple = ()) -> DataFrame:
    """key, lang_pred, score, and the ``more`` columns as they are (``text`` among them if wanted)."""
    small_batches(df.sparkSession)
    rows = pick(df, key=key, text=text, **{f"more_{i}": c for i, c in enumerate(more)})
    shared = df.sparkSession.sparkContext.broadcast(  # its size is fixed by BUCKETS and the number of languages
        {**model, "weights": np.ascontiguousarray(model["weights"].T.astype(np.float32)), "idf": model["idf"].astype(np.float32)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, texts in text_slices(batches):
            names, scores = [], []
            for t in texts:
                x = features(t) if m["languages"] else None
                if x is None:
                    names.append("und")
                    scores.append(0.0)
                    continue
                at, v = vector(x, m["idf"])
                s = (v @ m["weights"][at]).astype(np.float64) / m["temperature"]
                p = np.exp(s - s.max())
                k = int(p.argmax())
                names.append(m["languages"][k])
                scores.append(float(p[k] / p.sum()))
            own = [batch.column(c) for c in ("key", *also)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=["key", *also, "lang_pred", "score"])

    also = [f"more_{i}" for i in range(len(more))]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("key", *also))
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double").toDF(key, *more, "lang_pred", "score")


def held_out(col: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(4, col) == 2, F.lit(False))


def keep_identified(df: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is known: ``und`` and predictions below ``least`` go."""
    docs = as_documents(df)
    model = fit(docs.where(~held_out()))
    rest = tuple(c for c in docs.columns if c != "doc_id")
    good = predict(docs, model, more=rest).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return good.select(*docs.columns)


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = predict(docs, fit(docs.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
