"""The training-data operators against SQL twins, public libraries and brute force, and on messy tables."""

import hashlib
import itertools
import math
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import SF_SMALL  # noqa: E402
from oracle import compare, duck  # noqa: E402

import corpus_pipeline  # noqa: E402
from emberline.llm import bpe, chat_format, elias_fano, exact_dedup, fingerprints, icws, language_id, line_dedup, lm_scoring  # noqa: E402
from emberline.llm import mixing, near_dedup, token_counts, word_hashes  # noqa: E402
from emberline.llm.catalog import ORACLES, QUERIES  # noqa: E402
from emberline.llm.common import documents, text_slices, written  # noqa: E402
from emberline.session import scratch_path, ship_package  # noqa: E402

KINDS = "doc_id long, text string, lang string, source string, n_chars long, Text string, kept string, size int"
LONG = " ".join(f"word{i % 997} the" for i in range(60_000))
MESSY = [
    (1, "The same text twice, the same text twice, again and again.", "en", "a", 5, "x", "y", 1),
    (1, "The same text twice, the same text twice, again and again.", "en", "a", 5, "x", "y", 1),
    (2, "The same  text twice, the same\ttext twice, again and again.", "en", None, 5, "x", "y", 1),
    (3, None, None, "a", None, None, None, None), (4, "", "de", "b", 0, "", "", 0), (5, " \n\t ", "de", "b", 3, "", "", 0),
    (None, "no number\nat all", None, None, None, None, None, None), (6, "123 456 !!", "en", "b", 9, "", "", 0),
    (7, LONG, "en", "a", len(LONG), "", "", 0), (8, "x" * 50_000, None, "c", 50_000, "", "", 0),
    (9, "caf\u00e9 \U0001F600 \u4e2d\u6587 <|endoftext|> it's \u1e9b\u0323", "fr", "c", 20, "", "", 0),
]


@pytest.fixture(scope="module", autouse=True)
def package(spark):
    ship_package(spark)
    spark.conf.set("spark.sql.caseSensitive", "true")  # so that the clashing column can be made at all
    yield
    spark.conf.set("spark.sql.caseSensitive", "false")


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(MESSY, KINDS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KINDS)


def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in documents(spark, SF_SMALL).collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    ok, why = compare(QUERIES[name](spark, SF_SMALL), duck(SF_SMALL), ORACLES[name])
    assert ok, why


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_bpe_equals_the_library(spark):
    ref = Tokenizer.from_file(bpe.default_vocabulary())
    t = texts(spark)
    for r in QUERIES["op1_bpe_lexicon"](spark, SF_SMALL).collect():
        ids = ref.encode(t[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(ref.decode(ids, skip_special_tokens=False))


def test_bpe_messy(spark, messy, empty):
    ref = Tokenizer.from_file(bpe.default_vocabulary())
    lexicon = bpe.build_lexicon(messy)
    rows = bpe.decode(bpe.encode(messy, lexicon), lexicon).collect()
    want = Counter((r[0], tuple(ref.encode(r[1] or "", add_special_tokens=False).ids), r[1] or "") for r in MESSY)
    assert Counter((r["doc_id"], tuple(r["ids"]), r["text"]) for r in rows) == want
    assert bpe.encode(empty, bpe.build_lexicon(empty)).count() == 0


def test_automaton_is_minimal_and_numbers_its_words():
    words = sorted({a + b for a in (b"", b"x", b"yy", b"zz") for b in (b"ing", b"ed", b"s")})
    a = bpe.minimal_automaton(words)
    assert len(a["final"]) < sum(map(len, words)) / 2  # suffixes are shared
    lex = bpe.Lexicon(a | {"special": np.frombuffer(b"{}", np.uint8), "single": np.zeros(256, np.int32), "merges": np.array([[0, 1, 2]])})
    assert lex.places([*words, b"in", b"xing2", b""]).tolist() == [*range(len(words)), -1, -1, -1]


def test_token_counts_equal_the_library(spark, messy, empty):
    t = token_counts.load(token_counts.default_vocabulary())
    for r in token_counts.counts(messy).collect():
        assert (r["n_tokens"], r["n_bytes"]) in {(len(t.encode(x[1] or "", add_special_tokens=False)), len((x[1] or "").encode()))
                                                 for x in MESSY if x[0] == r["doc_id"]}
    assert token_counts.counts(empty).count() == 0
    e = token_counts.Encoder(t)
    for text in (LONG[:20_000], "a" * 900 + " b " + "c1" * 700, "\u0391\u03a3 \u03a3\u0391\u03a3 \u0130 " * 90, "a\x1cb " * 300):
        whole = t.encode(text, add_special_tokens=False)
        parts = list(token_counts.chunk_tokens(e, text, 300, 20))
        assert [i for ids, _ in parts for i in ids.tolist()] == whole.ids
        assert [tuple(s) for _, at in parts for s in at.tolist()] == whole.offsets


def test_chunks_are_spliced_where_the_library_agrees():
    t = token_counts.load(token_counts.default_vocabulary())
    e, seen = token_counts.Encoder(t), []
    encode, e.encode = e.encode, lambda text: (seen.append(text), encode(text))[1]
    text = "".join(f"word{i * i} " for i in range(400)) + "unbroken" * 60 + " end"
    whole = t.encode(text, add_special_tokens=False)
    parts = list(token_counts.chunk_tokens(e, text, 200, 8))
    assert len(parts) > 10 and [i for ids, _ in parts for i in ids.tolist()] == whole.ids
    assert all(x in text for x in seen) and max(map(len, seen)) < len(text) / 2
    assert any(text[text.index(x) - 1:text.index(x)].strip() for x in seen)  # chunks that begin inside a word are repaired
    # a place at which the chunks differ is no boundary
    ids, at = encode("one two three four")
    assert token_counts.splice("one two three four", (ids, at), (ids, at), 0, 18) == 4
    other = ids.copy()
    other[1] += 1
    assert token_counts.splice("one two three four", (ids, at), (other, at), 0, 18) == 8
    assert token_counts.splice("onetwothree", *[encode("onetwothree")] * 2, 0, 11) is None
    rng = random.Random(8)
    for _ in range(1500):
        text = "".join(rng.choices([*"ab\u0301\u03a3\u0130 \n\t\x1c.\u2003\u4e2d\u1100\u1161'9<|>", "<|endoftext|>"], k=rng.randint(0, 90)))
        assert sum(len(ids) for ids, _ in token_counts.chunk_tokens(e, text, 12, 3)) == len(t.encode(text, add_special_tokens=False))


def test_op8_counts_every_whole_text(spark):
    t = token_counts.load(token_counts.default_vocabulary())
    texts = dict(spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect())
    rows = token_counts.op8(spark, SF_SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        n = len(t.encode(texts[r["doc_id"]] or "", add_special_tokens=False))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((texts[r["doc_id"]] or "").encode()), n, n > 2048)


def test_mix_meets_its_targets(spark, messy, empty):
    rows = mixing.mix(messy).collect()
    assert len(rows) == len(MESSY) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    by = Counter()
    for r in rows:
        by[r["target"], r["source_size"]] += r["taken"]
    assert all(abs(got - target) <= 1 for (target, _), got in by.items())
    assert mixing.mix(empty).count() == 0
    rows = [(i // 2 if i < 20 else None, f"text number {i} " * (1 + i % 3), "en", "ab"[i % 2], i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")  # identifiers repeat or are null
    taken, size = Counter(), Counter()
    for r in mixing.mixed_documents(docs).collect():
        taken[r["source"]] += len(r["text"].split())
    for r in mixing.mix(docs).collect():
        size[r["target"]] = r["source_size"]
    for (target, _), source in zip(sorted(size.items()), sorted(taken, key=taken.get)):
        assert abs(taken[source] - target) <= 9  # within one document
    rows = QUERIES["op2_mix_sources"](spark, SF_SMALL).collect()
    assert sorted(rows) == sorted(QUERIES["op2_mix_sources"](spark, SF_SMALL).collect())
    assert mixing.mixed_documents(empty).count() == 0 and mixing.mixed_documents(messy).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_icws_estimates_generalised_jaccard():
    s, rng = icws.Sampler(4096, 5), np.random.default_rng(1)
    terms, a, b = rng.integers(0, 2**63, 40).astype(np.uint64), rng.random(40) * 5 + 0.1, rng.random(40) * 5 + 0.1
    x, y = (s.smallest(terms, np.log(w), np.array([0, 40])) for w in (a, b))
    assert abs((x == y).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_fingerprints(spark, messy, empty):
    t = texts(spark)
    ids = sorted(t)
    rows = {r["doc_id"]: r for r in fingerprints.with_edits(documents(spark, SF_SMALL), rows_per_range=16).collect()}
    assert len(rows) == len(ids)
    for i, j in zip(ids, ids[1:] + ids[:1]):
        half = len(t[i]) // 2
        assert rows[i]["n_chars"] == len(t[i]) and rows[i]["edited_sha256"] == sha(t[i][:len(t[i]) - half] + t[j][:half])
        same = lambda a, b: sum(a[k:k + 4] == b[k:k + 4] for k in range(0, len(a), 4)) * 4 / len(a)
        assert rows[i]["near_next"] == same(rows[i]["fingerprint"], rows[j]["fingerprint"])
        assert rows[i]["near_edited"] == same(rows[i]["fingerprint"], rows[i]["edited_fingerprint"])
    whole = {r["doc_id"]: r for r in QUERIES["op3_fingerprints"](spark, SF_SMALL).collect()}
    assert whole == rows  # ranges do not matter
    out = fingerprints.with_edits(messy).collect()
    assert len(out) == len(MESSY) and [r["near_next"] for r in out if r["doc_id"] is None] == [None]
    assert fingerprints.with_edits(empty).count() == 0
    one = fingerprints.with_edits(messy.where("doc_id = 9")).first()
    assert one["near_next"] == 1.0 and one["fingerprint"]  # the only document follows itself


def test_fingerprints_of_a_hot_key(spark):
    """A third of the rows share a key: they are cut into ranges by their texts, and each has the next row's text."""
    rows = [(i, f"text {i} of many words {i * 7}") for i in range(200)] + [(77, f"other text {i}") for i in range(100)] + [(None, "no key")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few, many = (fingerprints.with_edits(df, rows_per_range=n).orderBy("doc_id", "n_chars", "edited_sha256", "fingerprint").collect() for n in (10_000, 7))
    assert few == many and len(few) == len(rows)
    ordered = df.where("doc_id is not null").orderBy("doc_id", F.xxhash64("text"), "text").collect()
    want = sorted((a["doc_id"], sha(fingerprints.edited(a["text"], b["text"]))) for a, b in zip(ordered, ordered[1:] + ordered[:1]))
    assert sorted((r["doc_id"], r["edited_sha256"]) for r in many if r["doc_id"] is not None) == want
    assert {r["edited_sha256"] for r in many if r["doc_id"] is None} == {None}


def plain(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4)))


def test_near_dedup_finds_clear_copies_and_leaves_others(spark):
    t = texts(spark)
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op4_near_dedup"](spark, SF_SMALL).collect()}
    s = {i: plain(x) for i, x in t.items()}
    for i, j in itertools.combinations(sorted(s), 2):
        like = len(s[i] & s[j]) / len(s[i] | s[j])
        if like >= 0.84:
            assert got[i] == got[j]
        if got[i] == got[j] and like < 0.75:  # joined by way of others only
            assert any(got[k] == got[i] and k not in (i, j) for k in s)


def test_near_dedup_recall_just_above_the_threshold(spark):
    """Pairs whose plain similarity is between 0.80 and 0.84: words of a text replaced by other words of the corpus."""
    rng = random.Random(1)
    base = [(i, t.split()) for i, t in sorted(texts(spark).items()) if 60 <= len(t.split()) <= 2000]
    vocabulary = [w for _, words in base for w in words]
    rows, pairs = [], 0
    for i, words in base:
        copy, s, goal = list(words), plain(" ".join(words)), rng.uniform(0.80, 0.84)
        for k in rng.sample(range(len(words)), len(words)):
            more = list(copy)
            more[k] = rng.choice(vocabulary)
            t = plain(" ".join(more))
            if len(s & t) / len(s | t) < goal:
                break
            copy = more
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    s = {i: plain(t) for i, t in rows}
    close = [i for i, _ in base if 0.8 <= len(s[2 * i] & s[2 * i + 1]) / len(s[2 * i] | s[2 * i + 1]) < 0.84]
    assert len(close) >= 20 and sum(got[2 * i] == got[2 * i + 1] for i in close) >= 0.9 * len(close)


def test_near_dedup_counts_every_word_at_every_size(spark):
    """A word that comes once in a task's rows counts there too, however many rows the task has."""
    rows = [(f"own{i} " + ("shared" if i == 0 or i >= 33 else "other"),) for i in range(40)]  # once in the first 20, 7 times in the others
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "text string")
    words, values, rest = near_dedup.word_weights(docs, common=0.2)
    assert {*words.tolist()} == {*word_hashes.word_hashes(["shared other"])[0].tolist()}
    n = {h: c for h, c in zip(word_hashes.word_hashes(["shared other"])[0].tolist(), (8, 32))}
    value = lambda k: 1 + near_dedup.SPREAD * math.log(41 / (k + 1)) / math.log(41 / 9 + 1)
    assert np.allclose(values, [value(n[w]) for w in words.tolist()]) and math.isclose(rest, value(8))


def test_near_dedup_hot_group_and_messy(spark, messy, empty, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    rows = []
    for d in range(400):  # one group whose members differ in a few places each, so that many pairs are near the threshold
        w = list(base)
        for k in rng.integers(0, 120, d % 5):
            w[k] = f"n{d}_{k}"
        rows.append((d, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    s = {i: plain(x) for i, x in rows}
    parent = {i: i for i in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(s, 2):
        if len(s[i] & s[j]) / len(s[i] | s[j]) >= 0.83:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    assert all(got[i] == got[find(i)] for i in s)
    with monkeypatch.context() as patch:  # the bucket in many parts, none of its tables broadcast by hint
        patch.setattr(near_dedup, "BLOCK", 16)
        patch.setattr(near_dedup, "small", lambda df: df)
        assert got == {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    out = {(r["doc_id"], r["class_id"]) for r in near_dedup.classes(messy).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3)} <= out
    assert near_dedup.classes(empty).count() == 0
    assert sorted(r["doc_id"] for r in near_dedup.keep_one(messy).where("doc_id < 6").collect()) == [1, 3]


def test_near_dedup_finds_rows_without_their_ids(spark):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(40))
    rows = [(None, text(0)), (None, text(1)), (None, text(1)), (None, text(2) + " end"), (7, text(3)), (7, text(4)), (7, text(4)), (8, text(4).upper()), (9, text(2))]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted((r["doc_id"] or 0, r["text"]) for r in near_dedup.keep_one(docs).collect())
    assert left == sorted([(0, text(0)), (0, text(1)), (7, text(3)), (7, text(4)), (9, text(2))])
    got = Counter((r["doc_id"], r["class_id"], r["class_size"], r["kept"]) for r in near_dedup.classes(docs).collect())
    assert got == Counter({(None, None, 1, True): 1, (None, None, 2, True): 1, (None, None, 2, False): 1, (None, 9, 2, False): 1, (7, 7, 1, True): 1,
                           (7, 7, 3, True): 1, (7, 7, 3, False): 1, (8, 7, 3, False): 1, (9, 9, 2, True): 1})


def test_tiles_equal_pairs():
    s = near_dedup.Shingles(np.zeros(0, np.uint64), np.zeros(0), 2.0)
    t = ["", "q", "a a a a a a a a a", "a a a a a a a", "b c d e f g h", "x b c d e f g h", "b c d e f g h b c d e f g h"]
    sets = [x[1:] for x in s.counted(t)]
    want = [[near_dedup.similarity((a, w * n), (b, v * m)) for b, v, m in sets] for a, w, n in sets]
    assert np.allclose(near_dedup.similarities(sets, sets, 3), want)


def test_language_id(spark, messy, empty):
    docs = documents(spark, SF_SMALL)
    rows = QUERIES["op5_language_id"](spark, SF_SMALL).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == r["lang"] for r in out) >= 0.95 * len(out) and all(0 <= r["score"] <= 1 for r in rows)
    model = language_id.fit(docs)
    got = Counter((r["doc_id"], r["lang_pred"] == "und", r["score"] == 0) for r in language_id.predict(messy, model).collect())
    assert got[3, True, True] == got[4, True, True] == got[5, True, True] == got[6, True, True] == 1 and got[7, False, False] == 1
    text_df = Counter(int(b) for r in docs.where("lang is not null").collect() if (x := language_id.features(r["text"] or "")) is not None
                      for b in np.flatnonzero(x))
    known = sum(language_id.features(r["text"] or "") is not None for r in docs.where("lang is not null").collect())
    df = np.array([text_df[b] for b in range(language_id.BUCKETS)])
    assert np.allclose(model["idf"], 1 + np.log((known + 1) / (df + 1)))  # frequencies of all rows, added up on the cluster
    assert language_id.predict(empty, model).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(messy, language_id.fit(empty)).collect()} == {"und"}
    text = "Der Hund, \u00e9t\u00e9 42 "
    assert (language_id.features(text * 3) > 0).sum() >= (language_id.features(text) > 0).sum() and language_id.features("12 !") is None


def test_language_id_holds_few_texts_at_once(spark):
    """The pipeline's memory finding: a task had 10,000 whole texts at once, as an Arrow batch and as Python strings."""
    import tracemalloc

    import pyarrow as pa

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("the word "), F.col("id").cast("string"), F.lit(" ")), 150).alias("text"),
                                             F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(1).alias("n_chars"))
    language_id.fit(docs)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([b.num_rows], pa.int64()), "bytes": pa.array([b.nbytes], pa.int64())})

    got = docs.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in got) == 6000 and max(r["bytes"] for r in got) < 6e6
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "50m")  # a bound of the session's own stays
    language_id.predict(docs, {"languages": [], "idf": np.ones(1), "weights": np.zeros((0, 1)), "temperature": 1.0})
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "50m"
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    batch = pa.RecordBatch.from_pydict({"text": pa.array([f"{i} " + "t" * 10_000 for i in range(4000)])})
    tracemalloc.start()
    n = sum(len(t) for _, t in text_slices(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 4000 and peak < 8e6


def test_text_slices_cuts():
    import pyarrow as pa

    for t in ([], [None], ["", None, ""], ["abc", None, "\u00e9\U0001F600", "", "xyzxyzxyz", "a", "", ""], ["abcd"], ["ab", "cd", "ef", "g"]):
        want, at, total = [], 0, 0
        for i, x in enumerate(t):  # a slice ends with the text that brings it to the bound
            total += len(x or "")
            if total >= 4 or i == len(t) - 1:
                want.append([x or "" for x in t[at:i + 1]])
                at, total = i + 1, 0
        whole = pa.RecordBatch.from_pydict({"k": pa.array([0, 0, *range(len(t))], pa.int64()), "text": pa.array(["gone", None, *t], pa.string())})
        got = list(text_slices(iter([whole.slice(2)]), 4))
        assert [x for _, x in got] == want and [b.column("k").to_pylist() for b, _ in got] == [list(range(i, i + len(x))) for i, x in zip(np.cumsum([0, *map(len, want)]), want)]


def test_exact_dedup_messy_collisions_and_batches(spark, messy, empty):
    path = scratch_path(spark, "dedup-in")
    messy.drop("Text").repartition(3).write.parquet(path)
    for digest, files in ((exact_dedup.sha256_of, 100), (lambda c: F.substring(F.md5(c), 1, 1), 1)):
        rows = exact_dedup.dedup(spark, path, digest=digest, files_per_batch=files).collect()
        assert len(rows) == len(MESSY)
        by = {}
        for r in rows:
            by.setdefault((r["keep_id"], r["group_size"]), []).append(r["kept"])
        assert by[1, 3].count(True) == 1 and by[3, 2].count(True) == 1 and by[5, 1] == [True] and by[None, 1] == [True]
        assert all(v.count(True) == 1 for k, v in by.items())
    none = scratch_path(spark, "dedup-none")
    empty.drop("Text").write.parquet(none)
    assert exact_dedup.dedup(spark, none).count() == 0


def test_chat_messy(spark):
    kinds = "conv_id long, turn int, role string, text string, extra int"
    c = spark.createDataFrame([(1, 0, "user", "hi", 0), (1, 0, "user", "hi", 0), (1, 1, "assistant", "a <|im_end|>", 0), (None, 0, "user", "lost", 0),
                               (2, None, None, None, 0), (2, 0, "user", "b", 0), (2, 0, "user", "a", 0)], kinds)
    r = spark.createDataFrame([(1, 0, "user", "hi", 0), (1, 1, "assistant", "z", 0), (1, 2, "user", "more", 0), (2, 0, "user", "a", 0), (2, None, "user", "", 0)], kinds)
    out = chat_format.format_preferences(*(chat_format.turns(x).withColumnRenamed("conv", "pair") for x in (c, r)))
    one = {x["pair"]: x for x in chat_format.assembled(out).collect()}
    assert one[1]["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    assert one[1]["chosen"] == "<|im_start|>assistant\na <| im_end|><|im_end|>\n"
    a, b = one[1]["rejected_loss"][0]
    assert one[1]["rejected"][a:b] == "z<|im_end|>\n"
    assert one[2]["chosen"] == one[2]["rejected"] == "" and one[2]["prompt"].count("<|im_start|>") == 2
    assert chat_format.format_preferences(*(chat_format.turns(x.limit(0)).withColumnRenamed("conv", "pair") for x in (c, r))).count() == 0


@pytest.mark.parametrize("ranges", [1, 7])
def test_every_reply_makes_a_pair(spark, messy, empty, ranges):
    """Sparse identifiers, one conversation without a reply, turns beyond 2^31, rows that repeat, clashing columns."""
    kinds = "conv_id long, turn long, role string, text string, Text string"
    ids = [4, 8, 1 << 40, 90, 91, 200, -6]
    rows = [(i, t, role, f"{role} {t} of {i}", "x") for i in ids for t, role in ((0, "user"), (1 << 33, "assistant"))]
    rows += [(7, 0, "user", "no reply", ""), (None, 0, "assistant", "lost", ""), (4, 0, "user", "user 0 of 4", "x"), (8, 1 << 34, "user", "x" * 100_000, "")]
    turns = chat_format.turns(spark.createDataFrame(rows, kinds))
    out = chat_format.format_preferences(*chat_format.swapped_replies(turns, ranges)).collect()
    order = sorted(ids)
    assert sorted({r["pair"] for r in out}) == order
    for i, n in zip(order, order[1:] + order[:1]):
        said = {r["part"]: r["rendered"] for r in out if r["pair"] == i and r["role"] == "assistant"}
        assert f"of {i}<" in said["chosen"] and f"of {n}<" in said["rejected"] and f"user 0 of {i}" in [r for r in out if r["pair"] == i and r["part"] == "prompt"][0]["rendered"]
    one = chat_format.turns(spark.createDataFrame(rows[:2], kinds))
    assert [r["part"] for r in chat_format.format_preferences(*chat_format.swapped_replies(one, ranges)).collect()] == ["prompt"] * 2
    assert chat_format.format_preferences(*chat_format.swapped_replies(chat_format.turns(spark.createDataFrame([], kinds)), ranges)).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, u in ((1, 1), (5, 1000), (1000, 1000), (20_000, 1 << 62), (3000, 4000)):
        v = np.unique(rng.integers(0, u, n, dtype=np.uint64))
        e = elias_fano.EliasFano(elias_fano.encode(v, u))
        i, hit = e.successor(np.concatenate([v, rng.integers(0, u, 500, dtype=np.uint64)]))
        assert hit[:len(v)].all() and (i[:len(v)] == np.arange(len(v))).all() and (e.values(np.arange(len(v))) == v).all()
    w = np.sort(rng.integers(0, 50, 3000).astype(np.uint64))
    assert (elias_fano.EliasFano(elias_fano.encode(w, 50)).values(np.arange(3000)) == w).all()


def test_word_hashes_agree_with_words():
    t = ["", " a B  c\n", "x" * 3_000_000 + " a", "b\x0bA \u00c9", LONG]
    h, cuts = word_hashes.word_hashes(t)
    words = [w for x in t for w in x.encode().lower().split()]
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words)) == len(set(zip(h.tolist(), words)))
    assert np.diff(cuts).tolist() == [len(x.encode().split()) for x in t]


def test_shards_search_equal_keys_once_and_in_rising_order(tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    all_keys = np.unique(rng.integers(100, 1 << 40, 5_000).astype(np.uint64))
    rows, parts = [], np.array_split(all_keys, 11)
    for v in parts:
        own = elias_fano.encode(v - v[0], int(v[-1] - v[0]) + 1)
        rows.append(([elias_fano.save(str(tmp_path), "s", {f"k_{x}": a for x, a in own.items()})], int(v[0]), len(v), len(v)))
    keys = np.concatenate([rng.choice(all_keys, 3_000), rng.integers(0, 1 << 41, 3_000).astype(np.uint64), all_keys[:1] - np.uint64(1), all_keys[-1:]])
    searched, search = [], elias_fano.EliasFano.successor
    monkeypatch.setattr(elias_fano.EliasFano, "successor", lambda self, k: searched.append(k) or search(self, k))
    for n in (1, 3, 11):
        place = {int(k): i for i, k in enumerate(np.concatenate(parts[:n]).tolist())}
        searched.clear()
        assert lm_scoring.Shards(rows[:n]).find(keys).tolist() == [place.get(int(k), -1) for k in keys.tolist()]
        assert sum(map(len, searched)) <= len(set(keys.tolist()))
        assert all((k[1:] > k[:-1]).all() for k in searched)
    assert lm_scoring.Shards(rows).find(keys[:0]).tolist() == [] and lm_scoring.Shards([]).find(keys[:2]).tolist() == [-1, -1]


def test_lm_scoring_against_brute_force(spark, messy, empty):
    t = {i: [*x.encode().lower().split(), None] for i, x in texts(spark).items()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    uni = Counter(w for i, x in t.items() if not held(i) for w in x)
    bi = Counter(p for i, x in t.items() if not held(i) for p in zip([None, *x], x))
    bi = {k: n for k, n in bi.items() if n >= 2}
    a, b = (sum(n == k for n in bi.values()) for k in (2, 3))
    d = min(0.95, max(0.3, a / (a + 2 * b)))
    total, kinds = sum(uni.values()), len(uni)
    model = lm_scoring.train(documents(spark, SF_SMALL).where(~lm_scoring.held_out()), order=2)
    rows = {r["doc_id"]: r for r in lm_scoring.score(documents(spark, SF_SMALL), model).collect()}
    kept = {}
    for (u, _), n in bi.items():
        s = kept.setdefault(u, [0, 0])
        s[0], s[1] = s[0] + n, s[1] + 1
    for i, x in t.items():
        base = own = 0.0
        for u, w in zip([None, *x], x):
            p = (uni[w] + 0.5) / (total + 0.5 * (kinds + 1))
            base += math.log10(p)
            if u in kept:
                p = p * (1 - (kept[u][0] - d * kept[u][1]) / uni[u]) + max(bi.get((u, w), 0) - d, 0) / uni[u]
            own += math.log10(p)
        r = rows[i]
        assert (r["n_tokens"], r["n_known"]) == (len(x), sum(uni[w] > 0 for w in x)) and abs(r["base_score"] - base) < 1e-6 * -base
        assert abs(r["score"] - own) < 0.02 * len(x)  # ratios are quantised
    q = [r for r in QUERIES["op9_lm_scoring"](spark, SF_SMALL).collect() if r["held_out"]]
    assert sum(r["score"] for r in q) > sum(r["base_score"] for r in q)
    model = lm_scoring.train(messy)
    assert lm_scoring.score(messy, model).count() == len(MESSY) and lm_scoring.score(empty, model).count() == 0
    none = lm_scoring.score(messy, lm_scoring.train(empty)).collect()
    assert all(r["n_known"] == 0 and r["score"] == r["base_score"] == 0 for r in none)


def test_lm_scoring_keeps_what_came_once(spark):
    t = {i: [*x.encode().lower().split(), None] for i, x in texts(spark).items()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    grams = [Counter(), Counter(), Counter()]
    for i, x in t.items():
        if not held(i):
            grams[0].update((w,) for w in x)
            grams[1].update(zip([None, *x], x))
            grams[2].update(zip([None, *x], x, x[1:]))
    total, kinds = sum(grams[0].values()), len(grams[0])
    kept = [{}, {}]
    cut = []
    for k in (1, 2):
        a, b = (sum(n == c for n in grams[k].values()) for c in (1, 2))
        cut.append(min(0.95, max(0.3, a / (a + 2 * b))))
        for g, n in grams[k].items():
            s = kept[k - 1].setdefault(g[:-1], [0, 0])
            s[0], s[1] = s[0] + n, s[1] + 1
    for r in QUERIES["op9_lm_scoring"](spark, SF_SMALL).collect():
        own, x = 0.0, t[r["doc_id"]]
        for j, w in enumerate(x):
            p = (grams[0][w,] + 0.5) / (total + 0.5 * (kinds + 1))
            for k, context in ((1, ([None, *x][j],)), (2, tuple([None, *x][j - 1:j + 1]) if j else None)):
                if context in kept[k - 1]:
                    n, children = kept[k - 1][context]
                    c = grams[k - 1][context]
                    p = p * (1 - (n - cut[k - 1] * children) / c) + max(grams[k][*context, w] - cut[k - 1], 0) / c
            own += math.log10(p)
        assert abs(r["score"] - own) < 0.02 * len(x)  # ratios are quantised


def test_line_dedup_messy(spark, messy, empty):
    out = line_dedup.clean(messy, "doc_id", "source", "text").collect()
    assert len(out) == len(MESSY) and all(r["n_dropped"] == 0 for r in out)
    rows = [(i, f"h{i % 2}", f"menu\nown {i}\n\nmenu\r") for i in range(12)] + [(99, None, None), (100, "h0", "menu")]
    out = {r["key"]: r for r in line_dedup.clean(spark.createDataFrame(rows, "k long, h string, t string"), "k", "h", "t").collect()}
    assert out[3]["text"] == "own 3\n" and out[3]["n_dropped"] == 2 and out[100]["text"] == "" and out[100]["n_dropped"] == 1
    assert out[99]["n_lines"] == 1 and out[99]["n_dropped"] == 0
    few = [(1, "one", "menu\nown a"), (2, "two", "menu\nown b"), (3, "two", "menu\nown c"), (4, "two", "menu")]
    out = {r["key"]: r["text"] for r in line_dedup.clean(spark.createDataFrame(few, "k long, h string, t string"), "k", "h", "t").collect()}
    assert out == {1: "menu\nown a", 2: "own b", 3: "own c", 4: ""}  # a host of one page repeats nothing
    assert line_dedup.clean(empty, "doc_id", "source", "text").count() == 0
    assert line_dedup.clean_documents(messy).count() == len(MESSY)


def without_boilerplate(rows):
    """(doc_id, source, text) rows by hand: trimmed lines on two texts of a source and on more than a tenth of them go."""
    pages, lines = {}, {}
    for _, source, text in rows:
        pages.setdefault(source, set()).add(text or "")
    for source, those in pages.items():
        lines[source] = Counter(x for t in those for x in {y.strip(" \t\r") for y in t.split("\n")} - {""})
    drop = {s: {x for x, n in c.items() if n > 1 and n > 0.1 * len(pages[s])} for s, c in lines.items()}
    return {i: t if not drop[s] or t is None else "\n".join(y for y in t.split("\n") if y.strip(" \t\r") not in drop[s]) for i, s, t in rows}


def copies_in_mix(rows):
    """(doc_id, source, text) rows by hand: how often each document comes."""
    size = {i: len([w for w in re.split("[\x20\x09-\x0D]+", t or "") if w]) for i, _, t in rows}
    sources = sorted({s for _, s, _ in rows if s is not None}) + [None] * any(s is None for _, s, _ in rows)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    total = {s: sum(size[i] for i, x, _ in rows if x == s) for s in sources}
    target, rest, free = {}, 1.5 * sum(size.values()), set(sources)
    while True:  # full sources leave, the others share what is left
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * total[s]}
        if not full:
            break
        for s in full:
            target[s], rest = 2 * total[s], rest - 2 * total[s]
        free -= full
    target |= share
    out = Counter()
    for s in sources:
        mine = [(int(hashlib.md5(f"mix:{{{i}, {'null' if s is None else s}, {hashlib.md5((t or '').encode()).hexdigest()}}}".encode()).hexdigest()[:15], 16), i)
                for i, x, t in rows if x == s]
        budget = int(target[s])
        epochs, left = divmod(budget, total[s]) if total[s] else (0, 0)
        for _, i in sorted(mine):
            part = max(0, min(size[i], left))
            left -= part
            if n := math.floor((epochs * size[i] + part) / size[i] + 0.5) if size[i] else 0:
                out[i] = n
    return out


def test_pipeline_stages_against_brute_force(spark):
    stage = dict(corpus_pipeline.STAGES)
    docs = documents(spark, SF_SMALL)
    rows = [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()]
    cleaned = {r["doc_id"]: r["text"] for r in stage["line_dedup"](spark, docs, SF_SMALL).collect()}
    assert cleaned == without_boilerplate(rows)
    s = {i: plain(t) for i, _, t in rows}
    like = {(i, j): len(s[i] & s[j]) / len(s[i] | s[j]) for i, j in itertools.combinations(sorted(s), 2)}
    left = {r["doc_id"] for r in stage["near_dedup"](spark, docs, SF_SMALL).collect()}
    assert all(v < 0.84 for (i, j), v in like.items() if i in left and j in left)
    assert all(any(v >= 0.75 for (i, j), v in like.items() if j == gone or i == gone) for gone in set(s) - left)
    assert all(min((i for (i, j), v in like.items() if j == k and v >= 0.75), default=k) == k or k not in left or
               max(v for (i, j), v in like.items() if j == k) < 0.84 for k in s)
    mixed = Counter(r["doc_id"] for r in stage["mix_sources"](spark, docs, SF_SMALL).collect())
    assert mixed == copies_in_mix(rows)


def plain_ftrl(rows, y, n_classes):
    """Follow the regularised leader coordinate by coordinate."""
    L = language_id
    z, n = ({(c, b): 0.0 for c in range(n_classes) for at, _ in rows for b in at} for _ in range(2))

    def weight(k):
        return 0.0 if abs(z[k]) <= L.L1 else -(z[k] - math.copysign(L.L1, z[k])) / ((L.BETA + math.sqrt(n[k])) / L.ALPHA + L.L2)

    order = np.random.default_rng(7)
    for _ in range(L.EPOCHS):
        for r in order.permutation(len(rows)):
            at, v = rows[r]
            score = [sum(weight((c, b)) * x for b, x in zip(at, v)) for c in range(n_classes)]
            top = max(score)
            e = [math.exp(x - top) for x in score]
            for c in range(n_classes):
                for b, x in zip(at, v):
                    g = (e[c] / sum(e) - (c == y[r])) * x
                    w = weight((c, b))
                    z[c, b] += g - (math.sqrt(n[c, b] + g * g) - math.sqrt(n[c, b])) / L.ALPHA * w
                    n[c, b] += g * g
    return {k: weight(k) for k in z}


def test_ftrl_equals_a_plain_one():
    rng = np.random.default_rng(5)
    y = np.arange(24) % 3
    rows = [(np.sort(rng.choice(40, 6, replace=False)) + 10 * c, rng.random(6)) for c in y]
    got = language_id.ftrl(rows, y, 3)
    want = plain_ftrl(rows, y, 3)
    assert np.allclose([got[k] for k in want], list(want.values()), atol=1e-9) and np.count_nonzero(got) > 10


def test_pipeline(spark, messy, empty):
    docs = documents(spark, SF_SMALL)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF_SMALL), f"test-{name}")
        seen[name] = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(seen[n].columns == ["doc_id", "text", "lang", "source", "n_chars"] for n in names[:-1])
    assert seen["language_id"].count() >= 0.95 * documents(spark, SF_SMALL).count()
    assert near_dedup.classes(seen["near_dedup"]).where("class_size > 1").count() == 0
    mixed = Counter(r["source"] for r in seen["mix_sources"].collect())
    assert sum(mixed.values()) == seen["bpe_encode"].count()
    ref = Tokenizer.from_file(bpe.default_vocabulary())
    want = Counter((r["doc_id"], tuple(ref.encode(r["text"], add_special_tokens=False).ids)) for r in seen["mix_sources"].collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in seen["bpe_encode"].collect()) == want
    back = bpe.decode(seen["bpe_encode"], bpe.build_lexicon(seen["mix_sources"]))
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((r["doc_id"], r["text"]) for r in seen["mix_sources"].collect())
    for odd in (messy, empty):
        docs = odd
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SF_SMALL), f"odd-{name}")
        assert docs.columns == ["doc_id", "source", "ids", "n_tokens"]
