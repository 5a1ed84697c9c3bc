"""Decontamination, VA-file clustering and spelling variants against SQL twins and brute force, and on messy tables."""

import hashlib
import os
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import SF_SMALL  # noqa: E402
from oracle import compare, duck  # noqa: E402

from emberline.llm import decontaminate, spelling, va_clusters  # noqa: E402
from emberline.llm.catalog import ORACLES, QUERIES  # noqa: E402
from emberline.llm.common import documents, written  # noqa: E402
from emberline.session import ship_package  # noqa: E402

KINDS = "doc_id long, text string, Text string, key string, n int"
ITEM = "one Two three four five six seven eight nine ten eleven twelve"
LONG = " ".join(f"filler{i % 9973}" for i in range(200_000))
ROWS = [
    (1, f"before {ITEM.upper()} after", "x", "k", 1), (1, f"before {ITEM.upper()} after", "x", "k", 1), (2, None, None, None, None),
    (3, "", "", "", 0), (4, "?! \n", None, None, None), (None, ITEM.replace(" ", "--"), None, None, None), (5, "one two three", "a", "b", 2),
    (6, f"{LONG} {ITEM} {LONG}", "a", "b", 2), (7, "Kur-zé 中文 ende", "a", "b", 2), (8, "nine ten eleven twelve", "a", "b", 2),
    (9, "two three four five six seven eight nine ten eleven", "a", "b", 2),
]
ITEMS = [(11, ITEM, "p"), (7, ITEM, "q"), (None, "three", "r"), (12, None, "s"), (13, "", "t"), (14, "kur zé", "u"), (14, "kur zé", "u")]


@pytest.fixture(scope="module", autouse=True)
def package(spark):
    ship_package(spark)
    spark.conf.set("spark.sql.caseSensitive", "true")
    yield
    spark.conf.set("spark.sql.caseSensitive", "false")


# ---------------------------------------------------------------- decontamination

def words(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)


def expected_hits(rows, items, window=10):
    kinds = {}
    for ident, text in items:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            kinds.setdefault(tuple(w[i:i + k]), set()).add(ident)
    out = []
    for ident, text in rows:
        w, hit, found = words(text), set(), set()
        for kind, owners in kinds.items():
            for i in range(len(w) - len(kind) + 1):
                if w[i] == kind[0] and tuple(w[i:i + len(kind)]) == kind:
                    hit |= set(range(i, i + len(kind)))
                    found |= owners
        out.append((ident, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def ordered(rows):
    return sorted(rows, key=repr)


def test_decontamination_equals_sql(spark):
    ok, why = compare(QUERIES["op11_decontaminate"](spark, SF_SMALL), duck(SF_SMALL), ORACLES["op11_decontaminate"])
    assert ok, why


@pytest.mark.parametrize("bound", [decontaminate.BOUND, 300])
def test_decontamination_of_messy_rows(spark, bound):
    docs, items = spark.createDataFrame(ROWS, KINDS), spark.createDataFrame(ITEMS, "item_id long, text string, Text string")
    got = decontaminate.scan(docs, items, bound=bound).collect()
    want = expected_hits([r[:2] for r in ROWS], [i[:2] for i in ITEMS])
    assert ordered((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in got) == ordered(want)
    texts = {r[0]: r[1] for r in ROWS}
    for r in got:  # the spans hold the hit words and nothing else
        assert sum(len(words(texts[r["doc_id"]][s["start"]:s["end"]])) for s in r["spans"]) == r["n_hit"]


def test_removal_of_spans_and_documents(spark):
    docs, items = spark.createDataFrame(ROWS, KINDS), spark.createDataFrame(ITEMS, "item_id long, text string, Text string")
    left = decontaminate.remove_spans(docs, items)
    assert left.columns == docs.columns and left.count() == len(ROWS)
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert texts[1] == "before  after" and texts[2] is None and texts[3] == "" and texts[5] == "one two " and texts[8] == ROWS[9][1]
    assert texts[6] == f"{LONG}  {LONG}" and texts[7] == " 中文 ende"
    assert sorted(r["doc_id"] for r in decontaminate.remove_documents(docs, items).select("doc_id").collect()) == [2, 3, 4, 8]


def test_decontamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame(ROWS, KINDS), spark.createDataFrame(ITEMS, "item_id long, text string, Text string")
    assert decontaminate.scan(docs.limit(0), items).count() == 0
    assert decontaminate.scan(docs, items.limit(0)).where("n_hit > 0 or size(items) > 0").count() == 0


def test_equal_hashes_are_told_apart_by_words():
    block = decontaminate.build_set([1], ["one two three"], 10)
    hits = decontaminate.Hits(["one two three", "six one two three"], [block | {"words": np.frombuffer(b"one two fours", np.uint8)}])
    assert hits.n_hit.tolist() == [0, 0]
    assert decontaminate.Hits(["one two three", "six one two three"], [block]).n_hit.tolist() == [3, 3]


# ---------------------------------------------------------------- VA-file

VECTORS = "vec_id long, embedding array<float>, Embedding int, cluster int, key string"


def kmeans(rows, k, rounds, dims, scale=256):
    kept = [(i, [int(np.floor(float(np.float32(e)) * scale)) for e in v]) for i, v in rows
            if v is not None and len(v) == dims and all(e is not None and np.isfinite(e) for e in v)]
    mark = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [list(v) for _, v in sorted(kept, key=mark)[:k]]

    def assigned():
        out = []
        for _, v in kept:
            gaps = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            out.append((min(range(len(gaps)), key=lambda c: (gaps[c], c)), min(gaps)))
        return out

    for _ in range(rounds):
        own = assigned()
        for c in range(len(centres)):
            mine = [v for (_, v), (x, _) in zip(kept, own) if x == c]
            if mine:
                centres[c] = [sum(col) // len(mine) for col in zip(*mine)]
    return [(i, c, d) for (i, _), (c, d) in zip(kept, assigned())], centres


def test_clusters_equal_sql(spark):
    ok, why = compare(QUERIES["op12_va_clusters"](spark, SF_SMALL), duck(SF_SMALL), ORACLES["op12_va_clusters"])
    assert ok, why


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_clusters_equal_brute_force_on_messy_rows(spark, bits, monkeypatch):
    monkeypatch.setattr(va_clusters, "BLOCK", 50)
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(6, 5))
    rows = [(i, (middles[i % 6] + 0.3 * rng.normal(size=5)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(7, [0.25] * 5)] * 150 + [(None, [1.0, -2.0, 0.5, 0.0, 3.0])] * 2  # a hot vector, ties, repeated and null identifiers
    rows += [(900, None), (901, []), (902, [1.0] * 4), (903, [1.0, None, 1.0, 1.0, 1.0]), (904, [float("nan")] * 5), (905, [float("inf")] * 5), (906, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], VECTORS).repartition(5)
    got, centres = va_clusters.cluster(df, "vec_id", "embedding", k=9, dims=5, rounds=4, bits=bits)
    want, expected = kmeans(rows, 9, 4, 5)
    assert centres.tolist() == expected
    assert ordered((r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()) == ordered(want)
    if bits == 8:  # narrow cells leave few vectors to be fetched
        assert got.where("fetched").count() < 0.2 * len(want)


def test_clusters_of_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5], 0, 0, ""), (2, [-0.5, 1.0], 0, 0, "")], VECTORS)
    got, centres = va_clusters.cluster(df, "vec_id", "embedding", dims=2)
    assert sorted((r["vec_id"], r["distance"]) for r in got.collect()) == [(1, 0), (2, 0)] and len(centres) == 2
    none, centres = va_clusters.cluster(df, "vec_id", "embedding", dims=64)
    assert none.count() == 0 and len(centres) == 0 and none.columns == got.columns


def test_intervals_hold_the_distance():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (200, 7))
    inner = np.sort(rng.integers(-250, 250, (7, 15)), axis=1)
    least, most = va_clusters.tables(c := rng.integers(-300, 300, (4, 7)), inner, x.min(axis=0), x.max(axis=0))
    cells = va_clusters.cells_of(x, inner)
    assert (va_clusters.unpack(va_clusters.pack(cells, 4), 4, 7) == cells).all()
    low, high = (sum(t[d][cells[:, d]] for d in range(7)) for t in (least, most))
    exact = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (low <= exact).all() and (exact <= high).all()


# ---------------------------------------------------------------- spelling

def expected_words(rows):
    counts = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def expected_near(counts):
    """Words that become equal without one code point of one or both (at the same place)."""
    holes = {}
    for w in counts:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1:]), set()).add(w)
    near = {w: set() for w in counts}
    for (a, b), group in holes.items():
        for w in group:
            near[w] |= group - {w}
        if a + b in counts:
            near[a + b] |= group
            for w in group:
                near[w].add(a + b)
    return near


def expected_variants(counts):
    near, form = expected_near(counts), {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda o: (-counts[o], o))
            if counts[best] >= 10 * counts[w]:
                form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return out


def found(df):
    return ordered((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def test_spelling_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, SF_SMALL).collect()]
    want = expected_variants(expected_words(rows))
    assert any(w[1] for w in want)
    assert found(QUERIES["op13_spelling_variants"](spark, SF_SMALL)) == ordered(want)


@pytest.mark.parametrize("longest", [spelling.LONGEST, 10])
def test_spelling_of_hot_lists(spark, longest):
    """A third of all words share their beginning, another third their end; short limits halve the lists many times."""
    rng = np.random.default_rng(5)
    tail = lambda k: "".join(rng.choice(list("abé"), k))
    counts = {}
    for i in range(250):
        counts["commonstart" + tail(rng.integers(1, 6))] = int(rng.integers(2, 5000))
        counts[tail(rng.integers(1, 6)) + "commonend"] = int(rng.integers(2, 5000))
        counts[tail(rng.integers(1, 8))] = int(rng.integers(2, 5000))
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    assert found(spelling.variants(df, longest=longest, bucket=300)) == ordered(expected_variants(counts))
    if longest == 10:
        lists = written(spelling.short_lists(written(df, "words"), longest), "lists").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("b") - F.col("a")).alias("w"))
        assert lists.where("n > 10 and w > 1").count() == 0 and lists.where("w < 4").count() > 0


def test_spelling_of_messy_rows(spark):
    rows = [(r[0], r[1]) for r in ROWS] + [(20, "Straßenbahn straßenbahn STRAßENBAHN ÀÉtudiantés"), (None, "repeated repeated repeatd repeatd"), (None, "repeated " * 30)]
    df = spark.createDataFrame([(a, b, "x", "y", 1) for a, b in rows], KINDS)
    assert found(spelling.variants(spelling.noisy_words(df))) == ordered(expected_variants(expected_words(rows)))
    assert spelling.variants(spelling.noisy_words(df.limit(0))).count() == 0
