"""Radius joins and neighbour sums against brute force: near positions, large coordinates, hot spots, many dimensions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import neighbours as G
from emberline.session import ship_package

KINDS = "group_id string, id long, x array<double>, v array<double>, value double"


@pytest.fixture(scope="module", autouse=True)
def package(spark):
    ship_package(spark)


def brute(rows, r):
    out = {}
    for i, (g, a, x, v, _) in enumerate(rows):
        nb = [(y, w) for j, (h, b, y, w, _) in enumerate(rows) if i != j and g == h and 1e-9 < math.sqrt(sum((s - t) ** 2 for s, t in zip(x, y))) < r]
        n, d = len(nb), len(x)
        sep = [math.fsum(y[k] - x[k] for y, _ in nb) for k in range(d)]
        out[a] = (n, sep, [math.fsum(w[k] for _, w in nb) / n for k in range(d)] if n else v, [s / n for s in sep] if n else [0.0] * d)
    return out


def check(spark, rows, r, dim, tolerance=1e-9):
    df = spark.createDataFrame(rows, KINDS).repartition(5)
    want = brute(rows, r)
    got = G.neighbour_terms(df, r, dim=dim).collect()
    assert len(got) == len(rows)
    for t in got:
        n, sep, ali, coh = want[t["id"]]
        assert t["n_nb"] == n, (t["id"], t["n_nb"], n)
        for a, b in ((t["separation"], sep), (t["alignment"], ali), (t["cohesion"], coh)):
            assert all(abs(p - q) <= tolerance * max(1, n) for p, q in zip(a, b))
    assert {t["id"] for t in G.isolated_points(df, r, dim=dim).collect()} == {i for i, w in want.items() if not w[0]}
    pairs = G.radius_neighbours(df, r, dim=dim).groupBy("id").count().collect()
    assert {p["id"]: p["count"] for p in pairs} == {i: w[0] for i, w in want.items() if w[0]}


def table(x, groups=2, seed=0):
    v = np.random.default_rng(seed).normal(size=x.shape)
    return [(str(i % groups), i, x[i].tolist(), v[i].tolist(), 0.0) for i in range(len(x))]


@pytest.mark.parametrize("offset", [0.0, 1e6])
@pytest.mark.parametrize("dim", [1, 2, 3])
def test_sums_with_near_positions_and_large_coordinates(spark, dim, offset):
    """Exact copies, positions 1e-11 to 1e-8 apart (across cell borders too) and a hot spot of a third of all rows."""
    rng = np.random.default_rng(dim)
    x = np.round(rng.uniform(-6, 6, (150, dim)), 2)
    x[100:] = 0.5  # a spot on the border of sub-cells
    x[100:110] += np.where(offset, 0, 1) * rng.uniform(-1, 1, (10, dim)) * 1e-11
    x[110:116] += rng.uniform(-1, 1, (6, dim)) * 5e-10
    x[116:122] -= 4e-9
    x[:20] = x[20:40]
    check(spark, table(x + offset), 2.0, dim, 1e-6 if offset else 1e-9)


@pytest.mark.parametrize("dim", [5, 16, 64])
def test_many_dimensions(spark, dim):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(120, dim)) / math.sqrt(dim)
    x[60:90] = x[0] + rng.normal(size=(30, dim)) * 0.05
    x[90:100] = x[1]
    check(spark, table(x), 1.1, dim)


def test_windows_hold_all_neighbours(spark):
    """Few of the pairs are compared: clusters far apart meet in no window."""
    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(size=(20, 8)) * 50, 10, axis=0) + rng.normal(size=(200, 8)) * 0.1
    df = spark.createDataFrame(table(x, groups=1), KINDS)
    cell, dims = G._windows(df, "x", 2.0, 8)
    keyed = df.select("id", cell.alias("cell"))
    probes = keyed.select("id", F.explode(G.offsets_n("cell", [[a, b, c] for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)], dims)).alias("cell"))
    assert dims == G.PIVOTS and probes.join(keyed.withColumnRenamed("id", "nn"), "cell").count() < 200 * 200 / 5
    assert G.radius_neighbours(df, 2.0, dim=8).count() == 20 * 10 * 9


def test_rows_without_position_and_empty_tables(spark):
    rows = [("a", 1, [0.0, 0.0], [1.0, 1.0], 0.0), ("a", 2, [0.5, 0.0], [3.0, 1.0], 0.0), ("a", 3, None, None, 0.0), ("a", 2, [9.0, 9.0], [0.0, 0.0], 0.0)]
    df = spark.createDataFrame(rows, KINDS)
    assert sorted((r["id"], r["n_nb"]) for r in G.neighbour_terms(df, 1.0, dim=2).collect()) == [(1, 1), (2, 0), (2, 1), (3, 0)]
    for dim in (2, 7):
        assert G.neighbour_terms(df.limit(0), 1.0, dim=dim).count() == 0 and G.radius_neighbours(df.limit(0), 1.0, dim=dim).count() == 0


@pytest.mark.parametrize("dim", [2, 5, 64])
def test_classes_and_tiles_hold_every_link(spark, dim, monkeypatch):
    """Many small tiles; the pairs of classes and the class of each row give back all pairs of rows, copies and null groups included."""
    monkeypatch.setattr(G, "TILE", 8)
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(150, dim)) / math.sqrt(dim)
    x[100:120] = x[:20]
    x[120:140] = x[5]
    x[140:] = x[6] + rng.uniform(-1, 1, (10, dim)) * 1e-10
    rows = table(x) + [(None, 900, x[0].tolist(), x[0].tolist(), 0.0), (None, 901, x[1].tolist(), x[1].tolist(), 0.0), ("0", 902, None, None, 0.0)]
    df = spark.createDataFrame(rows, KINDS).repartition(5)
    want = {(i, j) for i, (g, i_, a, _, _) in enumerate(rows[:150]) for j, (h, j_, b, _, _) in enumerate(rows[:150])
            if g == h and 1e-9 < math.sqrt(sum((s - t) ** 2 for s, t in zip(a, b))) < 0.9}
    got = G.radius_classes(df, 0.9, dim=dim).collect()
    members, links = {}, set()
    for r in got:
        if r["nn_id"] is None:
            members.setdefault((r["group_id"], r["rep_id"]), set()).add(r["id"])
        else:
            links.add((r["group_id"], r["id"], r["nn_id"]))
    assert sum(map(len, members.values())) == 152 and {121, 139} < members[("1", 5)]
    assert {(a, b) for g, p, q in links for a in members[(g, p)] for b in members[(g, q)]} == want
    assert {(r["id"], r["nn_id"]) for r in G.radius_neighbours(df, 0.9, dim=dim).collect()} == want
    assert {r["id"] for r in G.isolated_points(df, 0.9, dim=dim).collect()} == {r[1] for r in rows} - {i for i, _ in want}


@pytest.mark.parametrize("name", ["radius_neighbours", "radius_neighbours_64"])
def test_queries_list_the_pairs_of_all_rows(spark, tmp_path, name):
    """Rows at one position have pairs of their own, repeated keys too, in the query and in its SQL."""
    import __spark_entry__ as entry
    import oracle

    if name == "radius_neighbours":
        made = spark.createDataFrame([(i, f"B{i % 2}", [3, 4, 4, 9][i % 4], 900.0 + 10 * (i % 3)) for i in [*range(30), 7]] + [(40, None, 3, 900.0)],
                                     "p_partkey long, p_brand string, p_size int, p_retailprice double")
        made.write.parquet(str(tmp_path / "part.parquet"))
    else:
        rows = [(i, [float(i % 5 == j) * 0.8 for j in range(64)], i % 2) for i in range(30)]
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = oracle.duckdb.connect()
    for t in tmp_path.iterdir():
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM read_parquet('{t}/*.parquet')")
    got = entry.queries()[name](spark, str(tmp_path))
    assert got.columns == ["group_id", "id", "nn_id", "dist"]
    ok, said = oracle.compare(got, con, entry.oracle_sql()[name])
    assert ok, said
    near = lambda i: sorted(r["nn_id"] for r in got.where(F.col("id") == i).collect())
    assert near(0) and near(0) == near(12 if name == "radius_neighbours" else 10)  # rows at one position


def test_pair_list_with_small_heaps_and_chunks(spark, monkeypatch):
    """Positions of more rows than a heap holds and cells of many chunks lose and repeat no pair."""
    monkeypatch.setattr(G, "HEAP", 4)
    rng = np.random.default_rng(3)
    x = np.round(rng.uniform(-2, 2, (90, 2)), 1)
    x[30:60] = 0.5
    odd = [("0", 900, [0.5, None], None, 0.0), (None, 901, [0.5, 0.5], None, 0.0), ("0", 902, None, None, 0.0), ("1", 903, [float("nan"), 0.5], None, 0.0)]
    df = spark.createDataFrame(table(x) + odd, KINDS).repartition(5)
    want = sorted((i, j) for i in range(90) for j in range(90) if i % 2 == j % 2 and 1e-9 < math.dist(x[i], x[j]) < 1.0)
    assert sorted((r["id"], r["nn_id"]) for r in G.radius_neighbours(df, 1.0).collect()) == want
    assert G.radius_neighbours(df.limit(0), 1.0).count() == 0
