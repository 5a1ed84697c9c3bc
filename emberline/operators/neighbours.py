"""Neighbourhood operators on point tables.

A point table has ``group_id, id, x array<double>, v array<double>, value``. Neighbours are other
rows of the same group with 1e-9 < |a - b| < radius (strict on both sides: a row is not its own
neighbour and neither are exact duplicates). A vector radius is used through its norm.

G1 is a range self-join expressed as an equi-join: rows are keyed by their grid cell (one cell per
``radius`` in every dimension) and probe the 3^d cells around it, then the exact distance filter runs on
the candidates. Only rows that can be within the radius ever meet. The join is on (group, cell) and pairs chunks of
at most some ``HEAP`` rows, which are unpacked after the pairs are dealt over the tasks, so a hot cell is many tasks' work. Beyond ``GRID_DIMS`` dimensions positions are put in order of their
distance to a pivot and cut into blocks of ``TILE``; two blocks are compared by matrix products unless their distances
to one of ``PIVOTS`` pivots are farther apart than the radius (triangle inequality), see ``_tiles``. Where many pairs
are near each other in all pivots the work is quadratic, in tiles of bounded memory dealt over the cluster.

Equal positions are one class. ``radius_neighbours`` lists all pairs of rows, so k copies of a table have k x k as many;
``radius_classes`` lists the pairs of classes and the class of every row instead.

The neighbour sums (G2-G4, G7) never list all pairs, see ``_position_sums``.
"""

from __future__ import annotations

import itertools
import math
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dist, dist_n, floor_div_n, offsets_n, vadd, vsub, zeros_like
from ..session import stored

MIN_DIST = 1e-9
GRID_DIMS = 3  # dimensions up to which rows are keyed by their own grid cell
FLAT_DIMS = 16
PIVOTS = 3
HEAP = 512  # rows of one position that are handled as one, and rows in a chunk of a grid cell
TILE = 2048  # positions in a block beyond GRID_DIMS dimensions (a power of two, so that blocks never cross partitions)
PIVOT_SAMPLE = 64  # rows among which far apart pivots are chosen
WIDER = 1 + 1e-9  # cells are this much wider than the radius, so that rounding never parts neighbours by two cells


def radius_value(radius) -> float:
    """Scalar radius (a vector radius counts through its norm); must be positive."""
    if isinstance(radius, (list, tuple)):
        r = math.sqrt(sum(float(t) * float(t) for t in radius))
    else:
        r = float(radius)
    if not r > 0:
        raise ValueError(f"radius must be positive, got {radius!r}")
    return r


def _dim(df: DataFrame, x_col: str) -> int:
    row = df.select(F.size(x_col).alias("d")).where(F.col("d") > 0).first()
    return int(row["d"]) if row else 0


def _gap(a, b, d: int) -> Column:
    """Distance as element arithmetic, or with array functions where that would be more than the compiler takes."""
    return dist_n(a, b, d) if d <= FLAT_DIMS else dist(a, b)


def _pivots(df: DataFrame, x_col: str) -> list[list[float]]:
    """Rows that lie far apart, chosen one after the other from a sample by hash (fixed number of rows)."""
    rows = [r["x"] for r in df.select(F.col(x_col).alias("x")).where("x is not null").orderBy(F.xxhash64("x"), "x").limit(PIVOT_SAMPLE).collect()]
    if not rows:
        return []
    gap = lambda a, b: math.sqrt(sum((s - t) ** 2 for s, t in zip(a, b)))
    chosen = [rows[0]]
    while len(chosen) < PIVOTS:
        chosen.append(max(rows, key=lambda x: min(gap(x, c) for c in chosen)))
    return [list(map(float, c)) for c in chosen]


def _windows(df: DataFrame, x_col: str, r: float, d: int) -> tuple[Column, int]:
    """Grid cell of a row such that rows nearer than r lie in the same or adjacent cells, and its dimensions."""
    if d <= GRID_DIMS:
        return floor_div_n(x_col, r * WIDER, d), d
    pivots = _pivots(df, x_col)
    if not pivots:
        return F.array(F.lit(0).cast("long")), 1
    away = [_gap(x_col, F.array(*[F.lit(t) for t in p]), d) for p in pivots]
    return F.array(*[F.floor(a / F.lit(r * WIDER)) for a in away]), len(pivots)


def _placed(pos: DataFrame, r: float, d: int) -> DataFrame:
    """Distinct positions (group_id, x, ...) that can have neighbours, with ``uid``, their number in the order of group and
    distance to the first pivot, ``block``, ``TILE`` of them, and ``away``, the distances to all pivots."""
    usable = pos.where(F.col("group_id").isNotNull() & F.forall("x", lambda t: t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf"))))
    pivots = [p for p in _pivots(usable, "x") if len(p) == d]
    away = F.array(*[dist("x", F.array(*[F.lit(t) for t in p])) for p in pivots]) if pivots else F.array().cast("array<double>")
    rows = usable.withColumn("len", F.size("x")).withColumn("away", away)
    order = ["group_id", "len", F.get("away", F.lit(0)), F.xxhash64("x")]
    n = int(pos.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("uid", F.monotonically_increasing_id()), "placed")
    return rows.withColumn("block", F.floor(F.col("uid") / TILE))


def _tiles(placed: DataFrame, r: float) -> DataFrame:
    """(group_id, len, i, j, side, uid, x): the positions of each pair of blocks i <= j that may hold neighbours."""
    k = ["group_id", "len"]
    blocks = placed.groupBy(*k, "block").agg(F.max("away").alias("_a"), *[
        f(F.get("away", F.lit(p))).alias(f"{n}{p}") for p in range(PIVOTS) for n, f in (("lo", F.min), ("hi", F.max))]).drop("_a")
    blocks = stored(blocks, "blocks")
    other = blocks.select(*k, *[F.col(c).alias(f"n_{c}") for c in blocks.columns if c not in k])
    pairs = blocks.join(other, k).where("block <= n_block")
    for p in range(PIVOTS):
        apart = F.greatest(F.col(f"n_lo{p}") - F.col(f"hi{p}"), F.col(f"lo{p}") - F.col(f"n_hi{p}"))
        slack = F.lit(1e-9) * (F.lit(r) + F.col(f"hi{p}") + F.col(f"n_hi{p}"))
        pairs = pairs.where(F.coalesce(apart <= F.lit(r) + slack, F.lit(True)))
    pairs = stored(pairs.select(*k, F.col("block").alias("i"), F.col("n_block").alias("j")), "tiles")
    sides = pairs.select(*k, "i", "j", F.lit(0).alias("side"), F.col("i").alias("block")).unionByName(
        pairs.where("i <> j").select(*k, "i", "j", F.lit(1).alias("side"), F.col("j").alias("block")))
    return sides.join(placed.select(*k, "block", "uid", "x"), [*k, "block"]).select(*k, "i", "j", "side", "uid", "x")


def _tile_sides(table):
    """The two sides of a tile: (uids, vectors) each; a block with itself has the same side twice."""
    import numpy as np

    side = table.column("side").to_numpy()
    uid = table.column("uid").to_numpy()
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(len(uid), -1)
    a = (uid[side == 0], np.ascontiguousarray(x[side == 0]))
    return a, ((uid[side == 1], np.ascontiguousarray(x[side == 1])) if (side == 1).any() else a)


def near_products(A, B, step: int = 512):
    """Chunks (from, squared distances of A[from:...] to all of B by a matrix product, what they may be off by)."""
    b = (B * B).sum(axis=1)
    for at in range(0, len(A), step):
        part = A[at:at + step]
        a = (part * part).sum(axis=1)
        yield at, a[:, None] + b[None, :] - 2.0 * (part @ B.T), 1e-13 * A.shape[1] * (a[:, None] + b[None, :])


def exact_gaps(A, B, i, j, step: int = 65536):
    """Distances of A[i] and B[j], squares added up one after the other as Spark's expression does."""
    import numpy as np

    out = np.empty(len(i))
    for at in range(0, len(i), step):
        diff = A[i[at:at + step]] - B[j[at:at + step]]
        out[at:at + step] = np.sqrt(np.cumsum(diff * diff, axis=1)[:, -1]) if A.shape[1] else 0.0
    return out


def _tile_pairs(placed: DataFrame, r: float) -> DataFrame:
    """(a, b, dist): ordered pairs of position numbers within the radius."""
    def run(table):
        import numpy as np
        import pyarrow as pa

        (ua, A), (ub, B) = _tile_sides(table)
        found = []
        for at, sq, off in near_products(A, B):
            i, j = np.nonzero(sq <= r * r * (1 + 1e-9) + off)
            gap = exact_gaps(A, B, i + at, j)
            hit = (gap > MIN_DIST) & (gap < r)
            found.append((ua[i[hit] + at], ub[j[hit]], gap[hit]))
        a, b, gap = (np.concatenate(c) for c in zip(*found))
        if ub is not ua:
            a, b, gap = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([gap, gap])
        return pa.table({"a": a, "b": b, "dist": gap})

    return _tiles(placed, r).groupBy("group_id", "len", "i", "j").applyInArrow(run, "a long, b long, dist double")


def _tile_hits(placed: DataFrame, r: float) -> DataFrame:
    """(uid): positions with a neighbour. A pair clearly within the radius needs no exact distance."""
    def run(table):
        import numpy as np
        import pyarrow as pa

        (ua, A), (ub, B) = _tile_sides(table)
        has_a = np.zeros(len(ua), bool)
        has_b = has_a if ub is ua else np.zeros(len(ub), bool)
        for at, sq, off in near_products(A, B):
            clear = (sq > 4 * MIN_DIST * MIN_DIST + off) & (sq < r * r * (1 - 1e-9) - off)
            has_a[at:at + len(sq)] |= clear.any(axis=1)
            has_b |= clear.any(axis=0)
            open_ = (sq <= r * r * (1 + 1e-9) + off) & ~clear & ~(has_a[at:at + len(sq), None] & has_b[None, :])
            i, j = np.nonzero(open_)
            gap = exact_gaps(A, B, i + at, j)
            hit = (gap > MIN_DIST) & (gap < r)
            has_a[i[hit] + at] = True
            has_b[j[hit]] = True
        hits = ua[has_a] if ub is ua else np.concatenate([ua[has_a], ub[has_b]])
        return pa.table({"uid": hits})

    return _tiles(placed, r).groupBy("group_id", "len", "i", "j").applyInArrow(run, "uid long").distinct()


def _position_pairs(pos: DataFrame, r: float, d: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(group_id, x, nx, dist, carry of the first, n_carry of the other) of all ordered pairs of distinct positions."""
    placed = _placed(pos, r, d)
    a = placed.select(F.col("uid").alias("a"), "group_id", "x", *carry)
    b = placed.select(F.col("uid").alias("b"), F.col("x").alias("nx"), *[F.col(c).alias(f"n_{c}") for c in carry])
    return _tile_pairs(placed, r).join(a, "a").join(b, "b").select("group_id", "x", "nx", "dist", *carry, *[f"n_{c}" for c in carry])


def _radius_pairs(df: DataFrame, radius, dim: int | None, x_col: str, id_col: str, group_col: str,
                  carry: tuple[str, ...] = ()) -> DataFrame:
    r = radius_value(radius)
    d = dim if dim is not None else _dim(df, x_col)
    cell, dims = _windows(df, x_col, r, d)
    offsets = [list(o) for o in itertools.product((-1, 0, 1), repeat=dims)]
    base = df.select(F.col(group_col).alias("group_id"), F.col(id_col).alias("id"),
                     F.col(x_col).alias("x"), cell.alias("cell"), *[F.col(c) for c in carry])
    probes = base.select("group_id", "id", "x", F.explode(offsets_n("cell", offsets, dims)).alias("cell"))
    targets = base.select("group_id", F.col("id").alias("nn_id"), F.col("x").alias("nx"), "cell",
                          *[F.col(c).alias(f"n_{c}") for c in carry])
    pairs = probes.join(targets, ["group_id", "cell"])
    pairs = pairs.select("group_id", "id", "nn_id", _gap("x", "nx", d).alias("dist"), "x", "nx",
                         *[f"n_{c}" for c in carry])
    return pairs.where((F.col("dist") > MIN_DIST) & (F.col("dist") < r))


def radius_neighbours(df: DataFrame, radius, dim: int | None = None, x_col: str = "x",
                      id_col: str = "id", group_col: str = "group_id") -> DataFrame:
    """G1: (group_id, id, nn_id, dist) for all ordered neighbour pairs of rows, copies included. Distances are taken between heaps of rows
    at one position; the ids of two heaps within the radius are paired where their rows leave, without a join."""
    r = radius_value(radius)
    d = dim if dim is not None else max(1, _dim(df, x_col))
    heaps = _heaps(df, x_col, id_col, group_col)
    pairs = _cell_pairs(heaps, r, d) if d <= GRID_DIMS else _position_pairs(heaps, r, d, ("ids",))
    pairs = pairs.select("group_id", "dist", "n_ids", F.explode("ids").alias("_a"))
    pairs = pairs.select("group_id", "dist", "_a", F.explode("n_ids").alias("_b"))
    return pairs.select("group_id", F.col("_a.id").alias("id"), F.col("_b.id").alias("nn_id"), "dist")


def _heaps(df: DataFrame, x_col: str, id_col: str, group_col: str) -> DataFrame:
    """(group_id, x, ids): the rows at one position, at most ``HEAP`` in a heap. Rows that can have no neighbours are left out. Rows are put
    in order of position and id, so that a position of many rows is dealt over tasks."""
    rows = df.select(F.col(group_col).alias("group_id"), F.col(x_col).alias("x"), F.col(id_col).alias("id"))
    rows = rows.where(F.col("group_id").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda t: t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf"))))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "group_id", "x", "id").sortWithinPartitions("group_id", "x", "id")
    heaps = rows.withColumn("_m", F.floor(F.monotonically_increasing_id() / HEAP)).groupBy("group_id", "x", "_m").agg(
        F.collect_list(F.struct("id")).alias("ids"))
    return stored(heaps.drop("_m"), "heaps")


def _cell_pairs(heaps: DataFrame, r: float, d: int) -> DataFrame:
    """(group_id, ids, n_ids, dist) of all ordered pairs of heaps within the radius, up to ``GRID_DIMS`` dimensions. The heaps of a grid cell
    are packed into chunks of about ``HEAP`` rows; pairs of chunks of adjacent cells are dealt over the tasks, each is unpacked in place."""
    k = ["group_id", "cell"]
    cells = heaps.select("group_id", floor_div_n("x", r * WIDER, d).alias("cell"), F.struct(*[F.col("x")[i].alias(f"x{i}") for i in range(d)], "ids").alias("heap"))
    total = cells.groupBy(*k).agg(F.sum(F.size("heap.ids")).alias("n"))
    part = F.pmod(F.xxhash64("heap"), F.ceil(F.col("n") / HEAP))
    chunks = cells.join(total, k).groupBy(*k, part.alias("part")).agg(F.collect_list("heap").alias("heaps"))
    chunks = stored(chunks.withColumn("chunk", F.monotonically_increasing_id()), "cells")
    steps = [list(o) for o in itertools.product((-1, 0, 1), repeat=d)]
    probes = chunks.select("group_id", F.col("chunk").alias("a"), F.explode(offsets_n("cell", steps, d)).alias("cell"))
    n = int(heaps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = probes.join(chunks.select(*k, F.col("chunk").alias("b")), k).select("a", "b").repartition(n, "a", "b")
    pairs = pairs.join(chunks.select(F.col("chunk").alias("a"), "group_id", "heaps"), "a").join(
        chunks.select(F.col("chunk").alias("b"), F.col("heaps").alias("n_heaps")), "b")
    pairs = pairs.select("group_id", "n_heaps", F.explode("heaps").alias("_p")).select("group_id", "_p", F.explode("n_heaps").alias("_q"))
    x = lambda side: F.array(*[F.col(f"{side}.x{i}") for i in range(d)])
    pairs = pairs.select("group_id", F.col("_p.ids").alias("ids"), F.col("_q.ids").alias("n_ids"), _gap(x("_p"), x("_q"), d).alias("dist"))
    return pairs.where((F.col("dist") > MIN_DIST) & (F.col("dist") < r))


def _classes(df: DataFrame, x_col: str, id_col: str, group_col: str) -> tuple[DataFrame, DataFrame]:
    """Classes of equal positions (group_id, x, cls, rep: the smallest id) and rows (group_id, id, cls, rep)."""
    rows = df.select(F.col(group_col).alias("group_id"), F.col(id_col).alias("id"), F.col(x_col).alias("x")).where(F.col("x").isNotNull())
    rows = stored(rows, "points")
    pos = rows.groupBy("group_id", "x").agg(F.min("id").alias("rep"))
    pos = stored(pos.withColumn("cls", F.monotonically_increasing_id()), "classes")
    same = rows["group_id"].eqNullSafe(pos["group_id"]) & (rows["x"] == pos["x"])
    return pos, stored(rows.join(pos, same).select(rows["group_id"], "id", "cls", "rep"), "class-rows")


def _class_pairs(pos: DataFrame, radius, d: int) -> DataFrame:
    """(group_id, cls, rep, n_cls, n_rep, dist) of all ordered pairs of classes within the radius."""
    r = radius_value(radius)
    if d > GRID_DIMS:
        return _position_pairs(pos, r, d, ("cls", "rep"))
    pairs = _radius_pairs(pos, r, d, "x", "cls", "group_id", carry=("rep",))
    return pairs.select("group_id", F.col("id").alias("cls"), F.col("nn_id").alias("n_cls"), "n_rep", "dist").join(pos.select("cls", "rep"), "cls")


def radius_classes(df: DataFrame, radius, dim: int | None = None, x_col: str = "x",
                   id_col: str = "id", group_col: str = "group_id") -> DataFrame:
    """G1 without expanded copies: (group_id, id, rep_id, nn_id, dist). A row with ``nn_id`` null says that row ``id`` stands at the
    position of the row ``rep_id`` (the smallest id there; a row for every row with a position). The others are the ordered
    neighbour pairs of the positions, by their ``rep_id``: rows are neighbours if and only if their positions are."""
    d = dim if dim is not None else _dim(df, x_col)
    pos, rows = _classes(df, x_col, id_col, group_col)
    members = rows.select("group_id", "id", F.col("rep").alias("rep_id"), F.lit(None).cast(rows.schema["id"].dataType).alias("nn_id"),
                          F.lit(None).cast("double").alias("dist"))
    pairs = _class_pairs(pos, radius, d)
    return members.unionByName(pairs.select("group_id", F.col("rep").alias("id"), F.col("rep").alias("rep_id"), F.col("n_rep").alias("nn_id"), "dist"))


SUB = 4  # sub-cells per radius for the aggregated neighbour sums
FINE = 1e-6  # side of the cells in which positions nearer than MIN_DIST are looked for


def _square_sums(dim: int) -> tuple[Column, Column]:
    """Bounds of the squared distance, in sides, between points of a sub-cell and of the one ``o`` steps away: (most, least)."""
    most = sum(((F.abs(F.col("o")[i]) + 1) * (F.abs(F.col("o")[i]) + 1) for i in range(dim)), F.lit(0))
    least = sum((F.greatest(F.abs(F.col("o")[i]) - 1, F.lit(0)) * F.greatest(F.abs(F.col("o")[i]) - 1, F.lit(0)) for i in range(dim)), F.lit(0))
    return most, least


def _near_pairs(pos: DataFrame, dim: int) -> DataFrame:
    """(group_id, x, nx, n, sv): other positions at most MIN_DIST away. A position is keyed by a fine cell and also probes the
    neighbour cells it is that near to, which is rarely one."""
    cell = [F.floor(F.col("x")[i] / FINE) for i in range(dim)]
    probes = pos.select("group_id", "x", *[F.explode(F.array_distinct(F.array(
        F.floor((F.col("x")[i] - 2 * MIN_DIST) / FINE), cell[i], F.floor((F.col("x")[i] + 2 * MIN_DIST) / FINE)))).alias(f"f{i}")
        if i == 0 else cell[i].alias(f"c{i}") for i in range(dim)])
    for i in range(1, dim):
        keep = [c for c in probes.columns if c != f"c{i}"]
        probes = probes.select(*keep, F.explode(F.array_distinct(F.array(
            F.floor((F.col("x")[i] - 2 * MIN_DIST) / FINE), F.col(f"c{i}"), F.floor((F.col("x")[i] + 2 * MIN_DIST) / FINE)))).alias(f"f{i}"))
    targets = pos.select("group_id", F.col("x").alias("nx"), "n", "sv", *[c.alias(f"f{i}") for i, c in enumerate(cell)])
    pairs = probes.join(targets, ["group_id", *[f"f{i}" for i in range(dim)]])
    return pairs.where((F.col("x") != F.col("nx")) & (_gap("x", "nx", dim) <= MIN_DIST)).select("group_id", "x", "nx", "n", "sv")


def _position_sums(df: DataFrame, radius, dim: int, x_col: str, v_col: str) -> DataFrame:
    """Per group and distinct position x: n_nb, the number of neighbours, ``_s{i}``, the sums of their offsets from x, and
    ``_v{i}``, the sums of their attributes.

    Equal positions become one row with a count first. Up to three dimensions, sub-cells of side radius / SUB make a cell
    table; pairs of *existing* sub-cells come from a join of that table with itself on cells of a whole radius. Sub-cell pairs
    that lie wholly within the radius contribute by their sums, taken from the cell's corner so that large coordinates
    don't cancel; of those that the radius cuts, the positions are compared one by one. The position itself and positions
    not more than MIN_DIST away are taken off again. Beyond three dimensions positions are paired in tiles."""
    r = radius_value(radius)
    pos = stored(df.where(F.col(x_col).isNotNull()).groupBy("group_id", F.col(x_col).alias("x")).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col(v_col)[i]) for i in range(dim)]).alias("sv")), "positions")
    total = lambda pairs: pairs.groupBy("group_id", "x").agg(
        F.sum("n").alias("n_nb"), *[F.sum(F.col("n") * (F.col("nx")[i] - F.col("x")[i])).alias(f"_s{i}") for i in range(dim)],
        *[F.sum(F.col("sv")[i]).alias(f"_v{i}") for i in range(dim)])
    if dim > GRID_DIMS:
        return total(_position_pairs(pos, r, dim, ("n", "sv")).select(
            "group_id", "x", "nx", F.col("n_n").alias("n"), F.col("n_sv").alias("sv")))
    side = r / SUB
    base = pos.select("*", floor_div_n("x", side, dim).alias("cell"))
    base = base.select("*", F.array(*[F.col("x")[i] - F.col("cell")[i] * side for i in range(dim)]).alias("rel"))
    cells = stored(base.groupBy("group_id", "cell").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("n") * F.col("rel")[i]) for i in range(dim)]).alias("s"),
        F.array(*[F.sum(F.col("sv")[i]) for i in range(dim)]).alias("sv")), "cells")
    whole = F.array(*[F.floor(F.col("cell")[i] / SUB) for i in range(dim)])
    steps = [list(o) for o in itertools.product((-1, 0, 1), repeat=dim)]
    probes = cells.select("group_id", "cell", whole.alias("whole")).select("group_id", "cell", F.explode(offsets_n("whole", steps, dim)).alias("whole"))
    others = cells.select("group_id", whole.alias("whole"), F.col("cell").alias("ncell"), "n", "s", "sv")
    met = probes.join(others, ["group_id", "whole"]).select(
        "group_id", "cell", "ncell", "n", "s", "sv", F.array(*[F.col("ncell")[i] - F.col("cell")[i] for i in range(dim)]).alias("o"))
    most, least = _square_sums(dim)
    inside = met.where(most < SUB * SUB).groupBy("group_id", "cell").agg(
        F.sum("n").alias("i_n"), *[F.sum(F.col("s")[i] + F.col("n") * F.col("o")[i] * side).alias(f"i_s{i}") for i in range(dim)],
        *[F.sum(F.col("sv")[i]).alias(f"i_v{i}") for i in range(dim)])
    ring = met.where((most >= SUB * SUB) & (least <= SUB * SUB)).select("group_id", "cell", "ncell")
    cut = base.select("group_id", "x", "cell").join(ring, ["group_id", "cell"]).join(
        base.select("group_id", F.col("cell").alias("ncell"), F.col("x").alias("nx"), "n", "sv"), ["group_id", "ncell"])
    cut = total(cut.where(_gap("x", "nx", dim) < r))
    close = total(_near_pairs(pos, dim))
    rename = lambda t, p: t.select("group_id", "x", *[F.col(c).alias(f"{p}{c}") for c in t.columns[2:]])
    j = (base.join(inside, ["group_id", "cell"], "left").join(rename(cut, "r"), ["group_id", "x"], "left")
         .join(rename(close, "c"), ["group_id", "x"], "left"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select(
        "group_id", "x", (z("i_n") - F.col("n") + z("rn_nb") - z("cn_nb")).alias("n_nb"),
        *[(z(f"i_s{i}") - z("i_n") * F.col("rel")[i] + z(f"r_s{i}") - z(f"c_s{i}")).alias(f"_s{i}") for i in range(dim)],
        *[(z(f"i_v{i}") - F.col("sv")[i] + z(f"r_v{i}") - z(f"c_v{i}")).alias(f"_v{i}") for i in range(dim)])


def neighbour_terms(df: DataFrame, radius, dim: int | None = None, x_col: str = "x",
                    v_col: str = "v") -> DataFrame:
    """G2-G4 in one pass: separation S = sum(n - x) (zero if none), alignment A = mean neighbour v
    (own v if none), cohesion C = mean neighbour x - x (zero if none). Rows without neighbours come
    back through a left join, so the neighbour aggregate is never collected per group."""
    d = dim if dim is not None else _dim(df, x_col)
    sums = _position_sums(df, radius, d, x_col, v_col).withColumnRenamed("x", x_col)
    j = df.join(sums, ["group_id", x_col], "left")
    n = F.coalesce(F.col("n_nb"), F.lit(0))
    has = n > 0
    vector = lambda name: F.array(*[F.col(f"_{name}{i}") for i in range(d)])
    sep = F.when(has, vector("s")).otherwise(zeros_like(x_col))
    ali = F.when(has, F.transform(vector("v"), lambda t: t / n)).otherwise(F.col(v_col))
    coh = F.when(has, F.transform(vector("s"), lambda t: t / n)).otherwise(zeros_like(x_col))
    return j.select(*df.columns, n.alias("n_nb"), sep.alias("separation"), ali.alias("alignment"),
                    coh.alias("cohesion"))


def neighbour_separation(df: DataFrame, radius, **kw) -> DataFrame:
    return neighbour_terms(df, radius, **kw).select("group_id", "id", "separation")


def neighbour_alignment(df: DataFrame, radius, **kw) -> DataFrame:
    return neighbour_terms(df, radius, **kw).select("group_id", "id", "alignment")


def neighbour_cohesion(df: DataFrame, radius, **kw) -> DataFrame:
    return neighbour_terms(df, radius, **kw).select("group_id", "id", "cohesion")


def argmax_argmin(df: DataFrame, group_col: str = "group_id", id_col: str = "id",
                  value_col: str = "value") -> DataFrame:
    """F16: best and worst row per group; ties go to the smaller id. ``max_by``/``min_by`` are
    ordinary (partially pre-aggregated) aggregates, so a hot group is reduced map-side."""
    return df.groupBy(group_col).agg(
        F.max(F.struct(F.col(value_col), (-F.col(id_col)).alias("nid"))).alias("_b"),
        F.min(F.struct(F.col(value_col), F.col(id_col))).alias("_w"),
    ).select(
        F.col(group_col), (-F.col("_b.nid")).alias("best_id"), F.col(f"_b.{value_col}").alias("best_value"),
        F.col(f"_w.{id_col}").alias("worst_id"), F.col(f"_w.{value_col}").alias("worst_value"),
    )


def _extreme_term(df: DataFrame, radius, which: str, x_col: str = "x") -> DataFrame:
    """The best or worst row's position travels in the aggregate, so the table is scanned twice in all and joined once."""
    r = radius_value(radius)
    if which == "best":
        top = F.max(F.struct(F.col("value"), (-F.col("id")).alias("nid"), F.col(x_col).alias("x")))
        ext = df.groupBy("group_id").agg(top.alias("_e")).select("group_id", (-F.col("_e.nid")).alias("_eid"), F.col("_e.x").alias("_ex"))
    else:
        low = F.min(F.struct(F.col("value"), F.col("id"), F.col(x_col).alias("x")))
        ext = df.groupBy("group_id").agg(low.alias("_e")).select("group_id", F.col("_e.id").alias("_eid"), F.col("_e.x").alias("_ex"))
    j = df.join(ext, "group_id")  # one row per group: AQE broadcasts it when its size allows
    dd = dist(x_col, "_ex")
    inr = (dd < r) & (dd > MIN_DIST)
    term = vsub("_ex", x_col) if which == "best" else vadd("_ex", x_col)
    name = "best_offset" if which == "best" else "worst_term"
    return j.select(*df.columns, F.col("_eid").alias(f"{which}_id"),
                    F.when(inr, term).otherwise(zeros_like(x_col)).alias(name))


def best_offset(df: DataFrame, radius, **kw) -> DataFrame:
    """F - x when the group's best row F is within the radius, else zero."""
    return _extreme_term(df, radius, "best", **kw)


def worst_term(df: DataFrame, radius, **kw) -> DataFrame:
    """E + x when the group's worst row E is within the radius, else zero."""
    return _extreme_term(df, radius, "worst", **kw)


def isolated_points(df: DataFrame, radius, dim: int | None = None, x_col: str = "x", v_col: str = "v") -> DataFrame:
    """Rows without any neighbour (neighbour count 0 from the aggregated sums, beyond three dimensions the positions
    that no tile finds a neighbour of; no pair list)."""
    d = dim if dim is not None else _dim(df, x_col)
    if d > GRID_DIMS:
        r = radius_value(radius)
        placed = _placed(df.where(F.col(x_col).isNotNull()).select("group_id", F.col(x_col).alias("x")).distinct(), r, d)
        found = _tile_hits(placed, r).join(placed, "uid").select("group_id", F.col("x").alias(x_col))
        return df.join(found, ["group_id", x_col], "left_anti")
    sums = _position_sums(df, radius, d, x_col, v_col).where(F.col("n_nb") > 0).select("group_id", F.col("x").alias(x_col))
    return df.join(sums, ["group_id", x_col], "left_anti")
