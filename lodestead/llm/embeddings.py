"""Near-duplicate embeddings by counting collisions on one-dimensional projections.

Unit vectors of cosine c or more differ by at most sqrt(2 - 2c), so on a random
projection they lie in each other's window with a known chance. Two counts use
this. Tables of few projections route vectors: each projection is split at its
middle, a vector is at home on its side, and visits the other where its window
reaches over. In a cell those at home meet each other and the visitors. Many
further projections are sorted there; a pair collides as often as one lies in
the window around the other, a stretch of the order, and pairs whose count
passes a bound calibrated for recall are verified by cosine in double precision.

Vectors that are equal bit for bit are one class and one row of the search.
Cells are cut into tiles of bounded size, each pair of tiles a task of its own,
and a tile gives back sums and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, settle

COSINE = 0.95
RECALL = 0.999
#: Vectors at home in a cell that routing aims at, and on either side of a tile, about, at most.
CELL, TILE, TILE_RIGHT = 400, 1024, 4096
#: Projections counted in a cell, and the half width of windows in deviations of a pair at the limit.
COUNTED, REACH, ROUTE_REACH = 12, 2.0, 1.0
#: Vectors that fit the middles of the routing projections at most.
FIT_ROWS = 20_000
SEED = 9


def calibrated_count(n: int, chance: float, recall: float) -> int:
    """The largest count that a pair of that chance in each of ``n`` projections reaches with ``recall``."""
    tail = 0.0
    for k in range(n, -1, -1):
        tail += math.comb(n, k) * chance**k * (1 - chance) ** (n - k)
        if tail >= recall:
            return k
    return 0


def _within(reach: float) -> float:
    return math.erf(reach / math.sqrt(2))


def table_count(depth: int, recall: float = RECALL) -> int:
    """Tables needed so that a pair at the limit shares a cell in one of them."""
    # a pair is parted at a split if the visitor is further from it than its window and the other beyond
    tail, step, z = 0.0, 1e-3, ROUTE_REACH
    while z < 8:
        tail += step * 0.5 * math.erfc(z / math.sqrt(2))
        z += step
    lost = 2 * 0.3989 * math.sqrt(2 - 2 * COSINE) * tail
    together = (1 - lost) ** depth
    return 1 if together >= recall else math.ceil(math.log(1 - recall) / math.log(1 - together))


def projections(dim: int, n: int, seed: int) -> np.ndarray:
    """``n`` random directions; a unit vector spread evenly has deviation one on each."""
    return np.random.default_rng([SEED, seed, dim]).standard_normal((dim, n))


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def _valid(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lengths of the vectors, and for each length the rows that have it."""
    size = np.diff(np.asarray(column.offsets))
    return size, [np.flatnonzero(size == d) for d in np.unique(size)]


def _rows(column: pa.Array, at: np.ndarray) -> np.ndarray:
    part = column.take(pa.array(at)).flatten()
    return np.asarray(part.cast(pa.float64())).reshape(len(at), -1)


def _visits(low: np.ndarray, high: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) for every side a row's windows touch."""
    row, cell = np.arange(len(low)), np.zeros(len(low), dtype=np.int64)
    for k in range(depth):
        zero, one = (low[row] >> k) & 1 == 1, (high[row] >> k) & 1 == 1
        row, cell = np.concatenate([row[zero], row[one]]), np.concatenate([cell[zero], cell[one] | (1 << k)])
    return row, cell


_ROUTED = "trial int, dim int, cell long, node long, weight long, home long, low long, high long, vector array<{}>"


def _route(classes: DataFrame, depth: int, tables: int, middles: dict[int, np.ndarray], reach: float) -> DataFrame:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for cut in range(0, len(whole), 2000):
                b = whole.slice(cut, 2000)
                vectors = pa.concat_arrays([b.column(2)])
                for at in _matrix(vectors)[1]:
                    x = unit(_rows(vectors, at))
                    dim = x.shape[1]
                    on = x @ projections(dim, depth * tables, 0) - middles.get(dim, np.zeros(depth * tables))
                    bits = 1 << np.arange(depth, dtype=np.int64)
                    for t in range(tables):
                        p = on[:, t * depth:(t + 1) * depth]
                        home = ((p >= 0) * bits).sum(1).astype(np.int64)
                        low, high = ((p < reach) * bits).sum(1).astype(np.int64), ((p >= -reach) * bits).sum(1).astype(np.int64)
                        row, cell = _visits(low, high, depth)
                        n = len(row)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, t, np.int32)), pa.array(np.full(n, dim, np.int32)), pa.array(cell),
                             b.column(0).take(pa.array(at[row])), b.column(1).take(pa.array(at[row])), pa.array(home[row]),
                             pa.array(low[row]), pa.array(high[row]), vectors.take(pa.array(at[row]))],
                            ["trial", "dim", "cell", "node", "weight", "home", "low", "high", "vector"])

    kind = classes.schema["vector"].dataType.elementType.simpleString()
    return classes.select("node", "weight", "vector").mapInArrow(batches, _ROUTED.format(kind))


def order_of(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each projection sorted, and the place of each row in its order."""
    order = np.argsort(b, axis=0, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(b))[:, None] * np.ones((1, b.shape[1]), dtype=order.dtype), axis=0)
    return np.take_along_axis(b, order, axis=0), place.astype(np.uint32)


def count_collisions(a: np.ndarray, lines: np.ndarray, place: np.ndarray, width: float) -> np.ndarray:
    """How many projections have each sorted row in the window around each row of ``a``.

    A window is a stretch of the order, so a row is in it if its place is.
    """
    counts = np.zeros((len(a), len(place)), dtype=np.int8)
    ahead, inside = np.empty(counts.shape, dtype=np.uint32), np.empty(counts.shape, dtype=bool)
    for k in range(a.shape[1]):
        first = np.searchsorted(lines[:, k], a[:, k] - width, "left").astype(np.uint32)
        end = np.searchsorted(lines[:, k], a[:, k] + width, "right").astype(np.uint32)
        # unsigned: a place before the stretch is far beyond its length
        np.subtract(place[:, k][None, :], first[:, None], out=ahead)
        np.less(ahead, (end - first)[:, None], out=inside)
        counts += inside.view(np.int8)
    return counts


def _owned(a: dict[str, np.ndarray], i: np.ndarray, b: dict[str, np.ndarray], j: np.ndarray, t: int, cell: int, depth: int,
           pa_: np.ndarray, pb: np.ndarray, reach: float) -> np.ndarray:
    """Whether this table and cell count the pairs: the first table that joins them, and one cell of it."""
    full = (1 << depth) - 1

    def covers(low: np.ndarray, high: np.ndarray, home: np.ndarray) -> np.ndarray:
        return ((~home & low) | (home & high)) & full == full

    home_a, home_b = a["home"][i] == cell, b["home"][j] == cell
    a_first = a["node"][i] < b["node"][j]
    a_visits_b = covers(a["low"][i], a["high"][i], b["home"][j])
    b_visits_a = covers(b["low"][j], b["high"][j], a["home"][i])
    same = a["home"][i] == b["home"][j]
    # of two that visit each other the lesser node's visit counts
    here = np.where(same, home_a & home_b, np.where(
        a_visits_b & (a_first | ~b_visits_a), home_b & ~home_a, b_visits_a & home_a & ~home_b))
    bits = 1 << np.arange(depth, dtype=np.int64)
    for s in range(t):
        x, y = pa_[i, s * depth:(s + 1) * depth], pb[j, s * depth:(s + 1) * depth]
        hx, hy = ((x >= 0) * bits).sum(1), ((y >= 0) * bits).sum(1)
        before = covers(((x < reach) * bits).sum(1), ((x >= -reach) * bits).sum(1), hy)
        before |= covers(((y < reach) * bits).sum(1), ((y >= -reach) * bits).sum(1), hx)
        here &= ~before
    return here


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each one's component, by passing labels down."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


_FOUND = "u long, v long, links long"


def _tile(table: pa.Table, depth: int, middles: dict[int, np.ndarray], tables: int, cosine: float, reach: float, least: int, width: float) -> pa.Table:
    t, dim, cell = (table.column(c)[0].as_py() for c in ("trial", "dim", "cell"))
    cols = {c: np.asarray(table.column(c)) for c in ("node", "weight", "home", "low", "high")}
    ia, ib = (np.flatnonzero(np.asarray(table.column(c))) for c in ("as_left", "as_right"))
    if not len(ia) or not len(ib):
        return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
    x = unit(np.asarray(table.column("vector").combine_chunks().flatten().cast(pa.float64())).reshape(-1, dim))
    routing = x @ projections(dim, depth * tables, 0) - middles.get(dim, np.zeros(depth * tables))
    on = x @ projections(dim, COUNTED, 1)
    lines, place = order_of(on[ib])
    place = np.asfortranarray(place)
    a, b = ({c: v[k] for c, v in cols.items()} for k in (ia, ib))
    visitor = b["home"] != cell
    hits_a, hits_b = [], []
    for at in range(0, len(ia), 64):
        part = np.arange(at, min(at + 64, len(ia)))
        passed = count_collisions(on[ia[part]], lines, place, width) >= least
        # those at home meet once, by the lesser node
        passed &= visitor[None, :] | (a["node"][part][:, None] < b["node"][None, :])
        i, j = np.nonzero(passed)
        for k in range(0, len(i), 100_000):
            p, q = part[i[k:k + 100_000]], j[k:k + 100_000]
            near = np.einsum("ij,ij->i", x[ia[p]], x[ib[q]]) >= cosine
            p, q = p[near], q[near]
            mine = _owned(a, p, b, q, t, cell, depth, routing[ia], routing[ib], reach)
            hits_a.append(p[mine])
            hits_b.append(q[mine])
    p, q = np.concatenate(hits_a or [np.zeros(0, int)]), np.concatenate(hits_b or [np.zeros(0, int)])
    p, q = ia[p], ib[q]
    links = np.bincount(p, cols["weight"][q], minlength=len(x)) + np.bincount(q, cols["weight"][p], minlength=len(x))
    root = _forest(len(x), p, q)
    some = np.flatnonzero(links > 0)
    return pa.table({"u": cols["node"][some], "v": cols["node"][root[some]], "links": links[some].astype(np.int64)})


def near_groups(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
                cell: int = CELL, tile: int = TILE, tile_right: int = TILE_RIGHT, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of each row.

    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, and vectors of different lengths don't link. Copies link with
    each other; a repeated id is another row. An empty table gives no rows.
    Classes are named by a 64-bit hash of their vector. Float vectors travel as
    floats; projections and cosines are in double precision.
    """
    given = rows.schema[vector_col].dataType.elementType.simpleString()
    kind = given if given == "float" else "double"
    v = F.transform(F.col(vector_col), lambda x: x.cast(kind) + F.lit(0.0).cast(kind))
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).withColumn("ok", _valid(F.col("vector")))
    keyed = base.withColumn("node", F.when(F.col("ok"), F.xxhash64("vector"))).withColumn(
        "node2", F.when(F.col("ok"), F.xxhash64(F.lit(1), "vector")))
    classes = settle(keyed.filter("ok").groupBy("node", "node2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector")))
    n = classes.count()
    depth = min(40, max(0, math.ceil(math.log2(max(1, n) / cell))))
    tables = table_count(depth)
    sigma = math.sqrt(2 - 2 * cosine)
    reach, width = ROUTE_REACH * sigma, REACH * sigma
    least = calibrated_count(COUNTED, _within(REACH), RECALL)
    middles: dict[int, np.ndarray] = {}
    if depth:
        some = classes.select("vector").orderBy("node").limit(fit_rows).toArrow().column(0).combine_chunks()
        for at in _matrix(some)[1]:
            x = unit(_rows(some, at))
            middles[x.shape[1]] = np.median(x @ projections(x.shape[1], depth * tables, 0), axis=0)
    routed = _route(classes, depth, tables, middles, reach)
    at_home = F.col("home") == F.col("cell")
    crowded = routed.groupBy("trial", "dim", "cell").agg(F.count(F.when(at_home, 1)).alias("n_home"), F.count(F.lit(1)).alias("n")).filter(
        (F.col("n_home") > tile) | (F.col("n") > tile_right)).select(
        "trial", "dim", "cell", F.greatest(F.lit(1), F.ceil(F.col("n_home") / tile)).cast("int").alias("lefts"), F.ceil(F.col("n") / tile_right).cast("int").alias("rights"))
    spread = routed.join(crowded, ["trial", "dim", "cell"], "left").withColumn("lefts", F.coalesce("lefts", F.lit(1))).withColumn("rights", F.coalesce("rights", F.lit(1)))
    spread = spread.withColumn("l", F.pmod(F.xxhash64("node", F.lit(3)), F.col("lefts")).cast("int")).withColumn(
        "r", F.pmod(F.xxhash64("node", F.lit(4)), F.col("rights")).cast("int"))
    as_right = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda k: F.struct(
        k.alias("i"), F.col("r").alias("j"), ((k == F.col("l")) & at_home).alias("as_left"), F.lit(True).alias("as_right")))
    as_left = F.transform(F.filter(F.sequence(F.lit(0), F.col("rights") - 1), lambda k: (k != F.col("r")) & at_home), lambda k: F.struct(
        F.col("l").alias("i"), k.alias("j"), F.lit(True).alias("as_left"), F.lit(False).alias("as_right")))
    tiles = spread.withColumn("to", F.explode(F.concat(as_right, as_left))).select(
        "trial", "dim", "cell", "to.*", "node", "weight", "home", "low", "high", "vector")

    def search(table: pa.Table) -> pa.Table:
        return _tile(table, depth, middles, tables, cosine, reach, least, width)

    found = settle(tiles.groupBy("trial", "dim", "cell", "i", "j").applyInArrow(search, _FOUND))
    roots = components(found.select("u", "v"))
    links = found.groupBy("u").agg(F.sum("links").alias("links"))
    named = classes.select("node", "node2", "rep", "weight").join(links, F.col("node") == F.col("u"), "left").drop("u")
    named = named.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").withColumn(
        "root", F.coalesce("component", "node"))
    least_of = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least_of, "root").select(
        F.col("node").alias("_k1"), F.col("node2").alias("_k2"), "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    ids = keyed.select("vec_id", "node", "node2")
    told = ids.join(named, (F.col("node") == F.col("_k1")) & (F.col("node2") == F.col("_k2")), "left")
    component = F.when(F.col("_k1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return told.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                       F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
