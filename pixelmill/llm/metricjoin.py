"""Embedding near-dedup: exact metric range join over pivot cells.

Unit vectors at cosine c lie at distance r = sqrt(2 - 2c). Each vector is at home in the cell of its nearest pivot. A
vector goes to another cell too if a vector at home there can be within r: by the triangle inequality that needs
d(x, q) <= d(x, p) + 2r and d(x, q) <= radius(q) + r, and in Euclidean space that the plane between p and q is within r.
Cells are then joined independently.

Of two cells only one gets the other's boundary: which one alternates around the circle of cells, so that each gets
as much as any other, and each pair of vectors meets once. A cell with more than `HOME` vectors is dealt over tasks in
blocks, which take their places on the same circle. Vectors travel as packed matrices, a row for each block that a
batch has vectors for. A block's vectors at home come first and are held; the others pass by them. Links leave a block
as numbers by vector and as a spanning forest, never as pairs.

The number of pivots grows with the square root of the number of vectors (`pivots_for`), so that what comes to the
driver and to each task stays small (28 000 pivots for 2e11 vectors), and a block never holds more than `HOME`
vectors. How much of other cells a cell gets is up to the data. Vectors without any structure, spread evenly over all
directions of a high dimension, are near the planes between most pivots, so no set of pivots keeps them apart: the
join is then quadratic, with each pair of blocks compared once.

Equal vectors are one entry with a weight.

Defined results: a vector that is null, empty or zero, or has a null or non-finite component, links with nothing;
vectors of different dimension don't link, whatever their length; rows without an id take no part and have no
component; repeated rows count as vectors of their own; ties at the threshold are computed anew in double precision;
an empty table gives an empty table; further columns of the input don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions, slices
from .components import Forest, components

#: Vectors at home in a block at most, on average, and vectors that are compared with others at once.
HOME, OTHERS = 1 << 15, 2048
#: Vectors of a batch that is dealt.
BATCH = 4096


def pivots_for(n: int) -> int:
    return max(16, math.isqrt(n) // 16)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two, without rounding, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_dim(dims: np.ndarray):
    for d in np.unique(dims):
        yield int(d), np.flatnonzero(dims == d)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ pivots.T)))


def _packed(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


class Circle:
    """Blocks of all cells of one dimension in a circle; a block gets the boundary of those up to half-way round behind it."""

    def __init__(self, sizes: list[int]):
        self.parts = np.array([max(1, -(-n // HOME)) for n in sizes])
        self.first = np.concatenate([[0], np.cumsum(self.parts)])
        self.cell = np.repeat(np.arange(len(sizes)), self.parts)
        self.n = len(self.cell)

    def home(self, cell: np.ndarray, node: np.ndarray) -> np.ndarray:
        spread = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64)
        return self.first[cell] + spread % self.parts[cell]

    def visits(self, home: np.ndarray) -> np.ndarray:
        """(vector, block): whether a vector of that home may go to the block."""
        ahead = (np.arange(self.n) - home[:, None]) % self.n
        half = (2 * ahead == self.n) & (np.arange(self.n) > home[:, None])
        return (ahead > 0) & (2 * ahead < self.n) | half


def near_classes(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95, pivots: int | None = None) -> DataFrame:
    """id, n_links, component_id and kept of each row; pivots: their number, by default as many as pivots_for says."""
    spark = df.sparkSession
    scratch = Scratch(spark, "metric")
    r = math.sqrt(2 - 2 * cosine) + 1e-9
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = rows.where("id IS NOT NULL AND v IS NOT NULL").where(finite)
    entries = scratch.table(valid.groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("weight")), "entries")

    sample = entries.select("v").orderBy(F.xxhash64("v")).limit(pivots or pivots_for(entries.count())).collect()  # a bound by the root of the table's size
    by_dim: dict[int, list] = {}
    for x in sample:
        by_dim.setdefault(len(x.v), []).append(x.v)
    at_dim = {d: _unit(np.array(x)) for d, x in by_dim.items()}

    def homes(batches):
        for batch in slices(batches, 1024):
            dims = pa.compute.list_value_length(batch.column(0)).to_numpy()
            home, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for d, at in _by_dim(dims):
                if d in at_dim:
                    away = _distances(_unit(_matrix(batch.column(0).take(pa.array(at)))), at_dim[d])
                    home[at], far[at] = away.argmin(1), away.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims, pa.int32()), pa.array(home), pa.array(far)], names=["v", "node", "weight", "dim", "home", "far"])

    placed = scratch.table(entries.mapInArrow(homes, "v array<double>, node long, weight long, dim int, home int, far double"), "homes")
    scratch.drop(entries)
    found = {(x.dim, x.home): (x.radius, x.n) for x in placed.groupBy("dim", "home").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect()}  # a row a pivot
    dims_found = {d for d, _ in found}
    radius = {d: np.array([found.get((d, k), (-9.0, 0))[0] for k in range(len(at_dim.get(d, (0,))))]) for d in dims_found}
    circles = {d: Circle([found.get((d, k), (0, 0))[1] for k in range(len(at_dim.get(d, (0,))))]) for d in dims_found}

    def deal(batches):
        """Rows (dim, block, at home, nodes, weights, vectors): a batch's vectors for each block that they may link in."""
        names = ["dim", "block", "own", "nodes", "weights", "v"]
        for batch in slices(batches, BATCH):
            dims, home, far, node, weight = (batch.column(i).to_numpy() for i in (3, 4, 5, 1, 2))
            for d, at in _by_dim(dims):
                v, circle = _matrix(batch.column(0).take(pa.array(at))), circles[d]
                block = circle.home(home[at], node[at])
                goes = np.zeros((len(at), circle.n), bool)
                if circle.n > 1:
                    near = np.ones((len(at), len(radius[d])), bool)
                    if d in at_dim:
                        q = at_dim[d]
                        away, f = _distances(_unit(v), q), far[at][:, None]
                        gap = _distances(q, q)[home[at]]
                        plane = np.divide(away**2 - f**2, 2 * gap, out=np.zeros(away.shape), where=gap > 1e-6)
                        near = (away <= f + 2 * r) & (away <= radius[d] + r) & (plane <= r)
                        near[np.arange(len(at)), home[at]] = True
                    goes = circle.visits(block) & near[:, circle.cell]
                out = []
                for own, which in ((True, block[:, None] == np.arange(circle.n)), (False, goes)):
                    to, x = np.nonzero(which.T)
                    for rows_ in np.split(np.arange(len(to)), np.flatnonzero(np.diff(to)) + 1):
                        if len(rows_):
                            i = x[rows_]
                            out.append((d, int(to[rows_[0]]), own, _packed(node[at][i], "<i8"), _packed(weight[at][i], "<i8"), _packed(v[i], "<f8")))
                        if sum(len(o[-1]) for o in out) > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    types = [pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]

    def join(batches):
        """(node, n): links of a vector found here, and spanning edges (node, other)."""
        forest, key, home = Forest(), None, []

        def compare(a, b, within):
            """Links between the blocks of vectors a and b; within: a is b."""
            ua, ub = a[3], b[3]
            slack = len(ua[0]) * 1.2e-7 + 1e-6  # more than products of single precision are off
            for s in range(0, len(ub), OTHERS):
                product = ua @ ub[s: s + OTHERS].T
                i, j = np.nonzero(product >= cosine - slack)
                if not len(i):
                    continue
                close = np.flatnonzero(product[i, j] < cosine + slack)
                j += s
                hit = np.ones(len(i), bool)
                x, y = a[2][i[close]], b[2][j[close]]
                hit[close] = (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) >= cosine
                if within:
                    hit &= i != j
                i, j = i[hit], j[hit]
                a[1] += np.bincount(i, b[4][j], len(ua)).astype(np.int64)
                if not within:
                    b[1] += np.bincount(j, a[4][i], len(ub)).astype(np.int64)
                forest.add(a[0][i], b[0][j])

        def counts(x):
            kept = x[1] > 0
            return pa.RecordBatch.from_arrays([pa.array(x[0][kept]), pa.nulls(int(kept.sum()), pa.int64()), pa.array(x[1][kept])], names=["node", "other", "n"])

        for batch in slices(batches, 16):
            for d, block, own, nodes, weights, v in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (d, block):
                    for x in home:
                        yield counts(x)
                    key, home = (d, block), []
                v = _scaled(np.frombuffer(v, "<f8").reshape(-1, d))
                nodes = np.frombuffer(nodes, "<i8")
                now = [nodes, np.zeros(len(nodes), np.int64), v, _unit(v).astype(np.float32), np.frombuffer(weights, "<i8")]
                for x in home:
                    compare(x, now, False)
                if own:
                    compare(now, now, True)
                    home.append(now)
                else:
                    yield counts(now)
        for x in home:
            yield counts(x)
        for a, b in forest.edges():
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64())], names=["node", "other", "n"])

    dealt = placed.mapInArrow(deal, "dim int, block int, own boolean, nodes binary, weights binary, v binary")
    together = dealt.repartition(partitions(spark), "dim", "block").sortWithinPartitions("dim", "block", F.desc("own"))
    joined = scratch.table(together.mapInArrow(join, "node long, other long, n long"), "links")
    classes = components(scratch, joined.where("other IS NOT NULL"), "node", "other")
    counts = joined.where("other IS NULL").groupBy("node").agg(F.sum("n").alias("n"))
    entry = placed.select("v", "node", "weight").join(counts, "node", "left").join(classes, "node", "left")
    entry = scratch.table(entry.select("v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "classes")
    out = rows.withColumn("v", F.when(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)), F.col("v"))).join(entry, "v", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
