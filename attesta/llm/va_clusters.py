"""Centroid clustering over a vector approximation file.

Vectors are scaled to integers and written once as an approximation file: every component is
replaced by the number of its cell (``BITS`` bits, packed), and what a cell does not tell, the
distance of the component from the cell's start, stands beside it (null where all of it is zero).
The cells of a dimension are of equal width around its mean; the outermost ones reach to the least
and the greatest value. Mean, spread and extremes come from all vectors; they shape the cells only
and never change a result.

A round assigns every vector to its nearest centroid. For each dimension a lookup table gives, by
cell and centroid, the least and the greatest squared difference; added up, they are an interval
that holds the true distance. Where one centroid's interval lies below all others, it is the
nearest, and the rest column is not looked at. Where intervals overlap, the full vector is put
together and measured against the centroids that are still possible. New centroids are
componentwise floors of exact means: tasks add up cell starts and rests by cluster, one row for
each cluster and task goes into the shuffle, and ``k * dims`` totals reach the driver.

Defined results: vectors of another number of components, or with a null, NaN or infinite one, are
left out. Components are held within +-2**27 after scaling, so squared distances fit 64 bits; an
inertia beyond 64 bits is null. A null id is hashed as an empty one. Ties between centroids go to
the smaller number; equal hashes of the start are ordered by the vectors themselves. Repeated rows
are kept as rows. Fewer vectors than ``k`` give as many centroids as vectors; an empty table gives
an empty result. An empty cluster keeps its centroid. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import save

DIMS, SCALE, K, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Bits of a cell number; cells cover this many standard deviations on both sides of the mean.
BITS, SPREAD = 6, 4.0
LARGEST = 1 << 27


def integers(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are kept, and their components floor(scale * x)."""
    right = np.flatnonzero(np.asarray(column.is_valid()) & (np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float), nan=-1) == dims))
    flat = column.take(pa.array(right)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(right), dims)  # a null becomes NaN
    fine = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        return right[fine], np.clip(np.floor(x[fine] * scale), -LARGEST, LARGEST).astype(np.int64)


@dataclass(frozen=True)
class Grid:
    """Cells of every dimension: ``first[j] + width[j] * c`` is the start of cell c, but for the outermost ones."""

    first: np.ndarray
    width: np.ndarray
    least: np.ndarray
    greatest: np.ndarray
    bits: int

    @classmethod
    def around(cls, mean: np.ndarray, deviation: np.ndarray, least: np.ndarray, greatest: np.ndarray, bits: int) -> Grid:
        cells = 1 << bits
        width = np.maximum(1, np.ceil(2 * SPREAD * deviation / cells)).astype(np.int64)
        return cls(np.floor(mean).astype(np.int64) - width * (cells // 2), width, least, greatest, bits)

    def cells(self, v: np.ndarray) -> np.ndarray:
        return np.clip((v - self.first) // self.width, 0, (1 << self.bits) - 1)

    @property
    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) value by dimension and cell; the outermost cells reach to the extremes."""
        starts = self.first[:, None] + self.width[:, None] * np.arange(1 << self.bits)
        ends = starts + self.width[:, None] - 1
        starts[:, 0], ends[:, -1] = np.minimum(starts[:, 0], self.least), np.maximum(ends[:, -1], self.greatest)
        return starts, ends

    def packed(self, cells: np.ndarray) -> list[bytes]:
        bits = np.unpackbits(cells.astype(np.uint8)[:, :, None], axis=2)[:, :, 8 - self.bits :]
        return [row.tobytes() for row in np.packbits(bits.reshape(len(cells), bits.shape[1] * self.bits), axis=1)]

    def unpacked(self, rows: list[bytes]) -> np.ndarray:
        dims = len(self.first)
        raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
        bits = np.unpackbits(raw, axis=1)[:, : dims * self.bits].reshape(len(rows), dims, self.bits)
        return (bits @ (1 << np.arange(self.bits - 1, -1, -1))).astype(np.int64)


def grid_of(vectors: DataFrame, dims: int, scale: int, bits: int) -> Grid | None:
    """The grid by the mean, spread and extremes of all kept vectors; None if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(dims), np.zeros(dims)
        least, greatest = np.full(dims, LARGEST), np.full(dims, -LARGEST)
        for batch in batches:
            _, v = integers(batch.column(0), dims, scale)
            if len(v):
                n, total, squares = n + len(v), total + v.sum(axis=0), squares + (v.astype(float) ** 2).sum(axis=0)
                least, greatest = np.minimum(least, v.min(axis=0)), np.maximum(greatest, v.max(axis=0))
        if n:
            yield pa.RecordBatch.from_pydict({"j": pa.array(range(dims), pa.int32()), "n": [n] * dims, "total": total, "squares": squares, "least": least, "greatest": greatest})

    parts = vectors.select("v").mapInArrow(run, "j int, n long, total double, squares double, least long, greatest long")
    rows = parts.groupBy("j").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")], F.min("least").alias("least"), F.max("greatest").alias("greatest")).orderBy("j").collect()  # one row for each dimension
    if not rows:
        return None
    mean = np.array([r["total"] / r["n"] for r in rows])
    deviation = np.sqrt(np.maximum(0, np.array([r["squares"] / r["n"] for r in rows]) - mean**2))
    return Grid.around(mean, deviation, np.array([r["least"] for r in rows]), np.array([r["greatest"] for r in rows]), bits)


def approximate(vectors: DataFrame, grid: Grid, scale: int) -> DataFrame:
    """The approximation file: id, cells (packed), rest (64-bit distances from the cells' starts, or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, _ = grid.bounds
        each = np.arange(len(grid.first))
        for batch in batches:
            kept, v = integers(batch.column(1), len(each), scale)
            cells = grid.cells(v)
            rest = v - starts[each, cells]
            far = rest.any(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept)), pa.array(grid.packed(cells), pa.binary()), pa.array([r.astype("<i8").tobytes() if f else None for r, f in zip(rest, far)], pa.binary())], names=["id", "cells", "rest"]
            )

    return vectors.select("id", "v").mapInArrow(run, "id long, cells binary, rest binary")


class Assigner:
    """Nearest centroids of a batch of approximated vectors."""

    def __init__(self, grid: Grid, centroids: np.ndarray):
        self.grid, self.centroids = grid, centroids
        self.starts, ends = grid.bounds
        self.several = self.starts != ends  # cells of more than one value
        self.each = np.arange(len(grid.first))
        c = centroids.T[:, None, :]  # dimension, cell, centroid
        a, b = self.starts[:, :, None], ends[:, :, None]
        self.low = np.maximum(np.maximum(a - c, c - b), 0) ** 2
        self.high = np.maximum(abs(c - a), abs(c - b)) ** 2
        self.fetched = 0  # full vectors that were needed to decide

    def __call__(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster, lower end of its interval, and unpacked cells by row."""
        cells, rest = self.grid.unpacked(batch.column(1).to_pylist()), batch.column(2)
        n, k = len(cells), len(self.centroids)
        low, high = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)
        for j in self.each:
            low += self.low[j][cells[:, j]]
            high += self.high[j][cells[:, j]]
        least = high.min(axis=1)
        possible = low <= least[:, None]
        cluster = possible.argmax(axis=1)
        open_ = np.flatnonzero((possible.sum(axis=1) > 1) & (low != high).any(axis=1))
        sure = np.flatnonzero((possible.sum(axis=1) > 1) & (low == high).all(axis=1))  # intervals of no width: the distances themselves
        cluster[sure] = low[sure].argmin(axis=1)
        self.fetched += len(open_)
        if len(open_):
            full = self.full(cells[open_], rest.take(pa.array(open_)))
            exact = ((full[:, None, :] - self.centroids) ** 2).sum(axis=2)
            cluster[open_] = np.where(possible[open_], exact, np.iinfo(np.int64).max).argmin(axis=1)
        return cluster, low[np.arange(n), cluster], cells

    def full(self, cells: np.ndarray, rest: pa.Array) -> np.ndarray:
        v = self.starts[self.each, cells]
        far = np.flatnonzero(np.asarray(rest.is_valid()))
        if len(far):
            v[far] += np.frombuffer(b"".join(rest.take(pa.array(far)).to_pylist()), "<i8").reshape(len(far), -1)
        return v

    def distances(self, cluster: np.ndarray, low: np.ndarray, cells: np.ndarray, rest: pa.Array) -> np.ndarray:
        """Exact squared distances; the interval's lower end is exact where the cells tell all."""
        out, far = low.copy(), np.flatnonzero(self.several[self.each, cells].any(axis=1))
        if len(far):
            out[far] = ((self.full(cells[far], rest.take(pa.array(far))) - self.centroids[cluster[far]]) ** 2).sum(axis=1)
        return out


def cluster_sums(file: DataFrame, grid: Grid, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Number and componentwise sum of the vectors nearest to each centroid."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign, count, total = Assigner(grid, centroids), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in filter(len, batches):
            cluster, _, cells = assign(batch)
            count += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, assign.full(cells, batch.column(2)))
        held = np.flatnonzero(count)
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(count[held]), pa.array(total[held].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = file.mapInArrow(run, "cluster int, n long, total array<long>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("j", "x"))
    sums = each.groupBy("cluster", "j").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()  # k * dims rows
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sums:
        out.setdefault(r["cluster"], (r["n"], [0] * dims))[1][r["j"]] = int(r["x"])
    return out


@dataclass(frozen=True)
class Clustering:
    assigned: DataFrame  # id, cluster, distance
    centroids: np.ndarray
    inertia: list[int]  # by cluster

    def digest(self, number: int) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.centroids[number]).encode()).hexdigest()


def cluster(
    table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, bits: int = BITS
) -> Clustering | None:
    """Lloyd rounds from the ``k`` vectors of least hash; None if no vector is kept."""
    vectors = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"))
    grid = grid_of(vectors, dims, scale, bits)
    if grid is None:
        return None
    file = save(approximate(vectors, grid, scale), "approximation-file")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = start_vectors(file.withColumn("digest", digest), grid, k)
    centroids = np.array(first)
    for _ in range(rounds):
        moved = centroids.copy()
        for number, (n, total) in cluster_sums(file, grid, centroids).items():
            moved[number] = [x // n for x in total]
        centroids = moved
    assigned = save(assign_all(file, grid, centroids), "assigned")
    totals = {r["cluster"]: int(r["x"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}  # k rows
    return Clustering(assigned, centroids, [totals.get(i, 0) for i in range(len(centroids))])


def start_vectors(file: DataFrame, grid: Grid, k: int) -> list[list[int]]:
    """The vectors of the ``k`` smallest digests; rows of equal digest are ordered by their components."""
    dims = len(grid.first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = Assigner(grid, np.zeros((1, dims), np.int64))
        for batch in filter(len, batches):
            full = whole.full(grid.unpacked(batch.column(1).to_pylist()), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(full.tolist(), pa.list_(pa.int64()))], names=["digest", "v"])

    last = file.select("digest").orderBy("digest").limit(k).agg(F.max("digest")).first()[0]
    few = file.where(F.col("digest") <= last).mapInArrow(run, "digest string, v array<long>")
    return [list(r["v"]) for r in few.orderBy("digest", "v").limit(k).collect()]


def assign_all(file: DataFrame, grid: Grid, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = Assigner(grid, centroids)
        for batch in filter(len, batches):
            number, low, cells = assign(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), pa.array(assign.distances(number, low, cells, batch.column(2)), pa.int64())], names=["id", "cluster", "distance"])

    return file.mapInArrow(run, "id long, cluster int, distance long")


def report(found: Clustering | None, table: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    columns = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if found is None:
        return table.sparkSession.createDataFrame([], columns)

    def fits(x: int):
        return F.lit(Decimal(x)).try_cast("long")

    own = F.array(*[fits(x) for x in found.inertia])
    digests = F.array(*[F.lit(found.digest(i)) for i in range(len(found.centroids))])
    return found.assigned.select(
        F.col("id").alias("vec_id"), "cluster", "distance", F.get(own, F.col("cluster")).alias("cluster_inertia"), fits(sum(found.inertia)).alias("inertia"), F.get(digests, F.col("cluster")).alias("centroid_sha256")
    )
