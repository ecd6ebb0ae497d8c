import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import va_clusters


def lloyd(rows, k, rounds, dims, scale):
    """(id, cluster, distance) rows and the centroids, by plain integers."""
    kept = [(i, [int(np.floor(np.float64(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(c) // len(groups[n]) for c in zip(*groups[n])] if n in groups else c for n, c in enumerate(centroids)]
    return sorted(((i is None, i or 0), *near(v)[::-1]) for i, v in kept), centroids


def run(spark, rows, **how):
    return va_clusters.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), **how)


def taken(found):
    return sorted(((r["id"] is None, r["id"] or 0), r["cluster"], r["distance"]) for r in found.assigned.collect())


@pytest.mark.parametrize("bits", [1, 2, 4, 6])
def test_any_number_of_bits_gives_the_same_clusters(spark, bits):
    rng = np.random.default_rng(bits)
    centres = rng.normal(0, 2, (5, 12))
    rows = [(i, [float(x) for x in np.float32(centres[i % 5] + rng.normal(0, 0.3 + i % 7, 12))]) for i in range(300)]
    rows += [(900 + i, rows[3][1]) for i in range(60)]  # many copies of one vector
    how = {"k": 6, "rounds": 3, "dims": 12, "scale": 64}
    found = run(spark, rows, bits=bits, **how)
    want, centroids = lloyd(rows, **how)
    assert taken(found) == want and found.centroids.tolist() == centroids
    assert sum(found.inertia) == sum(d for _, _, d in want)


def test_odd_rows(spark):
    rows = [(1, [0.5, -0.5]), (1, [0.5, -0.5]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [float("nan"), 0.0]), (7, [float("inf"), 0.0]), (None, [2.0, 2.0]), (8, [-0.001, 0.0]), (9, [3e38, -3e38])]
    how = {"k": 3, "rounds": 2, "dims": 2, "scale": 64}
    found = run(spark, rows, **how)
    assert len(taken(found)) == 5 and all(d >= 0 for _, _, d in taken(found))
    assert np.abs(found.centroids).max() == va_clusters.LARGEST
    less = rows[:-1]
    assert taken(run(spark, less, **how)) == lloyd(less, **how)[0]


def test_ties_few_and_no_vectors(spark):
    same = [(i, [0.0, 1.0]) for i in range(5)]
    found = run(spark, same, k=4, rounds=1, dims=2)
    assert {c for _, c, _ in taken(found)} == {0} and found.centroids.shape == (4, 2)  # empty clusters keep their centroids
    assert len(run(spark, same[:2], k=4, rounds=1, dims=2).centroids) == 2
    table = spark.createDataFrame([(1, [1.0], "x", 3)], "vec_id long, embedding array<double>, cluster string, distance int")
    assert va_clusters.cluster(table) is None and va_clusters.report(None, table).count() == 0
    assert va_clusters.report(va_clusters.cluster(table, dims=1), table).count() == 1  # clashing columns are not read
    assert va_clusters.cluster(table.where("false")) is None


def test_full_vectors_are_fetched_only_where_intervals_overlap():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    near, far = rng.integers(-40, 40, (500, 8)), rng.integers(3960, 4040, (500, 8))
    v = np.concatenate([near, far])
    grid = va_clusters.Grid.around(v.mean(axis=0), v.std(axis=0), v.min(axis=0), v.max(axis=0), 4)
    assign = va_clusters.Assigner(grid, np.array([[0] * 8, [4000] * 8]))
    cells = grid.cells(v)
    starts, _ = grid.bounds
    assert (grid.unpacked(grid.packed(cells)) == cells).all()
    rest = [r.astype("<i8").tobytes() for r in v - starts[np.arange(8), cells]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(grid.packed(cells)), pa.array(rest)], names=["id", "cells", "rest"])
    assert (assign(batch)[0] == np.repeat([0, 1], 500)).all() and assign.fetched == 0
    close = va_clusters.Assigner(grid, np.array([[0] * 8, [1] * 8, [4000] * 8]))
    close(batch)
    assert 0 < close.fetched <= 500  # only the vectors between the two near centroids


def test_inertia_columns(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = va_clusters.report(va_clusters.cluster(vectors), vectors)
    each = rows.groupBy("cluster").agg(F.sum("distance").alias("s"), F.max("cluster_inertia").alias("c"), F.max("inertia").alias("i"), F.countDistinct("centroid_sha256").alias("d")).collect()
    assert all(r["s"] == r["c"] and r["d"] == 1 for r in each) and {sum(r["s"] for r in each)} == {r["i"] for r in each}
