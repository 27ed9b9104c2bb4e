"""Operator 11, centroid clustering by weighted deduplication: Lloyd's rounds over distinct quantised vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

#: Steps that a component's unit is cut into, and the largest whole number that a component can become.
STEPS, LARGEST = 1024, 1 << 62
#: Below the first bound squared distances are exact in doubles, below the second in longs; above, in Python's integers.
IN_DOUBLES, IN_LONGS = 1 << 20, 1 << 27
MOST = (1 << 63) - 1


def quantised(vector: Column, steps: int = STEPS) -> Column:
    """floor(steps * x) of every component, within LARGEST either way."""
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * steps, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))))


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has `dims` components, all of them finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))  # NaN is above infinity here
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared Euclidean distances of whole-number rows from centroids: as longs, or objects where these overflow."""
    most = max((int(x) for a in (rows, centroids) if a.size for x in (a.max(), -a.min())), default=0)
    kind = np.float64 if most < IN_DOUBLES else np.int64 if most < IN_LONGS else object
    x, c = rows.astype(kind), centroids.astype(kind)
    out = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
    return out if kind is object else out.astype(np.int64)


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row the number of its nearest centroid, the smaller one of a tie, and the squared distance."""
    far = distances(rows, centroids)
    best = far.argmin(1)
    return best, far[np.arange(len(rows)), best]


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(distinct: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """For every centroid that has vectors, how many these are and their componentwise sums.

    A task gives one row for each centroid, so what is shuffled and read by the driver doesn't grow with the table.
    """
    k, dims = centroids.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), object), [0] * k
        for batch in batches:
            rows, weights = _matrix(batch, dims), batch.column("weight").to_numpy(zero_copy_only=False)
            best, _ = nearest(rows, centroids)
            most = max(int(abs(rows).max(initial=0)), 1) * int(weights.sum())
            kind = np.int64 if most < MOST else object
            for j in np.unique(best).tolist():
                of = best == j
                total[j] += (rows[of].astype(kind) * weights[of].astype(kind)[:, None]).sum(0).astype(object)
                count[j] += int(weights[of].sum())
        live = [j for j in range(k) if count[j]]
        wide = pa.decimal128(38, 0)
        columns = [pa.array(live, pa.int32()), pa.array([count[j] for j in live], pa.int64())]
        columns += [pa.array([Decimal(int(total[j, d])) for j in live], wide) for d in range(dims)]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", *(f"s{d}" for d in range(dims))])

    schema = "cluster int, n long, " + ", ".join(f"s{d} decimal(38, 0)" for d in range(dims))
    summed = distinct.mapInArrow(partial, schema).groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(f"s{d}").alias(f"s{d}") for d in range(dims)))
    return {r["cluster"]: (r["n"], [int(r[f"s{d}"]) for d in range(dims)]) for r in summed.collect()}


def _assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vector, weight, cluster, distance) of every distinct vector; a distance above the largest long is that."""
    dims = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, far = nearest(_matrix(batch, dims), centroids)
            columns = [batch.column("vector"), batch.column("weight"), pa.array(best.astype(np.int32)), pa.array(np.minimum(far, MOST).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["vector", "weight", "cluster", "distance"])

    return distinct.mapInArrow(assign, "vector array<long>, weight long, cluster int, distance long")


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, salt: str = "3:", steps: int = STEPS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Cluster the usable rows of `vectors`: vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256.

    Vectors become whole numbers, identical ones one row with a multiplicity, so a vector that a third of all rows
    share costs one distance a round. The first centroids are the rows with the smallest SHA-256 of `salt` and the id
    (a null id counts as an empty one, equal ids go by vector; two of the k may be equal, and then the second stays
    empty). Each round assigns every distinct vector to its nearest centroid and replaces a centroid that has any by
    floor(sum / count) over all rows, in integers of any size; last, vectors are assigned once more and joined back to
    their ids. Fewer than k usable rows make fewer centroids, none an empty result. Rows with a null or short vector,
    or with a null or non-finite component, are left out; repeated rows count and come back as often as they occur.
    Components stop at 2^62 and distances at the largest long. Other columns are left out, whatever their names. The
    distinct vectors are written once; a round reads them and brings k rows of sums to the driver.
    """
    found = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("vector")).filter(usable(F.col("vector"), dims)).withColumn("vector", quantised(F.col("vector"), steps))
    order = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = found.select(order.alias("h"), "vector").orderBy("h", "vector").limit(k).collect()
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return found.select("vec_id").limit(0).select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    centroids = np.array([r["vector"] for r in first], np.int64)
    distinct = written(found.groupBy("vector").agg(F.count("*").alias("weight")), "distinct")
    for _ in range(rounds):
        for j, (n, total) in _sums(distinct, centroids).items():
            centroids[j] = [s // n for s in total]
    assigned = written(_assigned(distinct, centroids), "assigned")
    drop_written(distinct)
    held = assigned.groupBy("cluster").agg(F.sum(F.col("weight").cast("decimal(19, 0)") * F.col("distance").cast("decimal(19, 0)")).alias("inertia")).collect()
    total = min(MOST, int(sum(r["inertia"] for r in held)))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = vectors.sparkSession.createDataFrame([(r["cluster"], min(MOST, int(r["inertia"])), total, digest[r["cluster"]]) for r in held], schema)  # k rows
    return found.join(assigned.drop("weight"), "vector").join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
