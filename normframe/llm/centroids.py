"""Centroid clustering of integer vectors by an incrementally kept distance matrix.

Every vector keeps its exact dot products with all centroids in a table. When
centroids move, only the components that changed are read again: a product
grows by the sum of the vector's components times the changes. Squared
distances are |x|^2 - 2 xc + |c|^2 in integers, so the nearest centroid is
exact, ties and all, however often products were updated. A round is one pass that
writes the next table and one that sums the vectors of each cluster; centroids
and sums are k x d numbers, and nothing else comes to the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, read_table, remove

CLUSTERS, ROUNDS, DIMS, STEPS = 40, 5, 64, 256


def integer_vectors(df: DataFrame, vec_col: str, dims: int, steps: int, out: str) -> DataFrame:
    """The rows whose vector has exactly ``dims`` components, none null or non-finite, and ``out``: floor(steps * x) of each component.

    Squared distances have to fit 64 bits: a component beyond about 2^27 (for 64 of them) raises.
    """
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))
    bound = float(math.isqrt((1 << 62) // max(dims, 1)) // 2)
    scaled = lambda x: F.floor(x.cast("double") * F.lit(float(steps)))

    def step(x: Column) -> Column:
        fits = F.abs(x.cast("double") * F.lit(float(steps))) < F.lit(bound)
        return F.when(fits, scaled(x)).otherwise(F.raise_error(F.lit(f"a component times {steps} is not below {bound:.0f}")).cast("bigint"))

    kept = df.filter((F.size(vec_col) == dims) & F.forall(vec_col, usable))
    return kept.withColumn(out, F.transform(vec_col, lambda x: step(x).cast("int")))


@dataclass
class Clusters:
    """``rows``: the id, and ``cluster``, ``distance`` (squared), ``dots`` and ``point`` (integers) of each vector; and the final centroids."""

    rows: DataFrame
    centroids: np.ndarray

    def inertia(self) -> dict[int, int]:
        """The sum of distances of each cluster that has vectors."""
        return {r["cluster"]: r["total"] for r in self.rows.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel(), kind))


def moved(points: np.ndarray, dots: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Dot products with the new centroids, from those with the old: only components that changed are touched."""
    dots = dots.copy()
    change = new - old
    for c in np.flatnonzero(change.any(axis=1)):
        at = np.flatnonzero(change[c])
        dots[:, c] += points[:, at] @ change[c, at]
    return dots


def nearest(points: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (the smaller number of equal ones) and the squared distance."""
    apart = (points * points).sum(axis=1)[:, None] - 2 * dots + (centroids * centroids).sum(axis=1)
    cluster = apart.argmin(axis=1)
    return cluster, apart[np.arange(len(apart)), cluster]


def _assigned(rows: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """One pass: products brought up to date, and each vector's cluster and distance."""
    k, d = new.shape
    fresh = "dots" not in rows.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column(1), d)
            dots = moved(points, np.zeros((len(points), k), np.int64) if fresh else _matrix(batch.column(2), k), old, new)
            cluster, distance = nearest(points, dots, new)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _lists(dots, pa.int64()), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                ["id", "point", "dots", "cluster", "distance"],
            )

    source = rows.select("id", "point", *([] if fresh else ["dots"]))
    return source.mapInArrow(assign, f"id {rows.schema['id'].dataType.simpleString()}, point array<int>, dots array<bigint>, cluster int, distance bigint")


def _sums(rows: DataFrame, k: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Count and component sums of each cluster; a batch adds up its own rows first, so a cluster of any size is k numbers a batch."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(cluster, kind="stable")
            first = np.flatnonzero(np.diff(cluster[order], prepend=-1))
            sums = np.add.reduceat(_matrix(batch.column(1), d)[order], first, axis=0)
            counts = np.diff(np.append(first, len(order)))
            yield pa.RecordBatch.from_arrays([pa.array(cluster[order[first]].astype(np.int32)), pa.array(counts.astype(np.int64)), _lists(sums, pa.int64())], ["cluster", "n", "sums"])

    parts = rows.select("cluster", "point").mapInArrow(add, "cluster int, n bigint, sums array<bigint>")
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(d)]).alias("sums"))
    count, sums = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
    for r in totals.collect():
        count[r["cluster"]], sums[r["cluster"]] = r["n"], r["sums"]
    return count, sums


def cluster_vectors(df: DataFrame, k: int, rounds: int, seed: int, dims: int, steps: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> Clusters:
    """Lloyd's rounds over all vectors with ``dims`` finite components, taken as the integers floor(steps * x).

    The first centroids are the ``k`` vectors with the smallest sha256 of
    ``<seed>:<id>``; rows that share an id come in the order of their
    components, null ids last. A round assigns every vector and then moves each
    centroid that has vectors to floor(sum / count); after the last round vectors are
    assigned once more. Rounds that would change nothing are left out.

    Other vectors (null, of another length, with null or non-finite components) take no part. With
    fewer vectors than ``k`` there are as many clusters as vectors; an empty table gives no rows. Equal vectors, and rows with
    equal ids, are rows like any other. Other columns are not returned. Each
    table is in the shared folder, and the last but one goes when the next is
    written; a lost executor costs the tasks it ran.
    """
    spark = df.sparkSession
    rows = integer_vectors(df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")), "vec", dims, steps, "point").select("id", "point")
    keyed = rows.withColumn("key", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    first = keyed.orderBy(F.asc_nulls_last("key"), "point").limit(k).collect()
    new = np.array([r["point"] for r in first], np.int64).reshape(-1, dims)
    old = np.zeros_like(new)
    if not len(new):
        return Clusters(rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"), F.array().cast("array<bigint>").alias("dots"), "point").limit(0), new)
    written: list[str] = []
    for turn in range(rounds + 1):
        rows = materialize(_assigned(rows, old, new), "distances", written)
        for path in written[:-1]:
            remove(spark, path)
        written = written[-1:]
        if turn == rounds:
            break
        count, sums = _sums(rows, len(new), dims)
        old, new = new, np.where(count[:, None] > 0, sums // np.maximum(count, 1)[:, None], new)
        if (old == new).all():
            break
    return Clusters(rows, new)


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings, their inertia, and digests of the final centroids."""
    found = cluster_vectors(read_table(spark, sf_dir, "embeddings"), CLUSTERS, ROUNDS, 2, DIMS, STEPS)
    inertia = found.inertia()
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    facts = [(c, inertia.get(c, 0), sum(inertia.values()), digest) for c, digest in enumerate(digests)]
    table = spark.createDataFrame(facts, "of int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")  # a row for each cluster
    return found.rows.select(F.col("id").alias("vec_id"), "cluster", "distance").join(F.broadcast(table), F.col("cluster") == F.col("of")).drop("of")
