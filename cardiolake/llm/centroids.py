"""Clustering around centroids in whole numbers: Hamerly's bounds spare most vectors the scan of all centroids."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardiolake.llm.common import stored

#: Components are whole parts of 1/SCALE. Beyond LARGEST a squared distance of 64 of them may not fit a long.
SCALE, LARGEST = 1_024, 1 << 27
#: Vectors that a task compares at once.
BLOCK = 4_096


def whole_vectors(vectors: DataFrame, dims: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, x (whole components) and row (its number) of the rows with exactly `dims` components, none null or not finite."""
    good = (F.size(vector) == dims) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * SCALE).cast("long"))
    kept = vectors.where(F.col(vector).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(key).alias("vec_id"), x.alias("x"))
    fits = F.forall("x", lambda v: F.abs(v) <= LARGEST)
    return kept.withColumn("x", F.when(fits, F.col("x")).otherwise(F.raise_error(F.lit("a component is too large for distances in long")))).withColumn("row", F.monotonically_increasing_id())


def first_centroids(rows: DataFrame, k: int, salt: str = "3:") -> np.ndarray:
    """The vectors of the k rows whose salted id has the least SHA-256, in its order; ties by the vectors. A null id is an empty one."""
    order = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(order.alias("hash"), "x").orderBy("hash", "x").limit(k).collect()
    return np.array([r["x"] for r in first], dtype=np.int64)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all centroids."""
    out = np.empty((len(x), len(centroids)), dtype=np.int64)
    for k, c in enumerate(centroids):
        d = x - c
        out[:, k] = np.einsum("ij,ij->i", d, d)
    return out


def root_above(squares: np.ndarray) -> np.ndarray:
    """A float that is no less than the square root: one step covers the rounding of the number, another that of the root."""
    return np.nextafter(np.sqrt(np.nextafter(squares.astype(float), np.inf)), np.inf)


def root_below(squares: np.ndarray) -> np.ndarray:
    """A float that is no more than the square root, nor negative."""
    return np.maximum(np.nextafter(np.sqrt(np.maximum(np.nextafter(squares.astype(float), -np.inf), 0)), -np.inf), 0)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By a full scan: nearest centroid (of ties the smaller number), upper bound of the distance to it, lower bound of that to any other."""
    d = squared_distances(x, centroids)
    own = d.argmin(1)
    at = np.arange(len(x))
    least = d[at, own].copy()
    if d.shape[1] == 1:
        return own, root_above(least), np.full(len(x), np.inf)
    d[at, own] = np.iinfo(np.int64).max
    return own, root_above(least), root_below(d.min(1))


class Step:
    """What every task knows of a round: the centroids, how far each has moved, and half the way from each to the next one."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.centroids = centroids
        k = len(centroids)
        self.drift = np.zeros(k) if before is None else root_above(((centroids - before) ** 2).sum(1))
        #: the largest drift of any other centroid
        self.others = np.array([max(np.delete(self.drift, j), default=0.0) for j in range(k)])
        apart = squared_distances(centroids, centroids)
        np.fill_diagonal(apart, np.iinfo(np.int64).max)
        self.half = root_below(apart.min(1)) / 2 if k > 1 else np.full(k, np.inf)

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Cluster and bounds of each vector now, and how many needed a full scan.

        Bounds are loosened by the drift, rounded outwards. While upper < max(lower, half), the own centroid is nearer
        than any other; otherwise upper is first set to the exact distance, and only where that doesn't decide are
        all centroids scanned.
        """
        upper = np.nextafter(upper + self.drift[own], np.inf)
        lower = np.maximum(np.nextafter(lower - self.others[own], -np.inf), 0)
        bar = np.maximum(lower, self.half[own])
        open_ = np.flatnonzero(upper >= bar)
        if len(open_):
            d = x[open_] - self.centroids[own[open_]]
            upper[open_] = root_above(np.einsum("ij,ij->i", d, d))
            open_ = open_[upper[open_] >= bar[open_]]
        if len(open_):
            own, upper, lower = own.copy(), upper, lower.copy()
            own[open_], upper[open_], lower[open_] = nearest(x[open_], self.centroids)
        return own, upper, lower, len(open_)


BOUNDS = "row long, cluster int, upper double, lower double, sums array<long>, scanned long"


def _matrix(column: pa.Array) -> np.ndarray:
    at = column.offsets.to_numpy(zero_copy_only=False)
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].reshape(len(column), -1)


class Rounds:
    """The vectors, written once into buckets of their row numbers, and for each round a table of bounds in the same buckets."""

    def __init__(self, rows: DataFrame, k: int):
        self.spark: SparkSession = rows.sparkSession
        self.name = f"centroids_{uuid.uuid4().hex}"
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self._write(rows.repartition(self.buckets, "row"), "vectors")
        self.vectors = self.spark.table(f"{self.name}_vectors")
        self.centroids = first_centroids(self.vectors, k)
        self.bounds: str | None = None
        self.scanned: list[int] = []

    def _write(self, df: DataFrame, kind: str) -> str:
        table = f"{self.name}_{kind}"
        df.write.bucketBy(self.buckets, "row").sortBy("row").saveAsTable(table)
        return table

    def joined(self) -> DataFrame:
        """Vectors with their bounds: equal buckets meet without a shuffle; the smaller side, bounds, is the one in memory."""
        bounds = self.spark.table(self.bounds).where("sums is null").drop("sums", "scanned")
        return self.vectors.drop("vec_id").join(bounds.hint("shuffle_hash"), "row")

    def assign(self, before: np.ndarray | None, number: int) -> list:
        """Assign all vectors, write the new bounds; returns count and componentwise sum of each cluster."""
        shared = self.spark.sparkContext.broadcast(Step(self.centroids, before))
        first = before is None
        k = len(self.centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = shared.value
            total, n, scans, place = np.zeros(step.centroids.shape, np.int64), np.zeros(k, np.int64), 0, 0
            for batch in batches:
                for start in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(start, BLOCK)
                    x, place = _matrix(part.column(0)), part.column(1)[0].as_py()
                    if first:
                        own, upper, lower = nearest(x, step.centroids)
                        new = len(x)
                    else:
                        own, upper, lower, new = step.assign(x, *(part.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4)))
                    scans += new
                    for j in np.unique(own):
                        total[j] += x[own == j].sum(0)
                    n += np.bincount(own, minlength=k)
                    yield pa.RecordBatch.from_arrays([part.column(1), pa.array(own.astype(np.int32)), pa.array(upper), pa.array(lower), pa.nulls(len(x), pa.list_(pa.int64())), pa.nulls(len(x), pa.int64())], names=names)
            if n.any():  # the task's sums, k rows, under the number of one of its rows so that they stay in its bucket
                lists = pa.array(np.column_stack([n, total]).tolist(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([place] * k, pa.int64()), pa.array(np.arange(k, dtype=np.int32)), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()), lists, pa.array([scans] + [0] * (k - 1), pa.int64())], names=names)

        names = ["row", "cluster", "upper", "lower", "sums", "scanned"]
        rows = self.vectors.select("x", "row") if first else self.joined().select("x", "row", "cluster", "upper", "lower")
        old, self.bounds = self.bounds, self._write(rows.mapInArrow(run, BOUNDS), f"bounds_{number}")
        if old:
            self.spark.sql(f"DROP TABLE {old}")
        sums = self.spark.table(self.bounds).where("sums is not null")
        found = sums.groupBy("cluster").agg(F.sum("scanned").alias("scanned"), *[F.sum(F.element_at("sums", i + 1)).alias(f"s{i}") for i in range(self.centroids.shape[1] + 1)]).collect()
        self.scanned.append(sum(r["scanned"] for r in found))
        return found

    def moved(self, found: list) -> np.ndarray:
        """Every centroid with vectors goes to the floor of their mean; the others stay."""
        out = self.centroids.copy()
        for r in found:
            n = r["s0"]
            if n:
                out[r["cluster"]] = [r[f"s{i + 1}"] // n for i in range(out.shape[1])]
        return out

    def close(self) -> None:
        """Drop the tables."""
        for table in (self.bounds, f"{self.name}_vectors"):
            if table:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")


def cluster(vectors: DataFrame, k: int = 8, dims: int = 64, rounds: int = 10, key: str = "vec_id", vector: str = "embedding", scans: list[int] | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    Vectors with `dims` components, none null or not finite, are kept, as whole numbers floor(1024 * x). The first
    centroids are those of first_centroids. Each round assigns every vector to the nearest centroid (of ties, the
    smaller number) and moves every centroid that has vectors to the floor of their mean; at the end vectors are
    assigned once more. distance is the exact squared one; centroid_sha256 hashes the components in decimal, joined by
    commas. The result doesn't hang on partitions: distances and sums are whole numbers, bounds only spare scans.

    Vectors are written once, in buckets; a round reads them with the last round's bounds, writes new bounds (25 bytes
    a vector), and brings k sums to the driver. Fewer than k kept vectors give as many centroids; none give no rows.
    Repeated rows and repeated or null ids all count, each for itself. A component beyond 2**17 before scaling is an
    error, as distances are longs. Other columns play no part. scans: gets the number of full scans of each pass.
    """
    state = Rounds(whole_vectors(vectors, dims, key, vector), k)
    spark = vectors.sparkSession
    try:
        if not len(state.centroids):
            kind = dict(state.vectors.dtypes)["vec_id"]
            return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
        before = None
        for number in range(rounds + 1):
            found = state.assign(before, number)
            if number < rounds:
                before, state.centroids = state.centroids, state.moved(found)
        if scans is not None:
            scans += state.scanned
        final = spark.createDataFrame([(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest(), c) for j, c in enumerate(state.centroids.tolist())], "cluster int, centroid_sha256 string, c array<long>")  # k rows
        with_id = state.vectors.join(spark.table(state.bounds).where("sums is null").select("row", "cluster").hint("shuffle_hash"), "row").join(F.broadcast(final), "cluster")
        square = F.aggregate(F.zip_with("x", "c", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, d: s + d)
        rows = stored(with_id.select("vec_id", "cluster", square.alias("distance"), "centroid_sha256"), "clusters")
    finally:
        state.close()
    own = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    totals = own.select("cluster", "cluster_inertia", F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0))).alias("inertia"))  # k rows
    return rows.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 8, dims: int = 64, rounds: int = 10) -> str:
    """The same by full scans, one pass after the other."""
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, embedding, row_number() OVER () AS r FROM embeddings WHERE len(embedding) = {dims} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = {dims})",
        f"v AS MATERIALIZED (SELECT r, j, floor({SCALE} * embedding[j]::DOUBLE)::BIGINT AS x FROM kept, range(1, {dims + 1}) t(j))",
        f"s AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), [floor({SCALE} * x::DOUBLE) for x in embedding]) - 1 AS c FROM kept QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, j, x AS y FROM s JOIN v USING (r))",
    ]
    for n in range(rounds + 1):
        parts.append(f"d{n} AS (SELECT r, c, sum((x - y) * (x - y))::BIGINT AS d FROM v JOIN c{n} USING (j) GROUP BY r, c), a{n} AS MATERIALIZED (SELECT r, c, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if n < rounds:
            parts.append(f"m{n} AS (SELECT c, j, sum(x)::BIGINT AS t, count(*) AS n FROM a{n} JOIN v USING (r) GROUP BY c, j), c{n + 1} AS MATERIALIZED (SELECT c, j, coalesce((t - ((t % n) + n) % n) // n, y)::BIGINT AS y FROM c{n} LEFT JOIN m{n} USING (c, j))")
    parts.append(f"h AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    return f"WITH {', '.join(parts)} SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN h USING (c) JOIN kept USING (r)"


ORACLE_SQL = _sql()
