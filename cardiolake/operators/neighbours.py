"""Exact nearest neighbours: pivots and triangle bounds rule out cells of rows, and rows inside a cell, before distances are taken."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task compares at once; queries that one broadcast holds.
BLOCK, QUERIES = 2_048, 20_000
#: Squared distances count as equal below this; bounds are wider by it.
SAME = 1e-6


def _vectors(column: pa.Array) -> np.ndarray:
    at = column.offsets.to_numpy(zero_copy_only=False)
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(float).reshape(len(column), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


class Cells:
    """Pivots; of each one's cell (the rows nearest to it), the largest distance and the k + 1 least ones."""

    def __init__(self, base: DataFrame, k: int, vector: str, key: str, pivots: int):
        order = F.xxhash64(F.col(key).cast("string"))
        found = base.select(F.col(vector).alias("v")).orderBy(order, vector).limit(pivots).collect()
        self.pivots = np.array([r["v"] for r in found], dtype=float)
        shared = base.sparkSession.sparkContext.broadcast(self)

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = shared.value
            far, near = np.zeros(len(cells.pivots)), [np.zeros(0)] * len(cells.pivots)
            for batch in batches:
                cell, own = cells.of(_vectors(batch.column(0)))
                np.maximum.at(far, cell, own)
                for c in np.unique(cell):
                    near[c] = np.sort(np.concatenate([near[c], own[cell == c]]))[: k + 1]
            used = [c for c in range(len(far)) if len(near[c])]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(far[used]), pa.array([near[c].tolist() for c in used], pa.list_(pa.float64()))], names=["cell", "far", "near"])

        per = base.select(vector).mapInArrow(measured, "cell int, far double, near array<double>").groupBy("cell").agg(F.max("far").alias("far"), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
        self.far, self.near = np.full(len(self.pivots), -np.inf), np.full((len(self.pivots), k + 1), np.inf)
        for r in per.collect() if len(self.pivots) else []:  # a row a pivot
            self.far[r["cell"]] = r["far"]
            self.near[r["cell"], : len(r["near"])] = r["near"]

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each vector, and its distance to the cell's pivot."""
        d = _distances(x, self.pivots)
        cell = d.argmin(1)
        return cell, d[np.arange(len(x)), cell]

    def reach(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query: distances to the pivots, a bound of the distance to its k-th neighbour (itself left out), and which cells can hold a row within it."""
        d = _distances(q, self.pivots)
        bound = np.empty(len(q))
        for start in range(0, len(q), 256):
            ways = (d[start : start + 256, :, None] + self.near[None]).reshape(len(d[start : start + 256]), -1)
            bound[start : start + 256] = np.partition(ways, k, axis=1)[:, k] if ways.shape[1] > k else np.inf
        bound = np.sqrt(bound * bound + 4 * SAME) + SAME
        needed = d - self.far[None] <= bound[:, None]
        # a row of another cell lies beyond the plane half way between its pivot and the query's own
        own = d.argmin(1)
        apart = _distances(self.pivots, self.pivots)[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d * d - (d.min(1) ** 2)[:, None]) / (2 * apart)
        needed &= ~(plane > bound[:, None] + SAME)
        return d, bound, needed


def _merged(query: np.ndarray, d: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Of rows that may be neighbours, the k nearest of each query, by distance and then by place."""
    order = np.lexsort((place, d, query))
    heads = np.searchsorted(query[order], query[order])
    return order[np.arange(len(order)) - heads < k]


def nearest_rows(queries: DataFrame, base: DataFrame, k: int, vector: str = "v", label: str = "label", key: str = "id", pivots: int = 64, block: int = QUERIES, compared: list | None = None) -> DataFrame:
    """query, id, label, d (squared distance, to 6 places) and rank of the k nearest rows of base, other than the query itself.

    Exact: ties go to the smaller id. Rows without a vector are left out; the others' are equally long. Queries travel in blocks of `block` at most (by a hash of the key); a task drops
    the cells that no query can need and, in the others, the rows whose distance to the pivot rules them out, and keeps k
    candidates of a query. base isn't shuffled, however many rows share a cell. compared: gets pairs taken and all pairs.
    """
    queries, base = (rows.where(F.col(vector).isNotNull()) for rows in (queries, base))
    cells = Cells(base, k, vector, key, pivots)
    kind, label_kind = base.schema[key].dataType.simpleString(), base.schema[label].dataType.simpleString()
    schema = f"query {kind}, d double, id {kind}, label {label_kind}, pairs long, every long"
    count = queries.count()
    parts = max(1, -(-count // block))
    out = None
    for number in range(parts):
        own = queries if parts == 1 else queries.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)) == number)
        rows = own.select(F.col(key).alias("query"), F.col(vector).alias("v")).collect()
        found = _candidates(base.select(vector, key, label), rows, cells, k, schema)
        out = found if out is None else out.unionByName(found)
    out = out.persist()
    if compared is not None:
        sums = out.agg(F.sum("pairs"), F.sum("every")).first()
        compared += [sums[0] or 0, sums[1] or 0]
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d", "id"))
    return out.where("pairs is null").select("query", "id", "label", "d", rank.alias("rank")).where(F.col("rank") <= k)


def _candidates(base: DataFrame, rows: list, cells: Cells, k: int, schema: str) -> DataFrame:
    names = ["query", "d", "id", "label", "pairs", "every"]
    keys = [r["query"] for r in rows]
    if not rows or not len(cells.pivots):
        return base.sparkSession.createDataFrame([], schema)
    q = np.array([r["v"] for r in rows], dtype=float)
    to_pivot, bound, needed = cells.reach(q, k)
    shared = base.sparkSession.sparkContext.broadcast((cells, keys, q, (q * q).sum(1), to_pivot, bound, needed))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, keys, q, squares, to_pivot, bound, needed = shared.value
        numbers = {x: i for i, x in enumerate(keys)}
        best_q, best_d, best_row = np.zeros(0, np.int64), np.zeros(0), []
        limit = bound * bound
        pairs = every = 0
        ids, labels = [], []
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                x = _vectors(part.column(0))
                names_, marks = part.column(1).to_pylist(), part.column(2).to_pylist()
                cell, own = cells.of(x)
                every += len(x) * len(q)
                taken_q, taken_d, taken_at = [best_q], [best_d], [np.arange(len(ids))]
                for c in np.unique(cell):
                    who, rows = np.flatnonzero(needed[:, c]), np.flatnonzero(cell == c)
                    near = np.abs(to_pivot[who, c][:, None] - own[rows][None, :]) <= bound[who][:, None]
                    i, j = np.nonzero(near)
                    if not len(i):
                        continue
                    pairs += len(i)
                    rough = squares[who][:, None] + (x[rows] * x[rows]).sum(1)[None, :] - 2 * q[who] @ x[rows].T
                    close = rough[i, j] <= limit[who[i]] * (1 + 1e-9) + SAME
                    i, j = who[i[close]], rows[j[close]]
                    apart = q[i] - x[j]
                    d = np.round((apart * apart).sum(1), 6)
                    same = np.array([numbers.get(names_[a]) for a in j]) == i if len(j) else np.zeros(0, bool)
                    taken_q.append(i[~same])
                    taken_d.append(d[~same])
                    taken_at.append(len(ids) + j[~same])
                all_q, all_d, all_at = map(np.concatenate, (taken_q, taken_d, taken_at))
                all_ids, all_labels = ids + names_, labels + marks
                # ids decide between equal distances, so places follow their order
                place = np.empty(len(all_ids), dtype=np.int64)
                place[sorted(range(len(all_ids)), key=lambda a: (all_ids[a] is not None, all_ids[a]))] = np.arange(len(all_ids))
                kept = _merged(all_q, all_d, place[all_at], k)
                best_q, best_d = all_q[kept], all_d[kept]
                ids, labels = [all_ids[a] for a in all_at[kept]], [all_labels[a] for a in all_at[kept]]
                # k rows that are within reach narrow it
                full, n = np.unique(best_q, return_counts=True)
                worst = np.full(len(q), -np.inf)
                np.maximum.at(worst, best_q, best_d)
                limit[full[n >= k]] = np.minimum(limit[full[n >= k]], worst[full[n >= k]] + 2 * SAME)
        n = len(ids)
        types = [f.type for f in arrow]
        yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in best_q] + [None], types[0]), pa.array(best_d.tolist() + [None], types[1]), pa.array(ids + [None], types[2]), pa.array(labels + [None], types[3]), pa.array([None] * n + [pairs], pa.int64()), pa.array([None] * n + [every], pa.int64())], names=names)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(base.sparkSession.createDataFrame([], schema).schema)
    return base.mapInArrow(compared, schema)


def nearest(queries: DataFrame, base: DataFrame, k: int, vector: str = "v", label: str = "label", key: str = "id", **options) -> DataFrame:
    """Majority label of each query's k nearest rows (ties: the nearer neighbour's label)."""
    near = nearest_rows(queries, base, k, vector, label, key, **options)
    votes = near.groupBy("query", "label").agg(F.count("*").alias("votes"), F.min("rank").alias("best"))
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.col("votes").desc(), "best"))
    return votes.withColumn("n", first).where("n = 1").select("query", F.col("label").alias("predicted"), "votes")
