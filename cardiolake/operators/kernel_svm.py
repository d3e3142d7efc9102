"""Support vector machines with an RBF kernel on landmark rows: weighted squared hinge, one machine for each pair of classes, Newton's method on Spark."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows whose kernel values a task holds at once.
BLOCK = 4_096
#: Tasks in which the sums of the machines meet at most.
MEETINGS = 200


@dataclass
class KernelSvm:
    """A fitted machine: order of the columns, scaling, landmarks (scaled) and, for each pair of classes, a weight for each landmark and a shift."""

    classes: list[str]
    columns: list[str]
    mean: np.ndarray
    deviation: np.ndarray
    landmarks: np.ndarray
    gamma: float
    weights: np.ndarray
    passes: int = 0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.deviation

    def kernel(self, scaled: np.ndarray) -> np.ndarray:
        """Kernel values of scaled rows and landmarks, and a one for the shift."""
        square = (scaled * scaled).sum(1)[:, None] + (self.landmarks * self.landmarks).sum(1)[None, :] - 2 * scaled @ self.landmarks.T
        return np.column_stack([np.exp(-self.gamma * np.maximum(square, 0)), np.ones(len(scaled))])

    def vote(self, x: np.ndarray) -> np.ndarray:
        """Number of the class with most votes; of equal ones that with the larger sum of margins, then the first."""
        margins = self.kernel(self.scaled(x)) @ self.weights.T
        votes, sums = np.zeros((len(x), len(self.classes))), np.zeros((len(x), len(self.classes)))
        for k, (a, b) in enumerate(itertools.combinations(range(len(self.classes)), 2)):
            votes[:, a] += margins[:, k] > 0
            votes[:, b] += margins[:, k] <= 0
            sums[:, a] += margins[:, k]
            sums[:, b] -= margins[:, k]
        return (votes + sums / (1 + np.abs(sums).max(initial=0)) / 3 / max(1, len(self.classes))).argmax(1)


def _matrix(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(n)])


def _pick_landmarks(rows: DataFrame, columns: list[str], label: str, classes: list[str], landmarks: int) -> np.ndarray:
    """Distinct rows of each class, an equal number of each, those of least hash."""
    each = -(-landmarks // len(classes))
    order = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))
    found = [r for c in classes for r in rows.where(F.col(label) == c).select(order.alias("__hash"), *columns).distinct().orderBy("__hash").limit(each).collect()]
    return np.array([[float(r[c]) for c in columns] for r in found], dtype=float).reshape(-1, len(columns))


def fit_kernel_svm(rows: DataFrame, columns: list[str], label: str, weight: str | None = None, landmarks: int = 384, gamma: float | None = None, cost: float = 1.0, passes: int = 40, tolerance: float = 1e-6) -> KernelSvm:
    """A machine for each pair of classes on the columns, scaled to mean 0 and variance 1.

    The kernel is exp(-gamma |x - y|^2), gamma 1 over the number of columns unless given; the space is spanned by
    `landmarks` rows, an equal number of each class. Each machine minimises |f|^2 / 2 + cost * sum of weight *
    max(0, 1 - y f)^2 / 2. A pass over the rows sums, for every machine, its loss, gradient and curvature where the
    margin is not reached (a matrix as wide as the landmarks); the minimum of that quadratic is found by the task where a
    machine's sums meet, and the step to it is halved where the loss has risen. It ends when no loss falls by more than its
    `tolerance`-th part. Rows with a null are left out. Work a pass: rows times landmarks squared; to the driver come a
    loss and the weights of each machine.
    """
    spark = rows.sparkSession
    used = rows.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], F.col(label).cast("string").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).dropna().persist()
    names = [f"x{i}" for i in range(len(columns))]
    classes = sorted(r["y"] for r in used.select("y").distinct().collect())
    stats = used.agg(*[F.avg(c).alias(f"m{c}") for c in names], *[F.stddev_pop(c).alias(f"s{c}") for c in names]).first()
    mean = np.array([stats[f"m{c}"] or 0.0 for c in names])
    deviation = np.array([stats[f"s{c}"] or 1.0 for c in names])
    pairs = list(itertools.combinations(range(len(classes)), 2))
    chosen = (_pick_landmarks(used, names, "y", classes, landmarks) - mean) / deviation if classes else np.zeros((0, len(columns)))
    machine = KernelSvm(classes, list(columns), mean, deviation, chosen, gamma or 1 / len(columns), np.zeros((len(pairs), len(chosen) + 1)))
    if pairs:
        size = len(chosen) + 1
        inner = machine.kernel(chosen)[:, :-1]
        penalty = np.zeros((size, size))
        penalty[:-1, :-1] = inner + 1e-8 * np.eye(len(chosen))
        penalty[-1, -1] = 1e-8  # the shift is as good as free
        # each task sends a matrix a machine, so no more tasks than keep all cores busy
        parts = max(1, min(used.rdd.getNumPartitions(), -(-used.count() // BLOCK), 2 * spark.sparkContext.defaultParallelism))
        data = used.coalesce(parts)
        loss, before = np.full(len(pairs), np.inf), machine.weights.copy()
        for _ in range(passes):
            machine.passes += 1
            now, minima = _minima(data, machine, pairs, names, cost, penalty)
            rose = now > loss * (1 + 1e-12)
            done = np.abs(loss - now) <= tolerance * now
            if (done | rose).all() and np.abs(machine.weights - before).max() <= 1e-3 * max(np.abs(before).max(), 1e-12) or done.all():
                break
            after = machine.weights.copy()
            for k in range(len(pairs)):
                if rose[k]:  # too far: half the way back
                    after[k] = (machine.weights[k] + before[k]) / 2
                    continue
                before[k], loss[k] = machine.weights[k], now[k]
                after[k] = minima[k]
            machine.weights = after
        machine.weights = np.where((now > loss)[:, None], before, machine.weights)
    used.unpersist()
    return machine


def _minima(data: DataFrame, machine: KernelSvm, pairs: list[tuple[int, int]], names: list[str], cost: float, penalty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss of every machine over all rows, and the weights at the minimum of its quadratic; a machine's partial sums meet in one task, which solves for them."""
    size = len(machine.landmarks) + 1
    shared, stiff = data.sparkSession.sparkContext.broadcast(machine), data.sparkSession.sparkContext.broadcast(penalty)
    numbers = {c: i for i, c in enumerate(machine.classes)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        loss, gradient, curve = np.zeros(len(pairs)), np.zeros((len(pairs), size)), np.zeros((len(pairs), size, size))
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                k = own.kernel(own.scaled(_matrix(part, len(names))))
                y = np.array([numbers[c] for c in part.column(len(names)).to_pylist()])
                w = cost * part.column(len(names) + 1).to_numpy(zero_copy_only=False)
                for m, (a, b) in enumerate(pairs):
                    mine = np.flatnonzero((y == a) | (y == b))
                    sign = np.where(y[mine] == a, 1.0, -1.0)
                    short = 1 - sign * (k[mine] @ own.weights[m])
                    on = short > 0
                    mine, sign, short, c = mine[on], sign[on], short[on], w[mine[on]]
                    loss[m] += 0.5 * (c * short * short).sum()
                    gradient[m] -= (c * short * sign) @ k[mine]
                    curve[m] += (k[mine] * c[:, None]).T @ k[mine]
        for m in range(len(pairs)):
            yield _packed(m, np.concatenate([loss[m : m + 1], gradient[m], curve[m].ravel()]))

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for m, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(blob.as_buffer(), float)
                if m in total:
                    total[m] += own
                else:
                    total[m] = own.copy()
        for m, sums in total.items():
            weights, fixed = shared.value.weights[m], stiff.value
            step = np.linalg.lstsq(sums[1 + size :].reshape(size, size) + fixed, sums[1 : 1 + size] + fixed @ weights, rcond=None)[0]
            yield _packed(m, np.concatenate([[sums[0] + 0.5 * weights @ fixed @ weights], weights - step]))

    packed = "machine int, found binary"
    parts = data.select(*names, "y", "w").mapInArrow(run, packed)
    found = parts.repartition(min(len(pairs), MEETINGS), "machine").mapInArrow(solved, packed).collect()
    shared.destroy()
    stiff.destroy()
    values = np.array([np.frombuffer(r["found"], float) for r in sorted(found, key=lambda r: r["machine"])])
    return values[:, 0].copy(), values[:, 1:].copy()


def _packed(machine: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([machine], pa.int32()), pa.array([values.tobytes()], pa.binary())], names=["machine", "found"])


def predict_kernel_svm(machine: KernelSvm, rows: DataFrame) -> DataFrame:
    """rows with `predicted`; null where one of the columns is null."""
    kept = [c for c in rows.columns if c != "predicted"]
    sent = rows.select(*[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(machine.columns)], *kept)
    shared = rows.sparkSession.sparkContext.broadcast(machine)
    n = len(machine.columns)
    schema = rows.select(*kept).schema.add("predicted", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                x = _matrix(part, n)
                whole = ~np.isnan(x).any(1)
                found = np.full(len(x), None, dtype=object)
                if own.classes:
                    found[whole] = np.array(own.classes, dtype=object)[own.vote(x[whole])]
                yield pa.RecordBatch.from_arrays([*part.columns[n:], pa.array(found.tolist(), pa.string())], names=[*kept, "predicted"])

    return sent.mapInArrow(run, schema)
