"""The kernel machine on Spark against the dual problem solved in plain NumPy."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from cardiolake.operators import kernel_svm


def plain_dual(x, y, weights, gamma, cost, test):
    """One machine a pair of classes: coordinate ascent on the dual of the weighted squared hinge, a one added to the kernel for the shift."""
    k = lambda a, b: np.exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(2)) + 1.0
    classes = sorted(set(y))
    votes = np.zeros((len(test), len(classes)))
    for a, b in itertools.combinations(range(len(classes)), 2):
        mine = np.flatnonzero((y == classes[a]) | (y == classes[b]))
        sign = np.where(y[mine] == classes[a], 1.0, -1.0)
        q = k(x[mine], x[mine]) * np.outer(sign, sign) + np.diag(1 / (cost * weights[mine]))
        alpha = np.zeros(len(mine))
        slope = -np.ones(len(mine))
        for _ in range(100):
            for i in range(len(mine)):
                step = max(alpha[i] - slope[i] / q[i, i], 0) - alpha[i]
                alpha[i] += step
                slope += step * q[i]
        margin = k(test, x[mine]) @ (alpha * sign)
        votes[:, a] += margin > 0
        votes[:, b] += margin <= 0
    return np.array(classes)[votes.argmax(1)]


def test_within_one_percent_of_the_dual(spark):
    rng = np.random.default_rng(2)
    n = 2_400
    y = rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1])
    turn = rng.uniform(0, 2 * np.pi, n)
    radius = np.select([y == "a", y == "b"], [1.0, 2.0], 3.0) + rng.normal(0, 0.35, n)
    x = np.column_stack([radius * np.cos(turn) * 5 + 3, radius * np.sin(turn), rng.normal(size=n)])
    weights = np.array([n / (3 * (y == c).sum()) for c in y])
    rows = spark.createDataFrame([(i, *map(float, x[i]), str(y[i]), float(weights[i])) for i in range(n)], "id int, p double, q double, r double, label string, weight double").repartition(5)
    train, test = rows.where("id < 1200"), rows.where("id >= 1200")
    machine = kernel_svm.fit_kernel_svm(train, ["p", "q", "r"], "label", "weight")
    got = {r["id"]: r["predicted"] for r in kernel_svm.predict_kernel_svm(machine, test).collect()}
    got = np.array([got[i] for i in range(1_200, n)])
    mean, deviation = x[:1_200].mean(0), x[:1_200].std(0)
    want = plain_dual((x[:1_200] - mean) / deviation, y[:1_200], weights[:1_200], 1 / 3, 1.0, (x[1_200:] - mean) / deviation)
    balanced = lambda p: np.mean([(p == y[1_200:])[y[1_200:] == c].mean() for c in "abc"])
    assert machine.passes < 40 and abs((got == y[1_200:]).mean() - (want == y[1_200:]).mean()) <= 0.01
    assert abs(balanced(got) - balanced(want)) <= 0.01 and balanced(got) > 0.8 and (got == want).mean() > 0.97
    # without weights the rare class suffers
    bare = kernel_svm.predict_kernel_svm(kernel_svm.fit_kernel_svm(train, ["p", "q", "r"], "label"), test).select("id", "predicted").toPandas().sort_values("id")
    assert balanced(bare["predicted"].to_numpy()) < balanced(got)


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1.0, 5.0, "a"), (1.0, 5.0, "a"), (2.0, 5.0, "b"), (None, 5.0, "b"), (3.0, 5.0, None)], "p double, q double, label string").withColumn("predicted", F.lit("x"))
    out = kernel_svm.predict_kernel_svm(kernel_svm.fit_kernel_svm(rows, ["p", "q"], "label"), rows)
    assert [(r["p"], r["predicted"]) for r in out.collect()] == [(1.0, "a"), (1.0, "a"), (2.0, "b"), (None, None), (3.0, "a")]  # far from all rows, the shift decides
    one = kernel_svm.fit_kernel_svm(rows.where("label = 'a'"), ["p", "q"], "label")
    assert {r["predicted"] for r in kernel_svm.predict_kernel_svm(one, rows.where("p is not null")).collect()} == {"a"}
    none = kernel_svm.fit_kernel_svm(rows.where("false"), ["p", "q"], "label")
    assert {r["predicted"] for r in kernel_svm.predict_kernel_svm(none, rows).collect()} == {None}


def test_driver_gets_weights_alone(spark, monkeypatch):
    """A pass of ten classes sent 45 matrices (of 385 squared) to the driver, and more with more tasks."""
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(*map(float, rng.normal(size=2)), str(i % 10)) for i in range(9_000)], "p double, q double, label string").repartition(6)
    sent, collect = [0], type(rows).collect

    def counted(frame):
        found = collect(frame)
        sent[0] += sum(len(v) for r in found for v in r if isinstance(v, (bytes, bytearray)))
        return found

    monkeypatch.setattr(type(rows), "collect", counted)
    machine = kernel_svm.fit_kernel_svm(rows, ["p", "q"], "label", passes=2)
    assert machine.weights.shape == (45, len(machine.landmarks) + 1) and 0 < sent[0] < 1_000_000
