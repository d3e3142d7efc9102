"""Neighbours by pivots against all pairs."""

import numpy as np
import pytest

from cardiolake.operators import neighbours


@pytest.mark.parametrize(("k", "pivots", "block"), [(1, 16, 10_000), (5, 16, 60), (5, 1, 10_000), (3, 400, 10_000)])
def test_all_pairs_agree(spark, k, pivots, block):
    rng = np.random.default_rng(k)
    middles = rng.normal(size=(12, 6)) * 8
    x = np.vstack([middles[rng.integers(0, 12, 300)] + rng.normal(size=(300, 6)), np.repeat(middles[:1], 60, 0), rng.integers(0, 2, (40, 6))])
    labels = [["a", "b", None][i % 3] for i in range(len(x))]
    base = spark.createDataFrame([(i, [float(c) for c in v], y) for i, (v, y) in enumerate(zip(x, labels))], "id long, v array<double>, label string").repartition(3)
    compared = []
    got = {}
    for r in neighbours.nearest_rows(base.where("id % 2 = 0"), base, k, pivots=pivots, block=block, compared=compared).collect():
        got.setdefault(r["query"], []).append((r["d"], r["id"], r["label"]))
    d = np.round(((x[:, None] - x[None]) ** 2).sum(2), 6)
    for q in range(0, len(x), 2):
        order = sorted((d[q, i], i) for i in range(len(x)) if i != q)[:k]
        assert sorted(got[q]) == [(e, i, labels[i]) for e, i in order]
    assert compared[1] == 200 * 400 and (pivots == 1 or compared[0] < compared[1] / 3)


def test_few_and_no_rows(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0], "a"), (2, [0.0, 2.0], "b")], "id long, v array<double>, label string")
    assert [tuple(r) for r in neighbours.nearest(rows.where("id = 1"), rows, 5).collect()] == [(1, "b", 1)]
    assert neighbours.nearest(rows.where("false"), rows, 5).count() == neighbours.nearest(rows, rows.where("false"), 5).count() == 0
