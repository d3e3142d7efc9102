"""The forest on Spark: against Spark's own on few rows, and the same trees however they are divided between tops and subtrees."""

import numpy as np
from pyspark.sql import functions as F

from cardiolake.operators import forest, learning


def rings(spark, n, seed=2):
    """Rings of three classes, the third a feature without meaning; weights make classes equal."""
    rng = np.random.default_rng(seed)
    y = rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1])
    turn = rng.uniform(0, 2 * np.pi, n)
    radius = np.select([y == "a", y == "b"], [1.0, 2.0], 3.0) + rng.normal(0, 0.35, n)
    x = np.column_stack([radius * np.cos(turn) * 5 + 3, radius * np.sin(turn), rng.normal(size=n)])
    return spark.createDataFrame([(i, *map(float, x[i]), str(y[i]), float(n / (3 * (y == y[i]).sum()))) for i in range(n)], "id int, p double, q double, r double, label string, weight double").repartition(5)


def judge(rows, cut, path, **more):
    found = forest.predict_forest(rows.where(f"id < {cut}"), rows.where(f"id >= {cut}"), ["p", "q", "r"], "label", "weight", ["id"], str(path), **more)
    return {r["id"]: (r["label"], r["predicted"]) for r in found.collect()}


def test_as_good_as_sparks_and_the_same_however_divided(spark, tmp_path, monkeypatch):
    rows = rings(spark, 1_600)
    got = judge(rows, 800, tmp_path / "whole", trees=30)
    share = lambda pairs: np.mean([a == b for a, b in pairs])
    fitted = learning.fit(rows.where("id < 800"), "forest", ["p", "q", "r"], "label", "weight", trees=30)
    want = [(r["label"], r["predicted"]) for r in learning.predict(fitted, rows.where("id >= 800")).select("label", "predicted").collect()]
    assert len(got) == len(want) == 800 and share(got.values()) > 0.8 and abs(share(got.values()) - share(want)) < 0.03
    monkeypatch.setattr(forest, "ROWS", 60)
    assert judge(rows.repartition(2), 800, tmp_path / "divided", trees=30) == got


def test_grown_to_pure_leaves():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 32, (3_000, 7), dtype=np.uint8), rng.integers(0, 3, 3_000)
    shares = forest.grow(x, y, np.full(3_000, 1.0), x, 7, 30, 3)
    assert np.allclose(shares.sum(1), 1) and (shares.argmax(1) == y).mean() > 0.97
    assert (forest.grow(x, y, np.full(3_000, 1.0), x[:5], 7, 0, 3) == np.bincount(y) / 3_000).all()
    assert abs(forest.bagged(rng.integers(0, 2**63, 20_000).astype(np.uint64), 3).mean() - 1) < 0.03


def test_odd_rows(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(i, 1.0, None if i == 99 else 2.0, 3.0, None if i == 97 else "z" if i == 98 else "ab"[i % 3 % 2]) for i in range(100)], "id int, p double, q double, r double, label string").withColumn("weight", F.lit(1.0))
    for most in (50_000, 10):  # equal rows can't be split: one leaf, in a task or in the tops
        monkeypatch.setattr(forest, "ROWS", most)
        got = judge(rows, 60, tmp_path / str(most), trees=9)
        assert len(got) == 38 and got[99] == ("a", None) and {p for i, (_, p) in got.items() if i < 97} == {"a"}
    assert judge(rows.where("id >= 60"), 60, tmp_path / "none", trees=3) == {}
