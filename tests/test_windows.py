"""Windows, features and spans against hand-computed cases and a plain loop."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cardiolake.operators import quality, spans, windows
from cardiolake.operators.rr import FEATURES, beat_features, entropy_bin, intervals, narrowed, window_features
from cardiolake.schema import rhythm_of

W = 15_000


def test_grid(spark):
    rows = spark.createDataFrame([("a", 1_048_577), ("b", W - 1), ("c", W)], "patient_id string, length long")
    got = {r["patient_id"]: (r["n"], r["e"]) for r in windows.grid(rows, W).groupBy("patient_id").agg(F.count("*").alias("n"), F.max("end_sample").alias("e")).collect()}
    assert got == {"a": (69, 1_035_000), "c": (1, W)}
    with pytest.raises(ValueError):
        windows.grid(rows, 0)


@pytest.mark.parametrize(
    "span_rows, fractions, label",
    [
        ([(0, 9_000, "NSR"), (9_000, 15_000, "AFib")], (0.6, 0.4, 0.0), 0),
        ([(1_000, 5_000, "AFib")], (0.0, 4_000 / 15_000, 0.0), 1),
        ([], (0.0, 0.0, 0.0), 0),
        ([(0, 7_500, "AFib"), (7_500, 15_000, "NSR")], (0.5, 0.5, 0.0), 0),
        ([(0, 1_048_577, "NSR")], (1.0, 0.0, 0.0), 0),
    ],
)
def test_labels(spark, span_rows, fractions, label):
    s = spark.createDataFrame([("p", *r) for r in span_rows], "patient_id string, start_sample long, end_sample long, rhythm string")
    grid = windows.grid(spark.createDataFrame([("p", W)], "patient_id string, length long"), W)
    row = windows.labelled(grid, windows.overlaps(s, W), W).first()
    assert tuple(row[f] for f in windows.FRACTIONS) == pytest.approx(fractions)
    assert row["label_id"] == label
    assert row["purity"] == (0 if not span_rows else pytest.approx(max(fractions) / sum(fractions)))


def naive(beats, fs, width):
    out = {}
    for pid, rows in beats.items():
        rows = sorted(s for s, c in rows if c in (1, 4, 5, 8, 9))
        for wid in {s // width for s in rows}:
            own = [s for s in rows if s // width == wid]
            rr = [(b - a) / fs for a, b in zip(own, own[1:])]
            if not rr:
                continue
            ok = [0.24 <= x <= 2.0 for x in rr]
            good = [x for x, k in zip(rr, ok) if k]
            d = [b - a for a, b, k, q in zip(rr, rr[1:], ok, ok[1:]) if k and q]
            f = {"n_rr_used": len(good), "n_rr_rejected": len(rr) - len(good), "n_drr_used": len(d), **dict.fromkeys(FEATURES)}
            if good:
                f["mean_rr"] = sum(good) / len(good)
                f["hr"] = 60 / f["mean_rr"]
            if len(good) > 1:
                f["hrv_sdnn"] = math.sqrt(sum((x - f["mean_rr"]) ** 2 for x in good) / (len(good) - 1))
                f["cv_rr"] = f["hrv_sdnn"] / f["mean_rr"]
                bins = [min(max(int((x - 0.24) / (2.0 - 0.24) * 16), 0), 15) for x in good]
                f["rr_entropy"] = abs(sum(-bins.count(b) / len(bins) * math.log2(bins.count(b) / len(bins)) for b in set(bins)))
            if d:
                f["rmssd"], f["pnn50"] = math.sqrt(sum(x * x for x in d) / len(d)), sum(abs(x) > 0.05 for x in d) / len(d)
            out[pid, wid] = f
    return out


def test_features_match_a_plain_loop(spark):
    rng = random.Random(1)
    beats = {}
    for p in range(40):
        at, rows = 0, []
        while at < W * rng.randint(1, 4):
            at += rng.randint(40, 899)
            rows.append((at, rng.choice([1, 1, 1, 5, 8, 13, 28])))
        beats[p] = rows
    frame = spark.createDataFrame([(p, s, c) for p, rows in beats.items() for s, c in rows], "patient_id long, sample long, code int")
    got = {(r["patient_id"], r["wid"]): r for r in window_features(intervals(frame, 250.0, W)).collect()}
    want = naive(beats, 250.0, W)
    assert got.keys() == want.keys()
    for key, f in want.items():
        for name, value in f.items():
            assert got[key][name] == (None if value is None else pytest.approx(value, abs=1e-9)), (key, name)


def test_all_rejected_and_single(spark):
    frame = spark.createDataFrame([("a", s, 1) for s in (0, 10, 20, 30)] + [("b", 5, 1)], "patient_id string, sample long, code int")
    rows = {r["patient_id"]: r for r in window_features(intervals(frame, 250.0, W)).collect()}
    assert rows.keys() == {"a"} and rows["a"]["n_rr_used"] == 0 and rows["a"]["n_rr_rejected"] == 3 and rows["a"]["mean_rr"] is None


def test_bin_edge_codes_and_storage(spark):
    assert spark.range(1).select(entropy_bin(F.lit(170) / F.lit(250.0))).first()[0] == 4
    counts = windows.beat_counts(spark.createDataFrame([("a", i, c) for i, c in enumerate((1, 28, 13, 5, 8, 22, 1))], "patient_id string, sample long, code int"), W).first()
    assert (counts["n_beats"], counts["n_q"], counts["n_v"], counts["n_sv"]) == (5, 1, 1, 1)
    assert spark.range(1).select(narrowed(F.lit(0.123456)).cast("double")).first()[0] == pytest.approx(0.12346, abs=1e-7)


def test_spans(spark):
    notes = [(0, "(N"), (100, "(VT"), (200, "(AFIB"), (250, "(VT"), (300, ")"), (400, "(AFL"), (500, "(NOD"), (900, None)]
    rows = spark.createDataFrame([("p", s, i, n) for i, (s, n) in enumerate(notes)], "patient_id string, sample long, ann_idx int, note string")
    got = sorted((r["start_sample"], r["end_sample"], r["rhythm"]) for r in spans.rhythm_spans(rows).collect())
    assert got == [(0, 200, "NSR"), (200, 300, "AFib"), (400, 500, "AFlutter"), (500, 900, "NSR")]
    assert spark.range(1).select(rhythm_of(F.lit("(B"))).first()[0] is None


def test_beat_path_uses_the_raw_predecessor(spark):
    rows = spark.createDataFrame([("p", s, 1) for s in (0, 250, 2_000, 2_250)], "patient_id string, sample long, code int")
    got = [(r["sample"], r["rr"], r["hrv"]) for r in beat_features(rows, 250.0).orderBy("sample").collect()]
    assert [(s, x) for s, x, _ in got] == [(250, 1.0), (2_250, 1.0)] and got[0][2] == 0.0


def test_theta_join_equals_cut_spans(spark):
    s = spark.createDataFrame([("p", 0, 40_000, "NSR"), ("p", 40_000, 50_001, "AFib")], "patient_id string, start_sample long, end_sample long, rhythm string")
    grid = windows.grid(spark.createDataFrame([("p", 60_000)], "patient_id string, length long"), W)
    cut = {r["wid"]: (r["frac_nsr"], r["frac_afib"]) for r in windows.overlaps(s, W).collect()}
    theta = {(r["wid"], r["rhythm"]): r["covered"] for r in windows.overlaps_theta(s, grid).collect()}
    assert all(theta.get((w, "NSR"), 0) == a and theta.get((w, "AFib"), 0) == b for w, (a, b) in cut.items())


def test_class_table_keeps_empty_classes(spark):
    rows = spark.createDataFrame([("p", 0), ("q", 0)], "patient_id string, label_id int")
    got = {r["label"]: (r["windows"], r["patients"], r["share"]) for r in quality.class_table(rows, 60).collect()}
    assert got == {"NSR": (2, 2, 1.0), "AFib": (0, 0, 0.0), "AFlutter": (0, 0, 0.0)}


def test_folds_are_dealt_greedily(spark, monkeypatch):
    """A plain greedy dealing of single patients, and folds as even where vectors are dealt in several buckets."""
    import hashlib
    from collections import Counter

    import numpy as np

    from cardiolake.operators import cohort

    rng = np.random.default_rng(5)
    counts = {p: tuple(int(x) for x in (rng.integers(1, 4), rng.integers(0, 3) * (p % 3 == 0), rng.integers(0, 9) * (p % 7 == 0))) for p in range(150)}
    rows = spark.createDataFrame([(p, c) for p, v in counts.items() for c, n in enumerate(v) for _ in range(n)], "patient_id long, label int")
    totals, state, want = [sum(v[c] for v in counts.values()) for c in range(3)], [[0] * 3 for _ in range(5)], {}
    vectors = Counter(counts.values())
    for v in sorted(vectors, key=lambda v: (-(3 * sum(x * x for x in v) - sum(v) ** 2), [-x for x in v])):
        mine = sorted((p for p in counts if counts[p] == v), key=lambda p: hashlib.md5(str(p).encode()).hexdigest())
        whole = len(mine) // 5 * 5
        for r, p in enumerate(mine):
            if r < whole:
                want[p] = r % 5
                continue
            costs = [(sum(float(state[f][c] * v[c]) / totals[c] ** 2 for c in range(3)), sum(state[f]), f) for f in range(5)]
            want[p] = min(costs)[2]
            state[want[p]] = [a + b for a, b in zip(state[want[p]], v)]
    got = {r["patient_id"]: r["fold"] for r in cohort.group_folds(rows, 5, "patient_id", "label").collect()}
    assert got == want
    monkeypatch.setattr(cohort, "VECTORS", 5)
    split = {r["patient_id"]: r["fold"] for r in cohort.group_folds(rows, 5, "patient_id", "label").collect()}
    assert set(split) == set(counts)
    for found, most in ((got, 0.1), (split, 0.35)):
        for c in range(3):
            shares = [sum(counts[p][c] for p in counts if found[p] == f) / totals[c] * 5 for f in range(5)]
            assert max(shares) - min(shares) <= most * 5
