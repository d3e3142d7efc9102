"""Archives, index files, model bundles, waveform features, the rate latch and error rows."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardiolake.functions import dsp
from cardiolake.functions.live import Monitor, push_all
from cardiolake.operators import cohort, learning, metrics, neighbours, serving, windows
from cardiolake.sources import annotations, archives, headers, sinks
from cardiolake.streaming.monitor import split_sinks


def archive(rhythms=("AFib", "NSR", "AFlutter"), fs=250, **members):
    out = io.BytesIO()
    np.savez_compressed(out, rhythms=np.array(rhythms), fs=fs, **members)
    return out.getvalue()


def test_archives(spark, tmp_path):
    whole = dict(s03_samp=np.array([10, 20]), s03_code=np.array([1, 5]), s03_spans=np.array([[0, 15, 1], [15, 30, 0]]), s07_samp=np.array([5]), s07_code=np.array([1]))
    (tmp_path / "p1.npz").write_bytes(archive(**whole))
    (tmp_path / "p2.npz").write_bytes(archive(**whole)[:200])
    (tmp_path / "p3.npz").write_bytes(archive(rhythms=("AFib", "NSR", "VT"), **whole))
    (tmp_path / "p4.npz").write_bytes(archive(fs=360, **whole))
    read = archives.read_archives(spark, f"{tmp_path}/*.npz")
    assert sorted(map(tuple, archives.beats_of(read).collect())) == [("p1", 3, 10, 1), ("p1", 3, 20, 5)]
    assert sorted(map(tuple, archives.spans_of(read).collect())) == [("p1", 3, 0, 15, "NSR"), ("p1", 3, 15, 30, "AFib")]
    errors = {r["patient_id"]: r["error"] for r in archives.failed(read).collect()}
    assert set(errors) == {"p2", "p3", "p4"} and "BadZipFile" in errors["p2"] and "VT" in errors["p3"] and "360" in errors["p4"]


def test_index_of_many_patients_survives(spark, tmp_path):
    index = spark.range(30_000).select(F.format_string("p%05d", (F.col("id") / 3).cast("int")).alias("patient_id"), (F.col("id") % 3).alias("segment"), *[(F.col("id") * k).alias(n) for k, n in enumerate(("nsr_n", "afib_n", "afl_n", "nsr_samp", "afib_samp", "afl_samp"))])
    headers.write_label_index(index, f"{tmp_path}/index")
    back = headers.read_label_index(spark, f"{tmp_path}/index")
    assert back.count() == 30_000 and back.exceptAll(index).count() == 0
    (tmp_path / "pretty.json").write_text('{"fs": 250,\n "patients": {"p1": [[1, 2, 3, 4, 5, 6, 7]],\n  "p2": [[2, 2, 3, 4, 5, 6, 7]]}}')
    assert headers.read_label_index(spark, f"{tmp_path}/pretty.json", pretty=True).count() == 2


def test_missing_files_are_rows(spark):
    expected = spark.createDataFrame([("p1", 0), ("p1", 1), ("p2", 0)], "patient_id string, segment int")
    found = spark.createDataFrame([("p1", 0, 5), ("p1", 0, 9)], "patient_id string, segment int, sample int")
    assert sorted(map(tuple, annotations.missing_files(expected, found, "patient_id", "segment").collect())) == [("p1", 0, "read"), ("p1", 1, "Missing"), ("p2", 0, "Missing")]


def test_long_reports_are_an_error(spark, tmp_path):
    sinks.write_summary({"few": spark.range(5)}, f"{tmp_path}/s", most_rows=5)
    with pytest.raises(ValueError, match="more than 4 rows"):
        sinks.write_summary({"few": spark.range(5)}, f"{tmp_path}/s", most_rows=4)


def test_windows_beyond_the_count_are_an_error(spark):
    lengths = spark.createDataFrame([("a", 65_534 * 10), ("b", 9)], "patient_id string, length long")
    assert windows.grid(lengths, 10).count() == 65_534
    with pytest.raises(Exception, match="more than the window number"):
        windows.grid(spark.createDataFrame([("a", 65_535 * 10)], "patient_id string, length long"), 10).count()
    with pytest.raises(ValueError, match="overlap"):
        windows.grid(lengths, 10, 5)


def test_filter_in_blocks_is_the_filter():
    rng = np.random.default_rng(3)
    b, a = dsp.bandpass_design(0.5, 40.0, 360.0)
    for n in (0, 1, 63, 64, 65, 1_000):
        x, z = rng.normal(size=n), rng.normal(size=4)
        want, state = np.empty(n), z.copy()
        for i, v in enumerate(x):
            want[i] = b[0] * v + state[0]
            state = np.append(state[1:], 0) + b[1:] * v - a[1:] * want[i]
        got, left = dsp.run_filter(b, a, x, z)
        assert got == pytest.approx(want, rel=1e-9, abs=1e-7) and left == pytest.approx(state, rel=1e-9, abs=1e-7)


def test_waveform_features(spark):
    rng = np.random.default_rng(5)
    signals = {f"r{k}": rng.normal(size=400).tolist() for k in range(3)}
    beats = [(r, int(p)) for r in signals for p in rng.integers(0, 420, 12)]
    got = serving.waveform_features(spark.createDataFrame(beats, "record_id string, sample long"), spark.createDataFrame(list(signals.items()), "record_id string, signal array<double>"), 100.0).collect()
    assert len(got) == len(set(beats))
    for r in got:
        y, p = dsp.bandpass(np.array(signals[r["record_id"]]), 100.0), r["sample"]
        amplitude = y[p] if p < len(y) else 0.0
        over = [i for i, v in enumerate(y[max(0, p - 10) : p + 10]) if abs(v) > abs(amplitude * 0.5)]
        width = (over[-1] - over[0]) / 100.0 if amplitude and len(over) > 1 else 0.0
        assert r["amplitude"] == pytest.approx(amplitude) and r["qrs_width"] == pytest.approx(width)


def test_markers_snap_to_the_highest_place_near_them(spark):
    trace = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([0, 5, 1, 9, 9, 2, 0, 0])], "record_id string, pos long, x double")
    markers = spark.createDataFrame([("a", 2), ("a", 0), ("a", 7), ("a", 99)], "record_id string, pos long")
    got = {r["pos"]: (r["shown"], r["shown_value"]) for r in serving.snap_to_peak(markers, trace, 2).collect()}
    assert got == {2: (3, 9.0), 0: (1, 5.0), 7: (5, 2.0)}


def test_rate_latch_and_error_rows():
    slow = [("500", i / 200.0) for i in range(40_000)]
    state = Monitor()
    rows = push_all(state, slow, 300.0)
    assert [r["status"] for r in rows if r["kind"] == "alert" and r["status"].startswith("fs")] == ["fs_fatal"] and state.fs_fatal
    assert not [r for r in rows if r["kind"] == "rhythm" and r["sample_pos"] > 18_300]
    right = Monitor()
    assert not [r for r in push_all(right, [("500", i / 300.0) for i in range(40_000)], 300.0) if r["kind"] == "alert"] and not right.fs_fatal
    warned = push_all(Monitor(), [("500", i / 325.0) for i in range(60_000)], 300.0)
    assert [r["status"] for r in warned if r["kind"] == "alert"] == ["fs_warn"]

    def broken(features):
        raise RuntimeError("no model")

    rng = np.random.default_rng(1)
    beat = [(str(int(500 + 400 * (i % 240 < 6) + rng.integers(0, 5))), None) for i in range(30_000)]
    rows = push_all(Monitor(), beat, 300.0, broken)
    assert [r for r in rows if r["kind"] == "error" and "no model" in r["status"]] and [r for r in rows if r["kind"] == "beat"]


def test_sink_batches_replace_themselves(spark, tmp_path):
    rows = spark.createDataFrame([("d", "beat"), ("d", "rhythm")], "device_id string, kind string")
    rows.write.parquet(f"{tmp_path}/in")
    for k in range(2):  # a new checkpoint runs the same batch again
        split_sinks(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state{k}").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_bundle_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(float(x), float(y), "AFib" if x + y > 0 else "NSR") for x, y in rng.normal(size=(300, 2))], "x double, y double, label string")
    results = learning.compare(rows, rows, ["logistic", "tree"], ["x", "y"], "label")
    fitted = learning.refit_best(results, rows, ["x", "y"], "label", f"{tmp_path}/m")
    loaded, about = learning.load_bundle(spark, f"{tmp_path}/m", ["x", "y"])
    assert about["labels"] == ["AFib", "NSR"] and about["model"] == results[0]["model"]
    assert learning.predict(loaded, rows).select("predicted").collect() == learning.predict(fitted, rows).select("predicted").collect()
    with pytest.raises(ValueError, match="fitted on"):
        learning.load_bundle(spark, f"{tmp_path}/m", ["y", "x"])


def test_shares_and_areas_without_one_large_task(spark):
    rows = spark.range(5_000).select("id", (F.col("id") % 7).alias("label"))
    split = cohort.stratified_split(rows, 0.3, "label", "id").collect()
    by_hash = sorted((r["id"] for r in split), key=lambda i: __import__("hashlib").md5(str(i).encode()).hexdigest())
    for k in range(7):
        own = [i for i in by_hash if i % 7 == k]
        assert {r["id"] for r in split if r["label"] == k and r["fold"] == "test"} == set(own[: -(-len(own) * 3 // 10)])
    rng = np.random.default_rng(4)
    y, s = rng.integers(0, 2, 4_000), np.round(rng.normal(size=4_000), 3)
    got = metrics.roc_auc(spark.createDataFrame(list(zip(y.tolist(), (s + y).tolist())), "y int, s double"), "y", "s").first()
    one, zero = (s + y)[y == 1], np.sort((s + y)[y == 0])
    area = (np.searchsorted(zero, one) + np.searchsorted(zero, one, side="right")).sum() / 2 / len(one) / len(zero)
    assert got["auc"] == pytest.approx(area)


def test_neighbours_in_blocks(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=3)], i % 3) for i in range(120)], "id long, v array<double>, label int")
    whole, parts = (sorted(map(tuple, neighbours.nearest(rows, rows, 5, block=b).collect())) for b in (1_000, 25))
    assert whole == parts and len(whole) == 120


def test_fold_preview(spark):
    rows = spark.range(400).select((F.col("id") % 40).alias("patient_id"), (F.col("id") % 3).cast("int").alias("label"))
    got = cohort.fold_preview(rows, 5, "patient_id", "label", [0, 1, 2]).collect()
    assert len(got) == 5 and all(r["test_rows"] + r["train_rows"] == 400 and r["n_0"] + r["n_1"] + r["n_2"] == r["test_rows"] for r in got)
    assert sum(r["test_patients"] for r in got) == 40 and cohort.fold_preview(rows, 41, "patient_id", "label", [0]) is None
