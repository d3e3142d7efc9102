"""Round trips of bytes, header text, filters, peaks, and the live monitor batch by batch."""

import gzip
import json
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cardiolake.functions import dsp
from cardiolake.functions.live import Alarm, rate_check
from cardiolake.operators import cohort, directory, metrics, ordered
from cardiolake.sources import headers, signals
from cardiolake.sources.annotations import SKIP, decode, encode, parse_annotations, walk, walk_files, walk_short, write_annotations
from cardiolake.streaming.monitor import monitor_stream, monitor_table, read_lines


def test_annotation_round_trip(spark):
    rows = [(0, 22, ["note"]), (18, 28, ["(N"]), (1_041, 1, []), (5_000, 5, ["odd"]), (4_990, 8, []), (200_000, 1, ["(AFIB", "even"]), (200_001, 13, [])]
    assert decode(encode(rows)) == (rows, 200_001)
    frame = parse_annotations(spark.createDataFrame([("p", bytearray(encode(rows))), ("q", None)], "patient_id string, content binary"), "content", "patient_id")
    assert [(r["sample"], r["code"], list(r["notes"])) for r in frame.orderBy("ann_idx").collect()] == rows


def test_annotation_oddities():
    word = lambda code, d: (code << 10 | d).to_bytes(2, "little")
    assert decode(word(1, 5) + word(SKIP, 0) + b"\0\0")[0] == [(5, 1, [])]
    two = word(SKIP, 0) + b"\0\0" + (300).to_bytes(2, "little") + word(SKIP, 0) + b"\0\0" + (400).to_bytes(2, "little") + word(5, 7)
    assert decode(two)[0] == [(707, 5, [])]
    assert decode(word(1, 5) + word(60, 3) + word(61, 2) + word(62, 1) + word(5, 4))[0] == [(5, 1, []), (9, 5, [])]
    assert decode(b"") == ([], 0)


def test_many_files_are_each_file(spark):
    """Files written at once, across batches and with null keys, are the files written one by one; files walked at once, the files walked one by one."""
    rng = np.random.default_rng(5)
    long = [(int(t), int(rng.choice([1, 5, 8])), ["(N", "x"][: rng.integers(0, 3)]) for t in np.cumsum(rng.integers(-20, 3_000, 400))]
    files = {("p", 1): long, ("p", 2): long[:1], ("p", None): long[5:8], (None, 1): long[:40], (None, None): long[:3], ("q", 1): [(70_000, 1, [])]}
    payloads = [encode(rows) for rows in files.values()]
    payloads += [b"", b"\0\0", payloads[0][:101], (SKIP << 10).to_bytes(2, "little") + b"\0\0", (63 << 10 | 9).to_bytes(2, "little") + b"ab", payloads[0][:-2], payloads[0] + b"\1\1", *(rng.integers(0, 256, int(rng.integers(1, 90)), dtype=np.uint8).tobytes() for _ in range(300))]
    samples, codes, counts, notes, clocks = walk_files(payloads)
    begin = 0
    for payload, n, clock in zip(payloads, counts, clocks, strict=True):
        want = walk_short(payload)
        assert (samples[begin : begin + n].tolist(), codes[begin : begin + n].tolist(), [(o - begin, t) for o, t in notes if begin <= o < begin + n], clock) == want
        alone = walk(payload)
        assert (alone[0].tolist(), alone[1].tolist(), *alone[2:]) == want
        begin += n
    rows = [(*key, s, i, c, t[0] if t else None) for key, found in files.items() for i, (s, c, t) in enumerate(sorted(found, key=lambda r: r[0]))]
    frame = spark.createDataFrame(rows, "patient_id string, segment int, sample long, ann_idx int, code int, note string").repartition(3)
    for most in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        written = write_annotations(frame, "patient_id", "segment").persist()
        got = {(r[0], r[1]): bytes(r[2]) for r in written.collect()}
        assert written.count() == len(files) and got == {key: encode([(s, c, t[:1]) for s, c, t in sorted(found, key=lambda r: r[0])]) for key, found in files.items()}
        back = parse_annotations(written, "content", "patient_id", "segment")
        assert sorted(map(str, ((*r[:3], r["sample"], r["code"], *(r["notes"] or [None])) for r in back.collect()))) == sorted(map(str, ((p, d, i, s, c, t) for p, d, s, i, c, t in rows)))
        written.unpersist()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_thousands_of_files_share_a_batch(spark):
    """A call of Python for every file (one a patient and day) took over two minutes for 45,000; this many stay in a few seconds."""
    frame = spark.range(40_000).selectExpr("id div 2 as patient_id", "1 as segment", "id % 2 * 90000 as sample", "id as ann_idx", "1 as code", "cast(null as string) as note")
    began = time.perf_counter()
    assert parse_annotations(write_annotations(frame, "patient_id", "segment"), "content", "patient_id", "segment").where("last_sample = 90000").count() == 40_000
    assert time.perf_counter() - began < 30


def test_headers_and_lists(spark, tmp_path):
    (tmp_path / "100.hea").write_text("100 2 360 650000 0:0:0 0/0/0\n100.dat 212 200 11 1024 995 -22131 0 MLII\n100.dat 212 200(0) 11 1024 1011 20052 0 V5\n# 69 M 1085 1629 x1\n# Aldomet, Inderal\n")
    r = headers.read_headers(spark, str(tmp_path / "*.hea")).first()
    assert (r["record_id"], r["nsig"], r["fs"], r["n_samples"], r["age"], r["sex"], r["meds"]) == ("100", 2, 360.0, 650_000, 69, "M", "Aldomet, Inderal")
    assert [(s["lead"], s["gain"], s["baseline"], s["adc_zero"]) for s in r["signals"]] == [("MLII", 200.0, None, 1024), ("V5", 200.0, 0, 1024)]
    (tmp_path / "poi").write_text("100 5:30 first beat\n")
    assert headers.read_points_of_interest(spark, str(tmp_path / "poi")).first()["at_sec"] == 330
    (tmp_path / "fd").write_text("100 0-60\n101 5-e\n")
    assert [(r["from_sec"], r["to_sec"]) for r in headers.read_display_intervals(spark, str(tmp_path / "fd")).orderBy("record").collect()] == [(0, 60), (5, None)]
    with gzip.open(tmp_path / "index.json.gz", "wt") as f:
        json.dump({"fs": 250, "patients": {"p1": [[1, 2, 0, 0, 10, 0, 0], [2, 0, 1, 0, 0, 5, 0]]}}, f)
    index = headers.read_label_index(spark, str(tmp_path / "index.json.gz"))
    assert index.count() == 2
    headers.write_label_index(index, str(tmp_path / "out"))
    assert sorted(map(tuple, headers.read_label_index(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, index.collect()))
    (tmp_path / "log.jsonl").write_text('{"pid": "a", "n": 1, "t": 1}\n{"pid": "a", "n": 2, "t": 2}\n{"pid": "b", "n"')
    assert [tuple(r) for r in headers.read_log(spark, str(tmp_path / "log.jsonl"), "pid string, n int, t int", ("pid",), ("t",)).collect()] == [("a", 2, 2)]


def test_packed_samples(spark):
    x = np.array([0, -1, 2047, -2048, 5, 1_000], np.int16)
    assert (signals.unpack_212(signals.pack_212(x)) == x).all()
    row = signals.decode_signals(spark.createDataFrame([("r", bytearray(signals.pack_212(x)))], "record_id string, content binary"), 2, 212, 200.0, 0.0).orderBy("channel").collect()
    assert row[0]["values"] == pytest.approx([0, 2047 / 200, 5 / 200])
    assert spark.range(1).select(signals.to_adc(F.lit(100.0))).first()[0] == 4095


def test_bandpass():
    fs, t = 360.0, np.arange(3_600) / 360.0
    b, a = dsp.bandpass_design(0.5, 40.0, fs)
    response = lambda f: abs(np.polyval(b, np.exp(2j * np.pi * f / fs)) / np.polyval(a, np.exp(2j * np.pi * f / fs)))
    assert len(b) == len(a) == 5 and response(0.5) == pytest.approx(2**-0.5, abs=1e-6) and response(40.0) == pytest.approx(2**-0.5, abs=1e-6)
    y = dsp.bandpass(np.sin(2 * np.pi * 10 * t) + 5, fs)[400:-400]
    assert np.abs(y - np.sin(2 * np.pi * 10 * t)[400:-400]).max() < 0.05
    assert np.abs(dsp.bandpass(np.sin(2 * np.pi * 0.05 * t), fs)[900:-900]).max() < 0.05


def test_peaks_and_refractory(spark):
    assert dsp.find_peaks(np.array([0, 1, 0, 3, 0, 2, 2, 2, 0]), 0.5, 1).tolist() == [1, 3, 6]
    assert dsp.find_peaks(np.array([0, 1, 0, 3, 0, 2, 0]), 0.5, 3).tolist() == [3]
    rows = spark.createDataFrame([("a", t) for t in (0, 10, 60, 100, 119, 121, None)] + [(None, t) for t in (5, 64, 65)] + [("b", 5)], "k string, t long")
    got = sorted(map(str, (tuple(r) for r in ordered.refractory(rows, "k", "t", 60).collect())))
    assert got == sorted(map(str, [("a", 0), ("a", 60), ("a", 121), (None, 5), (None, 65), ("b", 5)]))
    # the state goes on from one batch to the next
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    many = spark.range(1_000).select(F.lit("x").alias("k"), (F.col("id") * 7).alias("t"))
    assert [r["t"] for r in ordered.refractory(many, "k", "t", 50).orderBy("t").collect()] == list(range(0, 7_000, 56))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_alarm():
    alarm, seen = Alarm(), []
    for i, s in enumerate([0.95, 0.95, None, 0.95, 0.1, 0.95, 0.1, 0.1]):
        alarm.step(i * 15, s, 15)
        seen.append(alarm.on)
    assert seen == [False, False, False, True, True, True, True, False]
    late = Alarm(run=2, last_good=0)
    late.step(100, 0.95, 15)
    assert late.run == 1 and rate_check(320, 1.0, 300)[1] == "warn"


#: Sections (rhythm, seconds) of each synthetic stream.
STREAMS = {"nsr": (("nsr", 180),), "af": (("af", 180),), "nsr-af-nsr": (("nsr", 120), ("af", 180), ("nsr", 120)), "flat": (("nsr", 90), ("flat", 60), ("nsr", 90)), "noise": (("nsr", 90), ("noise", 60), ("nsr", 90))}
# Fixed value: the shape of a beat.
BEAT_SHAPE = (60, 180, 300, 180, 60)


def synthetic(kind: str, fs: int = 300, seed: int = 0) -> tuple[np.ndarray, list[int]]:
    """ADC samples of a stream and the places of its beats."""
    rng = np.random.default_rng(seed)
    values, beats = [], []
    for rhythm, seconds in STREAMS[kind]:
        n = seconds * fs
        base = np.full(n, 512.0)
        if rhythm != "flat":
            base += rng.normal(0, 1.5 if rhythm != "noise" else 60.0, n)
        if rhythm in ("nsr", "af"):
            at = 0.5
            while at * fs + len(BEAT_SHAPE) < n:
                i = int(at * fs)
                base[i : i + len(BEAT_SHAPE)] += BEAT_SHAPE
                beats.append(len(values) and sum(map(len, values)) + i + 2 or i + 2)
                at += max(0.25, rng.normal(0.85, 0.02) if rhythm == "nsr" else rng.uniform(0.40, 1.10))
        values.append(base)
    return np.clip(np.rint(np.concatenate(values)), 0, 4095).astype(int), beats


def stream_lines(spark, kinds, fs=300):
    """device_id, seq, line of synthetic streams."""
    frames = [pd.DataFrame({"device_id": kind, "seq": range(len(values)), "line": [str(v) for v in values]}) for kind in kinds for values, _ in [synthetic(kind, fs)]]
    return spark.createDataFrame(pd.concat(frames)).repartition(len(kinds), "device_id")


def test_stream_equals_table(spark, tmp_path):
    lines = stream_lines(spark, ["nsr", "nsr-af-nsr"]).where("seq < 60000").persist()
    want = sorted(map(str, monitor_table(lines, 300.0).collect()))
    for files in (1, 3):
        path = f"{tmp_path}/{files}"
        for i in range(files):  # one after the other, as a device would write them
            lines.where(f"seq >= {60_000 * i // files} and seq < {60_000 * (i + 1) // files}").coalesce(1).write.mode("append").parquet(f"{path}/in")
        rows = monitor_stream(read_lines(spark, f"{path}/in", 1), 300.0)
        rows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
        assert sorted(map(str, spark.read.parquet(f"{path}/out").collect())) == want
    table = monitor_table(lines, 300.0).where("kind = 'rhythm'")
    assert table.where("device_id = 'nsr' and alarm").count() == 0
    assert table.where("device_id = 'nsr-af-nsr' and alarm").count() > 0


def test_st_t_and_quality(spark):
    notes = [(5, "(ST0+"), (100, "AST0+250"), (400, "ST0+)"), (500, "(T1--"), (700, "AT1-30"), (900, "x")]
    rows = spark.createDataFrame([("r", s, i, n, 1_000) for i, (s, n) in enumerate(notes)], "record_id string, sample long, ann_idx int, note string, record_end long")
    got = {(r["type"], r["signal"], r["sign"]): (r["episodes"], r["seconds"], r["extreme"]) for r in directory.st_t_summary(rows, ("record_id",), ("sample", "ann_idx"), 100.0).collect()}
    assert got == {("ST", 0, "+"): (1, 3.95, 250), ("T", 1, "--"): (1, 5.0, 30)}
    states = spark.createDataFrame([(0,), (1,), (0x11,), (3,), (0xFF,)], "c int").select(directory.quality_state(F.col("c"))).collect()
    assert [s[0] for s in states] == ["clean", "signal 0 noisy", "signal 0 unreadable", "all noisy", "all unreadable"]
    assert spark.range(1).select(directory.clock(F.lit(89.6))).first()[0] == "1:30"


def test_splits_and_metrics(spark):
    rows = spark.range(400).select((F.col("id") % 40).alias("patient_id"), "id", (F.col("id") % 3).cast("int").alias("label"))
    split = cohort.group_split(rows, 0.2, "patient_id")
    assert split.where("fold = 'test'").select("patient_id").distinct().count() == 8 and cohort.leaks(split, "patient_id").count() == 0
    folds = cohort.group_folds(rows, 5, "patient_id", "label")
    assert folds.count() == 40 and max(r["count"] for r in folds.groupBy("fold").count().collect()) <= 10
    assert cohort.capped(rows, 3, "patient_id", "id").count() == 120
    scores = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.1)], "y int, s double")
    assert metrics.roc_auc(scores, "y", "s").first()["auc"] == pytest.approx(0.625)
