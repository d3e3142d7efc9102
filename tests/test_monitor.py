"""The live monitor on devices of `events`: a stream in any batches, restarts included, equals one pass over the table."""

import pytest
from pyspark.sql import functions as F

from cardiolake.functions.live import Monitor, push, push_all
from cardiolake.plans.queries import LIVE_FS, event_lines, stream_live_replay
from cardiolake.streaming.monitor import monitor_stream, monitor_table, read_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines(spark):
    return event_lines(spark, SF).persist()


@pytest.fixture(scope="module")
def want(lines):
    return sorted(map(str, monitor_table(lines, LIVE_FS).collect()))


def run(spark, path):
    rows = monitor_stream(read_lines(spark, f"{path}/in", 1), LIVE_FS)
    rows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


@pytest.mark.parametrize("batches", [1, 3, 10])
def test_batches_and_restarts_change_nothing(spark, tmp_path, lines, want, batches):
    most = lines.agg(F.max("seq")).first()[0] + 1
    for i in range(batches):
        lines.where((F.col("seq") * batches / most >= i) & (F.col("seq") * batches / most < i + 1)).repartition(1, "line").write.mode("append").parquet(f"{tmp_path}/in")
        if batches == 3:  # a new query goes on from the stored state each time
            run(spark, tmp_path)
    run(spark, tmp_path)
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect())) == want
    assert len(want) > 500 and any("alert" in r for r in want) and any("leadoff" in r for r in want)


def test_query(spark, want):
    assert stream_live_replay(spark, SF).count() == sum("kind='beat'" not in r for r in want)


def test_blocks_are_their_lines(lines):
    device = lines.orderBy("device_id", "seq").limit(60).collect()
    device = [r["line"] for r in device if r["device_id"] == device[0]["device_id"]]
    one, other = Monitor(), Monitor()
    apart = [row for block in device for x in block.split("\n") for row in push(one, x, LIVE_FS)]
    assert apart == push_all(other, [(b, None) for b in device], LIVE_FS) and one == other
    assert push(other, "12\n!\nx\n13", LIVE_FS) == [] and other.leadoff[-1] == one.clock + 1 and other.clock == one.clock + 2


def test_chunks_cost_a_product_each():
    """A chunk is filtered by one matrix, within rounding of the plain filter and several times as fast."""
    import time

    import numpy as np

    from cardiolake.functions.dsp import bandpass, bandpass_whole

    x = np.random.default_rng(0).normal(512, 90, (200, 500))
    seconds = []
    for f in (bandpass, bandpass_whole):
        f(x[0], 100.0)
        began = time.perf_counter()
        found = [f(row, 100.0) for row in x]
        seconds.append(time.perf_counter() - began)
        assert np.allclose(found, [bandpass(row, 100.0) for row in x], rtol=0, atol=1e-8)
    assert seconds[1] < seconds[0] / 2
    assert len(bandpass_whole(x[0][:0], 100.0)) == 0 and (bandpass_whole(x[0][:9], 100.0) == x[0][:9]).all()


def test_a_batch_of_a_device_reads_and_writes_its_state_once(lines):
    """State travels between worker and store one call at a time, so a batch takes one read and one write, whatever is kept; only the asked kinds are made into rows."""
    from cardiolake.streaming.monitor import DeviceMonitor

    class Store:
        value, calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

    class Handle:
        def getValueState(self, name, schema):
            return store

    rows = lines.collect()
    first = min(r["device_id"] for r in rows)
    rows = sorted((r for r in rows if r["device_id"] == first), key=lambda r: r["seq"])
    found = {}
    for kinds in (None, ("rhythm", "alert", "error")):
        for size in (len(rows), 7):
            store = Store()
            monitor = DeviceMonitor(LIVE_FS, kinds)
            monitor.init(Handle())
            batches = [rows[i : i + size] for i in range(0, len(rows), size)]
            found[kinds, size] = [r for own in batches for r in monitor.handleInputRows((first,), iter(own[::-1]), None)]
            assert store.calls == 2 * len(batches)
        assert found[kinds, 7] == found[kinds, len(rows)]
    assert found[kinds, 7] == [r for r in found[None, 7] if r["kind"] != "beat"] and len(found[None, 7]) > len(found[kinds, 7]) > 0


def test_lines_that_fail_together_are_pushed_one_by_one():
    beat = "\n".join(["512"] * 30 + ["900"] + ["512"] * 44)
    lines = [(x, None) for x in [beat] * 30 + ["!", "x", "", "7\n", None] + [beat] * 90 + ["9" * 400, beat]]

    def broken(features):
        raise ValueError("no model")

    for score in (lambda f: 0.95, broken):
        one, other, rows = Monitor(), Monitor(), []
        for line in lines:
            rows += push_all(one, [line], 100.0, score)
        assert push_all(other, lines, 100.0, score) == rows and one == other
        assert {r["kind"] for r in rows} >= {"error", "beat"} and any(r["kind"] == "rhythm" for r in rows)


def test_blocks_of_samples_are_read_at_once():
    from cardiolake.functions.live import block_samples

    for lines in (["512", "900", "007"], ["1", "22", "333"], ["1", "2"], ["123456789012345", "000000000000001"], ["1" * 30, "2"], ["12", "3456", "1"]):
        assert block_samples("\n".join(lines)).tolist() == [float(int(x)) for x in lines]
    for block in ("\n12", "12\n", "1\n\n2", "12\n!1", "\n", "1\n\u0662", "12\n1-2"):
        assert block_samples(block) is None


def test_event_lines_are_their_beats(lines):
    """Ten samples of a beat, then the base line, as long as the gap; texts are cut from one, so no sample is an element of an array in the plan."""
    for r in lines.where("line <> '!'").limit(200).collect():
        x = list(map(int, r["line"].split("\n")))
        starts = [i for i in range(len(x)) if x[i : i + 3] == [512, 602, 692]]
        gaps = [b - a for a, b in zip(starts, [*starts[1:], len(x)], strict=True)]
        assert len(gaps) == 3 and x == [512 + 90 * t if t < 5 else 512 + 90 * (10 - t) if t < 10 else 512 + t % 3 for g in gaps for t in range(g)]
    assert "lambdafunction" not in event_lines(lines.sparkSession, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("cuts", [(1, 1), (7, 1), (50, 4)])
def test_filter_of_a_stream_is_one_pass(spark, tmp_path, cuts):
    import numpy as np

    from cardiolake.functions.dsp import bandpass_design, run_filter
    from cardiolake.streaming.filters import filter_stream

    rng = np.random.default_rng(cuts[0])
    b, a = bandpass_design(0.5, 40.0, 100.0)
    signals = {d: rng.normal(size=n) for d, n in (("a", 700), ("b", 64), ("c", 1))}
    blocks = [(d, i, part.tolist()) for d, x in signals.items() for i, part in enumerate(np.array_split(x, cuts[0]))] + [("e", 0, None)]
    frame = spark.createDataFrame(blocks, "device_id string, seq long, samples array<double>")
    for i in range(cuts[1]):
        frame.where(f"seq >= {cuts[0] * i // cuts[1]} and seq < {cuts[0] * (i + 1) // cuts[1]}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows = filter_stream(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"), 100.0)
        rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").toPandas().sort_values("seq")
    for d, x in signals.items():
        z, y = np.zeros(4), []
        for v in x:  # the definition, sample by sample
            y.append(b[0] * v + z[0])
            z = np.append(z[1:], 0) + b[1:] * v - a[1:] * y[-1]
        assert np.allclose(np.concatenate([np.asarray(p, float) for p in got[got["device_id"] == d]["filtered"]]), y, atol=1e-10)
    assert len(got[got["device_id"] == "e"]["filtered"].iloc[0]) == 0


def test_late_rows_are_left_out(spark, tmp_path):
    """Windows of 60 s every 15 s: rows behind the watermark change nothing, late ones before it count."""
    from cardiolake.streaming.monitor import windowed_counts

    batches = [[("12:10:05", 1.0), ("12:10:20", 3.0), ("13:00:00", 9.0)], [("12:10:30", 50.0), ("12:55:10", 5.0)], [("15:00:00", 0.0)], [("15:00:01", 0.0)]]
    for number, rows in enumerate(batches):
        frame = spark.createDataFrame([("d", t, v) for t, v in rows], "device_id string, t string, value double").selectExpr("device_id", "timestamp(concat('2024-01-01 ', t)) as ts", "value")
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = windowed_counts(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"))
        flat = out.selectExpr("date_format(window.start, 'HH:mm:ss') as start", "device_id", "n", "mean")
        flat.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {r["start"]: (r["n"], r["mean"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got["12:10:00"] == (2, 2.0) and got["12:09:30"] == (2, 2.0) and got["12:09:15"] == (1, 1.0) and got["12:10:15"] == (1, 3.0)
    assert got["12:55:00"] == (1, 5.0) and "15:00:00" not in got
