"""The device source: restarts in mid-file and in mid-line lose and double nothing."""

import random

from pyspark.sql import functions as F

from cardiolake.functions.live import Monitor, push_all
from cardiolake.plans.queries import LIVE_FS, event_lines
from cardiolake.sources import devices
from cardiolake.streaming.monitor import monitor_stream

SF = "/root/testdata/sf0.001"


def run(rows, path):
    rows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def test_growing_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(devices, "SPAN", 5_000)
    monkeypatch.setattr(devices, "STEP", 64)
    rng = random.Random(1)
    (tmp_path / "in").mkdir()
    texts = {d: "".join(f"{rng.randrange(10 ** rng.randrange(1, 90))}{rng.choice(('', chr(13)))}\n" for _ in range(400)) + "torn" for d in "abc"}
    cuts = {d: sorted(rng.sample(range(len(t)), 3)) + [len(t)] for d, t in texts.items()}
    for k in range(4):
        for d, t in texts.items():
            if d != "c" or k > 1:  # a device that appears later
                (tmp_path / "in" / f"{d}.lines").write_bytes(t[: cuts[d][k]].encode())
        run(devices.read_devices(spark, str(tmp_path / "in")), tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("device_id", "seq").collect()
    for d, t in texts.items():
        own = [r for r in got if r["device_id"] == d]
        assert [r["line"] for r in own] == [x.rstrip("\r") for x in t.split("\n")[:-1]]
        assert all(t[r["seq"] :].startswith(r["line"]) for r in own) and len({r["seq"] for r in own}) == len(own)


def test_monitor_on_devices(spark, tmp_path):
    (tmp_path / "in").mkdir()
    few = event_lines(spark, SF).where(F.col("device_id").cast("int") % 5 == 0).orderBy("device_id", "seq").collect()
    lines = {}
    for r in few:
        lines.setdefault(r["device_id"], []).extend(r["line"].split("\n"))
    for share in (0.4, 1.0):
        for d, own in lines.items():
            text = "".join(f"{x}\n" for x in own)
            (tmp_path / "in" / f"{d}.lines").write_text(text[: int(len(text) * share)])
        run(monitor_stream(devices.read_devices(spark, str(tmp_path / "in")), LIVE_FS), tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("device_id").count().collect()
    want = {d: len(push_all(Monitor(), [(x, None) for x in own], LIVE_FS)) for d, own in lines.items()}
    assert {r["device_id"]: r["count"] for r in got} == {d: n for d, n in want.items() if n} and want
