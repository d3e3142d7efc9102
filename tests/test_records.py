"""The record source: round trips of both formats, blocks, and partitions that filters leave out."""

import numpy as np
import pytest

from cardiolake.sources.records import RecordReader, parse_header, read_records
from cardiolake.sources.signals import pack_212


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = np.random.default_rng(1)
    path = tmp_path_factory.mktemp("records")
    a, b = rng.integers(-2048, 2048, (501, 2)).astype(np.int16), rng.integers(-30_000, 30_000, (300, 1)).astype(np.int16)
    flat = a.ravel()
    (path / "100.dat").write_bytes(pack_212(flat))
    (path / "200.dat").write_bytes(b.astype("<i2").tobytes())
    (path / "100.hea").write_text("100 2 360 501\n100.dat 212 200 11 1024 995 -22131 0 MLII\n100.dat 212 100(5)/mV 11 1024 1011 20052 0 V5\n# 69 M\n")
    (path / "200.hea").write_text("200/3 1 250\n200.dat 16 0 16 0 0 0 0 chest lead\n")
    return path, a, b


def load(spark, path, block):
    return read_records(spark, str(path), block)


@pytest.mark.parametrize("block", [100, 64, 65_536])
def test_round_trip(spark, folder, block):
    path, a, b = folder
    got = {}
    for r in sorted(load(spark, path, block).collect(), key=lambda r: r["start"]):
        got.setdefault((r["record_id"], r["channel"], r["lead"], r["fs"]), []).extend(r["values"])
    want = {("100", 0, "MLII", 360.0): (a[:, 0] - 1024) / 200, ("100", 1, "V5", 360.0): (a[:, 1] - 5) / 100, ("200", 0, "chest lead", 250.0): b[:, 0] / 200}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_filters_leave_partitions_out(spark, folder):
    rows = load(spark, folder[0], 100)
    assert rows.rdd.getNumPartitions() == 9
    few = rows.where("record_id = '100' and start >= 400 and lead = 'V5'")
    assert few.rdd.getNumPartitions() == 2 and sorted((r["start"], r["channel"], len(r["values"])) for r in few.collect()) == [(400, 1, 100), (500, 1, 1)]
    assert rows.where("record_id in ('200') and size(values) = 100").rdd.getNumPartitions() == 3
    assert rows.where("record_id = 'none'").count() == 0


def test_headers(tmp_path):
    h = parse_header("x 1 128 10\nx.dat 212\n")
    assert (h.leads[0].gain, h.leads[0].baseline, h.leads[0].name) == (200.0, 0, "")
    (tmp_path / "y.hea").write_text("y 1 128 10\ny.dat 80 200 8 0 0 0 0 I\n")
    (tmp_path / "y.dat").write_bytes(b"123")
    with pytest.raises(ValueError):
        RecordReader(str(tmp_path), 100).partitions()
