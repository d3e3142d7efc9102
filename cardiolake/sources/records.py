"""Recordings as a data source: headers say how the waveform files are decoded, and blocks of samples are read apart.

`read_records(spark, folder)`: a folder of .hea and .dat files, local or in a store that pyarrow reaches (file:, hdfs:, s3:).
Rows: record_id, lead, channel, start (first sample), fs, values (physical units).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from cardiolake.sources.signals import unpack_212

SCHEMA = "record_id string, lead string, channel int, start long, fs double, values array<double>"
#: Samples of a channel in a block. Even, so that packed pairs stay whole.
BLOCK = 65_536
# Units a millivolt where a header names none, and bytes of a sample by format.
DEFAULT_GAIN, WIDTHS = 200.0, {212: 1.5, 16: 2.0}
#: Tests that can leave partitions out.
TESTS = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v}
COLUMNS = ("record_id", "start", "channel", "lead")


@dataclass
class Lead:
    file: str
    fmt: int
    gain: float
    baseline: int
    name: str


@dataclass
class Header:
    record: str
    fs: float
    samples: int | None
    leads: list[Lead]


def parse_header(text: str) -> Header:
    """Record line and signal lines; a gain of 0 or none is the default, a baseline of none is the ADC zero."""
    lines = [x.strip() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    first = lines[0].split()
    leads = []
    for line in lines[1 : 1 + int(first[1])]:
        parts = line.split(None, 8)
        gain = re.match(r"([0-9.]+)?(?:\((-?\d+)\))?", parts[2] if len(parts) > 2 else "")
        zero = int(parts[4]) if len(parts) > 4 else 0
        leads.append(Lead(parts[0], int(re.match(r"\d+", parts[1]).group()), float(gain.group(1) or 0) or DEFAULT_GAIN, int(gain.group(2)) if gain.group(2) else zero, parts[8].strip() if len(parts) > 8 else ""))
    return Header(first[0].split("/")[0], float(re.match(r"[0-9.]+", first[2]).group()) if len(first) > 2 else 250.0, int(first[3]) if len(first) > 3 else None, leads)


@dataclass
class BlockOf(InputPartition):
    """One block of one file's samples, with the leads that are wanted of it."""

    path: str
    header: Header
    file: str
    start: int
    stop: int


class RecordSource(DataSource):
    """Format `records`. Options: path (a folder), block (samples a partition)."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options["path"], int(self.options.get("block", BLOCK)))


class RecordReader(DataSourceReader):
    """Partitions by record, file and block of samples; filters on record, channel, lead and start leave partitions out."""

    def __init__(self, path: str, block: int):
        self.path, self.block = path, block + block % 2
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes tests of one of COLUMNS against values; all others stay with Spark."""
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in COLUMNS and f.value is not None:
                self.tests.append(f)
            else:
                yield f

    def _passes(self, **known) -> bool:
        """Whether no test of what is known fails."""
        return all(TESTS[type(f)](known[f.attribute[0]], f.value) for f in self.tests if f.attribute[0] in known)

    def partitions(self) -> list[InputPartition]:
        out = []
        store, folder = stores.FileSystem.from_uri(self.path)
        sizes = {i.base_name: i.size for i in store.get_file_info(stores.FileSelector(folder))}
        for name in sorted(n for n in sizes if n.endswith(".hea")):
            with store.open_input_file(f"{folder}/{name}") as file:
                header = parse_header(file.read().decode("latin-1"))
            if not self._passes(record_id=header.record):
                continue
            for file_name in dict.fromkeys(lead.file for lead in header.leads):
                leads = [(i, lead) for i, lead in enumerate(header.leads) if lead.file == file_name]
                if leads[0][1].fmt not in WIDTHS:
                    raise ValueError(f"format {leads[0][1].fmt} of {name} is unknown")
                if not any(self._passes(channel=i, lead=lead.name) for i, lead in leads):
                    continue
                held = int(sizes[file_name] / WIDTHS[leads[0][1].fmt]) // len(leads)
                total = held if header.samples is None else min(header.samples, held)
                out += [BlockOf(self.path, header, file_name, start, min(start + self.block, total)) for start in range(0, total, self.block) if self._passes(start=start)]
        return out

    def read(self, part: BlockOf | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # without any partition, Spark asks for none
            return
        leads = [(i, lead) for i, lead in enumerate(part.header.leads) if lead.file == part.file]
        width = WIDTHS[leads[0][1].fmt] * len(leads)
        store, folder = stores.FileSystem.from_uri(part.path)
        with store.open_input_file(f"{folder}/{part.file}") as file:
            file.seek(int(part.start * width))
            raw = file.read(int(np.ceil((part.stop - part.start) * width)))
        flat = unpack_212(raw) if leads[0][1].fmt == 212 else np.frombuffer(raw[: len(raw) // 2 * 2], "<i2")
        table = flat[: (part.stop - part.start) * len(leads)].reshape(-1, len(leads))
        wanted = [(place, i, lead) for place, (i, lead) in enumerate(leads) if self._passes(channel=i, lead=lead.name)]
        values = [(table[:, place] - float(lead.baseline)) / lead.gain for place, _, lead in wanted]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0)))
        n = len(wanted)
        yield pa.RecordBatch.from_arrays([pa.array([part.header.record] * n, pa.string()), pa.array([lead.name for _, _, lead in wanted], pa.string()), pa.array([i for _, i, _ in wanted], pa.int32()), pa.array([part.start] * n, pa.int64()), pa.array([part.header.fs] * n, pa.float64()), lists], names=["record_id", "lead", "channel", "start", "fs", "values"])


def read_records(spark: SparkSession, folder: str, block: int = BLOCK) -> DataFrame:
    """All channels of the records in a folder, a row for each block of samples."""
    spark.dataSource.register(RecordSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("records").option("block", block).load(folder)
