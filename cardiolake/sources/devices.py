"""Devices that write lines into growing files, as a streaming source with offsets of its own.

`read_devices(spark, folder)`: each file `<device>.lines` is a device's output. An offset is the number of bytes taken of
every file, up to the last line that is whole; a restart goes on there, in the middle of a file, and a torn line waits for
its rest. Rows: device_id, seq (the place of the line's first byte: in order, and the same in every run), line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "device_id string, seq long, line string"
ENDING = ".lines"
#: Bytes that are looked through at once for the last whole line; bytes of one partition.
STEP, SPAN = 65_536, 8_000_000


@dataclass
class Stretch(InputPartition):
    """Whole lines of one file, from byte to byte."""

    folder: str
    device: str
    start: int
    stop: int


class DeviceSource(DataSource):
    """Format `devices`. Option: path (a folder that driver and executors reach)."""

    @classmethod
    def name(cls) -> str:
        return "devices"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DeviceReader:
        return DeviceReader(self.options["path"])


class DeviceReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Bytes of each device's file up to its last line end."""
        store, folder = stores.FileSystem.from_uri(self.path)
        files = [i for i in store.get_file_info(stores.FileSelector(folder)) if i.base_name.endswith(ENDING)]
        return {i.base_name.removesuffix(ENDING): whole for i in sorted(files, key=lambda i: i.base_name) if (whole := _whole(store, i.path, i.size))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        store, folder = stores.FileSystem.from_uri(self.path)
        out = []
        for device, stop in end.items():
            at = start.get(device, 0)
            while at < stop:
                # a long stretch is cut behind a line
                cut = stop if stop - at <= SPAN else (_whole(store, f"{folder}/{device}{ENDING}", at + SPAN, at) or stop)
                out.append(Stretch(self.path, device, at, cut))
                at = cut
        return out

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        store, folder = stores.FileSystem.from_uri(part.folder)
        with store.open_input_file(f"{folder}/{part.device}{ENDING}") as file:
            file.seek(part.start)
            raw = file.read(part.stop - part.start)
        lines = raw.split(b"\n")[:-1]
        places, at = [], part.start
        for line in lines:
            places.append(at)
            at += len(line) + 1
        texts = [line.rstrip(b"\r").decode("utf-8", "replace") for line in lines]
        yield pa.RecordBatch.from_arrays([pa.array([part.device] * len(lines), pa.string()), pa.array(places, pa.int64()), pa.array(texts, pa.string())], names=["device_id", "seq", "line"])

    def commit(self, end: dict) -> None:
        pass


def _whole(store: stores.FileSystem, path: str, size: int, least: int = 0) -> int:
    """The place behind the last line end before `size`, looked for backwards to `least`; 0 without one."""
    with store.open_input_file(path) as file:
        stop = size
        while stop > least:
            begin = max(least, stop - STEP)
            file.seek(begin)
            found = file.read(stop - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            stop = begin
    return 0


def read_devices(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the devices' lines."""
    spark.dataSource.register(DeviceSource)
    return spark.readStream.format("devices").load(folder)
