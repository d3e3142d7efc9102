"""The live monitor as a stateful stream, and the same over a table."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cardiolake.functions.live import Alarm, Monitor, push_all

LINES = "device_id string, seq long, line string"
ROWS = "device_id string, kind string, sample_pos long, status string, n_rr_used int, n_rr_rejected int, n_drr_used int, coverage double, leadoff int, mean_rr double, hr double, hrv_sdnn double, rmssd double, pnn50 double, cv_rr double, rr_entropy double, af_score double, af_run int, alarm boolean"
NAMES = [c.split()[0] for c in ROWS.split(", ")]
FOUND = Row(*NAMES)


def _rows(device: str, found: list[dict]) -> pd.DataFrame:
    table = pd.DataFrame([{"device_id": device} | r for r in found], columns=NAMES)
    for name in ("n_rr_used", "n_rr_rejected", "n_drr_used", "leadoff", "af_run"):
        table[name] = table[name].astype("Int32")
    table["alarm"] = table["alarm"].astype("boolean")
    return table


def _ordered(table: pd.DataFrame) -> Iterator[tuple]:
    """line and arrival time (None where the table has none), in order."""
    table = table.sort_values("seq")
    times = table["at"].tolist() if "at" in table else [None] * len(table)
    return zip(table["line"], (None if pd.isna(t) else t for t in times), strict=True)


def _in_order(rows: Iterator[Row]) -> Iterator[tuple]:
    """The same of single rows; one without a place comes last."""
    rows = list(rows)
    place = {name: k for k, name in enumerate(rows[0].__fields__)}
    seq, line, at = place["seq"], place["line"], place.get("at")
    for row in sorted(rows, key=lambda r: (r[seq] is None, r[seq] or 0)):
        time = None if at is None else row[at]
        yield row[line], None if time != time else time


#: What is kept of a device between batches, as one value: a read and a write a batch. Its arrays are bounded by five seconds of samples, a minute of beats and marks, and the lengths of the label and trend rings.
OF_MONITOR, OF_ALARM = (["clock", "last_rhythm", "ectopy", "fs_fatal", "fs_warned", "first_at", "next_rate_check", "beats", "leadoff", "labels", "trend"], ["run", "clear", "on", "last_good"])
KEPT = "clock long, last_rhythm long, ectopy boolean, fs_fatal boolean, fs_warned boolean, first_at double, next_rate_check long, beats array<long>, leadoff array<long>, labels array<int>, trend array<double>, run int, clear int, on boolean, last_good long, buffer array<double>"


class DeviceMonitor(StatefulProcessor):
    """Moves one device's monitor along its lines; the state is a typed value, no text."""

    def __init__(self, fs: float, kinds: tuple[str, ...] | None = None):
        self.fs, self.kinds = fs, kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("monitor", KEPT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state, known = Monitor(), self.kept.get()
        if known is not None:
            *plain, buffer = known
            for name, value in zip(OF_MONITOR, plain[: len(OF_MONITOR)], strict=True):
                setattr(state, name, value)
            state.alarm, state.buffer = Alarm(*plain[len(OF_MONITOR) :]), array("d", buffer)
        found = push_all(state, _in_order(rows), self.fs)
        self.kept.update((*(getattr(state, n) for n in OF_MONITOR), *(getattr(state.alarm, n) for n in OF_ALARM), state.buffer.tolist()))
        for row in found:
            if self.kinds is None or row["kind"] in self.kinds:
                values = map(row.get, NAMES[1:])
                yield FOUND(key[0], *(None if v != v else v for v in values))

    def close(self) -> None:
        pass


def use_typed_state(spark: SparkSession) -> None:
    """Typed state of several variables needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def monitor_stream(lines: DataFrame, fs: float, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """rhythm, beat, alert and error rows of a stream of lines, or those of some kinds; what is kept of a device between batches is typed state.

    A line may be a block of lines. A device's lines of one batch are put in order by seq and held by one worker, so a
    source's limit of a batch bounds its memory; batches must follow each other. A column `at` (arrival time in
    seconds), where there is one, brings the check of the sampling rate.
    """
    use_typed_state(lines.sparkSession)
    return lines.groupBy("device_id").transformWithState(DeviceMonitor(fs, kinds), ROWS, "append", "none")


def monitor_table(lines: DataFrame, fs: float) -> DataFrame:
    """The same rows from a finished table, one device a group."""

    def advance(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _rows(key[0], push_all(Monitor(), _ordered(rows), fs))

    return lines.groupBy("device_id").applyInPandas(advance, ROWS)


def read_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LINES)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def split_sinks(rows: DataFrame, path: str, checkpoint: str):
    """A query that writes the beat, rhythm, alert and error rows of each batch to folders of their own: batch=0/kind=beat and so on.

    A batch that is run again replaces its own folder, so every row is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "60 seconds", hop: str = "15 seconds") -> DataFrame:
    """Counts and mean by sliding event-time windows with a watermark, for approximate online features."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, hop), "device_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
