"""A causal bandpass over streams of samples: the filter's state goes on from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cardiolake.functions.dsp import bandpass_design, run_filter
from cardiolake.streaming.monitor import use_typed_state

ROWS = "device_id string, seq long, filtered array<double>"


class CausalFilter(StatefulProcessor):
    """The filter of one device, started from rest; what it keeps is one number for each pole."""

    def __init__(self, fs: float, low: float, high: float):
        self.b, self.a = bandpass_design(low, high, fs)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("poles", "z array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        z = np.array(self.kept.get()[0], float) if self.kept.exists() else np.zeros(len(self.a) - 1)
        blocks = pd.concat(list(rows)).sort_values("seq")
        sizes = np.array([len(x) for x in blocks["samples"]], dtype=np.int64)
        y, z = run_filter(self.b, self.a, np.concatenate([np.asarray(x, float) for x in blocks["samples"]]), z)
        self.kept.update((z.tolist(),))
        yield pd.DataFrame({"device_id": key[0], "seq": blocks["seq"].to_numpy(), "filtered": [part.tolist() for part in np.split(y, np.cumsum(sizes)[:-1])]})

    def close(self) -> None:
        pass


def filter_stream(blocks: DataFrame, fs: float, low: float = 0.5, high: float = 40.0) -> DataFrame:
    """device_id, seq, filtered: blocks of samples (device_id, seq, samples) through the causal filter.

    Blocks of a batch are put in order by seq, batches follow each other; however a signal is cut into blocks and
    batches, its values are those of one pass. Blocks without samples (null or empty) come back as they are.
    """
    use_typed_state(blocks.sparkSession)
    whole = blocks.select("device_id", "seq", F.coalesce("samples", F.array().cast("array<double>")).alias("samples"))
    return whole.groupBy("device_id").transformWithStateInPandas(CausalFilter(fs, low, high), ROWS, "append", "none")
