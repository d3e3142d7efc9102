"""Waveforms: packed 12-bit and 16-bit samples to arrays, physical units and ADC units."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpack_212(payload: bytes) -> np.ndarray:
    """Pairs of signed 12-bit samples from triples of bytes; an odd last sample takes two bytes."""
    raw = np.frombuffer(payload, np.uint8).astype(np.int16)
    n = len(raw) // 3
    a, b, c = raw[: 3 * n : 3], raw[1 : 3 * n : 3], raw[2 : 3 * n : 3]
    out = np.empty(2 * n, np.int16)
    out[0::2], out[1::2] = a | (b & 0x0F) << 8, c | (b & 0xF0) << 4
    if len(raw) - 3 * n == 2:
        out = np.append(out, raw[-2] | (raw[-1] & 0x0F) << 8)
    return np.where(out > 2047, out - 4096, out).astype(np.int16)


def pack_212(samples: np.ndarray) -> bytes:
    """The bytes of an even number of samples."""
    x = np.asarray(samples, np.int32) & 0xFFF
    a, b = x[0::2], x[1::2]
    return np.stack([a & 0xFF, a >> 8 | (b >> 8) << 4, b & 0xFF], 1).astype(np.uint8).tobytes()


def decode_signals(files: DataFrame, nsig: int, fmt: int, gain: float, baseline: float) -> DataFrame:
    """files (record_id, content) to a row for each channel: record_id, channel, values in physical units."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for record, content in batch.itertuples(index=False, name=None):
                flat = unpack_212(bytes(content)) if fmt == 212 else np.frombuffer(bytes(content), "<i2")
                table = flat[: len(flat) // nsig * nsig].reshape(-1, nsig)
                yield pd.DataFrame({"record_id": [record] * nsig, "channel": range(nsig), "values": [(table[:, c] - baseline) / gain for c in range(nsig)]})

    if fmt not in (212, 16):
        raise ValueError(f"format {fmt} is unknown")
    return files.select("record_id", "content").mapInPandas(walk, "record_id string, channel int, values array<double>")


def to_adc(millivolts: Column) -> Column:
    """The monitor's ADC units: 512 plus 200 a millivolt, rounded half to even, within 0 and 4095."""
    return F.least(F.greatest(F.rint(512 + 200 * millivolts), F.lit(0)), F.lit(4095)).cast("int")
