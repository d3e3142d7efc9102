"""Archives of one patient's beats and spans (NumPy zip files), read in parallel, a faulty one reported and left out."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardiolake.schema import RHYTHM_CLASSES

SEGMENTS = "patient_id string, error string, segment int, samples array<long>, codes array<int>, starts array<long>, ends array<long>, rhythms array<string>"
NAMES = [c.split()[0] for c in SEGMENTS.split(", ")]


def segments_of(content: bytes, fs: int) -> list[tuple]:
    """segment, samples, codes, and starts, ends and rhythms of the spans of each segment.

    A segment is what has sample, code and span members; others are passed over. Rhythms go by the archive's own
    names; names other than the known ones, and another sampling rate, are errors.
    """
    with np.load(io.BytesIO(content)) as archive:
        names = [str(x) for x in archive["rhythms"]]
        if sorted(names) != sorted(RHYTHM_CLASSES):
            raise ValueError(f"unexpected rhythms {names}")
        if int(archive["fs"]) != fs:
            raise ValueError(f"fs is {int(archive['fs'])}, not {fs}")
        members = set(archive.files)
        out = []
        for number in sorted(int(m[1]) for m in map(re.compile(r"s(\d+)_samp").fullmatch, members) if m):
            parts = [f"s{number:02d}_{part}" for part in ("samp", "code", "spans")]
            if members.issuperset(parts):
                samples, codes, spans = (archive[p].astype(np.int64) for p in parts)
                spans = spans.reshape(-1, 3)
                out.append((number, samples.tolist(), codes.tolist(), spans[:, 0].tolist(), spans[:, 1].tolist(), [names[k] for k in spans[:, 2].tolist()]))
        return out


def read_archives(spark: SparkSession, glob: str, fs: int = 250) -> DataFrame:
    """A row for each segment of files such as p00001.npz, or one with `error` for a file that can't be read (cut short, other rate, other rhythms)."""
    files = spark.read.format("binaryFile").load(glob).select(F.regexp_extract("path", r"([^/]+)\.npz$", 1).alias("patient_id"), "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for patient, content in batch.itertuples(index=False, name=None):
                try:
                    rows = [(patient, None, *segment) for segment in segments_of(bytes(content), fs)]
                except Exception as fault:  # whatever a broken file raises is that patient's error alone
                    rows = [(patient, f"{type(fault).__name__}: {fault}", *[None] * 6)]
                yield pd.DataFrame(rows, columns=NAMES).astype({"segment": "Int32"})

    return files.mapInPandas(parse, SEGMENTS)


def beats_of(archives: DataFrame) -> DataFrame:
    """patient_id, segment, sample, code of each beat."""
    return archives.where("error is null").select("patient_id", "segment", F.explode(F.arrays_zip("samples", "codes")).alias("b")).select("patient_id", "segment", F.col("b.samples").alias("sample"), F.col("b.codes").alias("code"))


def spans_of(archives: DataFrame) -> DataFrame:
    """patient_id, segment, start_sample, end_sample, rhythm of each span."""
    spans = archives.where("error is null").select("patient_id", "segment", F.explode(F.arrays_zip("starts", "ends", "rhythms")).alias("s"))
    return spans.select("patient_id", "segment", F.col("s.starts").alias("start_sample"), F.col("s.ends").alias("end_sample"), F.col("s.rhythms").alias("rhythm"))


def failed(archives: DataFrame) -> DataFrame:
    """patient_id and error of each file that could not be read."""
    return archives.where("error is not null").select("patient_id", "error")
