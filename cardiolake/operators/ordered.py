"""Steps whose state runs along the rows of a key in order: a sorted pass that holds a batch and one state, however many rows a key has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardiolake.functions.live import Alarm
from cardiolake.schema import ECTOPY_LAST, ECTOPY_OFF, ECTOPY_ON


def ordered_pass(rows: DataFrame, key: str, order: list[str], begin: Callable[[], object], step: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What step(state, stretch) returns for the stretches of each key's rows in order; begin() makes a key's state.

    A key's rows meet in one task, sorted there by Spark (which spills); Python sees them batch by batch. Rows of a null
    key are one key.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, state = object(), None
        for frame in frames:
            values = frame[key].astype(object).where(frame[key].notna(), None)
            heads = np.flatnonzero((values != values.shift()).to_numpy() & ~(values.isna() & values.shift().isna()).to_numpy()) if len(frame) else []
            cuts = sorted({0, *map(int, heads)}) + [len(frame)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if values.iloc[a] != known:
                    known, state = values.iloc[a], begin()
                yield step(state, frame.iloc[a:b])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def refractory(rows: DataFrame, key: str, sample: str, gap: int) -> DataFrame:
    """key and sample of the rows that lie `gap` or more behind the last one kept of their key; null samples go."""

    def step(state: list, stretch: pd.DataFrame) -> pd.DataFrame:
        samples, kept, at = stretch[sample].to_numpy(np.int64), [], 0
        while True:
            if state:
                at = int(np.searchsorted(samples, state[0] + gap))
            if at >= len(samples):
                break
            kept.append(at)
            state[:] = [int(samples[at])]
        return stretch.iloc[kept][[key, sample]]

    used = rows.where(F.col(sample).isNotNull()).select(key, F.col(sample).cast("long").alias(sample))
    return ordered_pass(used, key, [sample], list, step, used.schema.simpleString()[len("struct<") : -1])


def alarm_states(rows: DataFrame, key: str, order: list[str], hop: int, keep: list[str]) -> DataFrame:
    """key and `keep` of each row with af_run, clear_run and alarm behind it. rows: sample and score (null: none) of each evaluation."""

    def step(alarm: Alarm, stretch: pd.DataFrame) -> pd.DataFrame:
        states = []
        for at, score in zip(stretch["sample"].tolist(), stretch["score"].tolist(), strict=True):
            alarm.step(int(at), None if pd.isna(score) else float(score), hop)
            states.append((alarm.run, alarm.clear, alarm.on))
        return stretch[[key, *keep]].assign(**dict(zip(("af_run", "clear_run", "alarm"), zip(*states), strict=True)))

    own = rows.select(key, *keep).schema.simpleString()[len("struct<") : -1]
    return ordered_pass(rows, key, order, Alarm, step, f"{own},af_run int,clear_run int,alarm boolean").select(key, *keep, "af_run", "clear_run", "alarm")


class Ectopy:
    """The labels of the last beats and whether the alert is on."""

    def __init__(self) -> None:
        self.labels: list[int] = []
        self.on = False

    def step(self, abnormal: bool) -> tuple[int, bool]:
        """On from ECTOPY_ON abnormal ones of the last ECTOPY_LAST, off from ECTOPY_OFF on downwards; between them it stays."""
        self.labels = [*self.labels, int(abnormal)][-ECTOPY_LAST:]
        n = sum(self.labels)
        self.on = n > ECTOPY_OFF if self.on else n >= ECTOPY_ON
        return n, self.on


def ectopy_states(beats: DataFrame, key: str, order: list[str], keep: list[str], abnormal: str = "abnormal") -> DataFrame:
    """key and `keep` of each beat with n_abnormal (of the last ones) and alert behind it. A null label is a normal one."""

    def step(state: Ectopy, stretch: pd.DataFrame) -> pd.DataFrame:
        found = [state.step(x) for x in stretch["__abnormal"].tolist()]
        return stretch[[key, *keep]].assign(n_abnormal=[n for n, _ in found], alert=[on for _, on in found])

    own = beats.select(key, *keep).schema.simpleString()[len("struct<") : -1]
    marked = beats.withColumn("__abnormal", F.coalesce(F.col(abnormal), F.lit(False)))
    return ordered_pass(marked, key, order, Ectopy, step, f"{own},n_abnormal int,alert boolean")
