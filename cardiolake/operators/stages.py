"""Stages of ML pipelines that begin with raw annotations, so that a saved model scores what a recording holds."""

from __future__ import annotations

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from cardiolake.operators.rr import intervals, window_features


class BeatWindows(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Annotations (patient_id, sample, code and the order's columns) to the interval features of their windows.

    Windows without a difference of neighbouring intervals have no features of their own and are left out.
    """

    fs = Param(Params._dummy(), "fs", "samples a second", TypeConverters.toFloat)
    width = Param(Params._dummy(), "width", "samples a window", TypeConverters.toInt)
    order = Param(Params._dummy(), "order", "columns that order a recording's annotations", TypeConverters.toListString)

    def __init__(self, fs: float | None = None, width: int | None = None, order: list[str] | None = None):
        super().__init__()
        self._setDefault(order=["sample", "ann_idx"])
        self._set(**{k: v for k, v in (("fs", fs), ("width", width), ("order", order)) if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        known = intervals(dataset, self.getOrDefault(self.fs), self.getOrDefault(self.width), order=tuple(self.getOrDefault(self.order)))
        return window_features(known).where("n_drr_used >= 1")


def from_annotations(fitted: PipelineModel, fs: float, width: int, order: list[str] | None = None) -> PipelineModel:
    """A model fitted on window features, with the stage before it that makes them. Annotations have no label, and none is missed."""
    stages = [s.copy({s.handleInvalid: "keep"}) if isinstance(s, StringIndexerModel) else s for s in fitted.stages]
    return PipelineModel([BeatWindows(fs, width, order), *stages])
