"""The window table: grid, overlap labels, counts, features, quality columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardiolake.operators.rr import intervals, window_features
from cardiolake.schema import BEAT_CODES, Q_CODES, RHYTHM_CLASSES, SV_CODES, V_CODES, class_id

#: Fixed value: windows of a record that its 16-bit number can count.
MOST_WINDOWS = 65_535
FRACTIONS = ("frac_nsr", "frac_afib", "frac_aflutter")


def grid(lengths: DataFrame, width: int, stride: int | None = None, key: tuple[str, ...] = ("patient_id",)) -> DataFrame:
    """wid, start_sample, end_sample of each full window of a record of `length`; the tail is dropped, a short record has none; as many as MOST_WINDOWS are an error."""
    stride = stride or width
    if width <= 0 or stride <= 0:
        raise ValueError("width and stride must be positive")
    if stride < width:
        raise ValueError("windows that overlap would count a sample twice")
    n = F.when(F.col("length") >= width, F.expr(f"(length - {width}) div {stride} + 1")).otherwise(F.lit(0))
    n = F.when(n >= MOST_WINDOWS, F.raise_error(F.concat(n.cast("string"), F.lit(" windows are more than the window number can count")))).otherwise(n)
    ids = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    out = lengths.select(*key, F.explode(ids).alias("wid"))
    return out.withColumn("start_sample", F.col("wid") * stride).withColumn("end_sample", F.col("start_sample") + width)


def lengths(annotations: DataFrame, spans: DataFrame, nominal: int, key: tuple[str, ...] = ("patient_id",)) -> DataFrame:
    """length of each record: the nominal one, or more if a sample or span end lies beyond."""
    ends = annotations.select(*key, F.col("sample").alias("at")).unionByName(spans.select(*key, F.col("end_sample").alias("at")))
    return ends.groupBy(*key).agg(F.greatest(F.max("at") + 1, F.lit(nominal)).alias("length"))


def overlaps(spans: DataFrame, width: int, key: tuple[str, ...] = ("patient_id",)) -> DataFrame:
    """Samples that each rhythm covers in each window: spans are cut at window borders, so this is a sum, not a range join."""
    cut = spans.where("end_sample > start_sample").withColumn("wid", F.explode(F.sequence(F.floor(F.col("start_sample") / width), F.floor((F.col("end_sample") - 1) / width))))
    covered = F.least("end_sample", (F.col("wid") + 1) * width) - F.greatest("start_sample", F.col("wid") * width)
    sums = [F.sum(F.when(F.col("rhythm") == r, covered).otherwise(0)).alias(f) for r, f in zip(RHYTHM_CLASSES, FRACTIONS, strict=True)]
    return cut.groupBy(*key, F.col("wid").cast("long").alias("wid")).agg(*sums)


def overlaps_theta(spans: DataFrame, windows: DataFrame, key: tuple[str, ...] = ("patient_id",)) -> DataFrame:
    """The same as a range join of spans with a given window list (for windows that follow no grid)."""
    s, w = spans.alias("s"), windows.alias("w")
    on = reduce(lambda a, b: a & b, [F.col(f"s.{k}") == F.col(f"w.{k}") for k in key]) & (F.col("s.start_sample") < F.col("w.end_sample")) & (F.col("s.end_sample") > F.col("w.start_sample"))
    covered = F.least("s.end_sample", "w.end_sample") - F.greatest("s.start_sample", "w.start_sample")
    return w.join(s, on).groupBy(*[F.col(f"w.{k}") for k in key], "w.wid", "s.rhythm").agg(F.sum(covered).alias("covered"))


def labelled(windows: DataFrame, covered: DataFrame, width: int, key: tuple[str, ...] = ("patient_id",)) -> DataFrame:
    """Fractions, winner (ties to the lowest class), coverage and purity of each window."""
    out = windows.join(covered, [*key, "wid"], "left")
    out = out.withColumns({f: F.coalesce(F.col(f), F.lit(0)) / F.lit(float(width)) for f in FRACTIONS})
    winner = F.greatest(*FRACTIONS)
    label = F.when(F.col(FRACTIONS[0]) == winner, 0).when(F.col(FRACTIONS[1]) == winner, 1).otherwise(2)
    total = reduce(lambda a, b: a + b, [F.col(f) for f in FRACTIONS])
    out = out.withColumns({"frac_sum": total, "frac_covered": F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), "frac_winner": winner, "label_id": label})
    return out.withColumn("purity", F.coalesce(F.try_divide("frac_winner", "frac_covered"), F.lit(0.0)))


def beat_counts(beats: DataFrame, width: int, key: tuple[str, ...] = ("patient_id",)) -> DataFrame:
    code = F.col("code")
    counted = beats.withColumn("wid", F.floor(F.col("sample") / width).cast("long")).groupBy(*key, "wid")
    return counted.agg(*[F.count_if(code.isin(*codes)).alias(n) for n, codes in (("n_beats", BEAT_CODES), ("n_q", Q_CODES), ("n_v", V_CODES), ("n_sv", SV_CODES))])


def window_table(annotations: DataFrame, spans: DataFrame, fs: float, width: int, nominal: int = 0, floor: bool = True, key: tuple[str, ...] = ("patient_id",), order: tuple[str, ...] = ("sample",)) -> DataFrame:
    """One row of the core table for each window. floor keeps those with rhythm cover and two accepted intervals."""
    windows = grid(lengths(annotations, spans, nominal, key), width, key=key)
    out = labelled(windows, overlaps(spans, width, key), width, key)
    out = out.join(beat_counts(annotations, width, key), [*key, "wid"], "left").join(window_features(intervals(annotations, fs, width, key, order), key), [*key, "wid"], "left")
    out = out.fillna(0, ["n_beats", "n_q", "n_v", "n_sv", "n_rr_used", "n_rr_rejected", "n_drr_used"])
    out = out.withColumn("q_frac", F.coalesce(F.try_divide("n_q", "n_beats"), F.lit(0.0)))
    return out.where("frac_covered > 0 and n_rr_used >= 2") if floor else out


def consolidated(parts: DataFrame, part: str, position: str, key: tuple[str, ...] = ("patient_id", "segment", "wid")) -> DataFrame:
    """Later rows of equal key win."""
    latest = Window.partitionBy(*key).orderBy(F.col(part).desc(), F.col(position).desc())
    return parts.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")


__all__ = ["beat_counts", "class_id", "consolidated", "grid", "labelled", "lengths", "overlaps", "overlaps_theta", "window_table"]
