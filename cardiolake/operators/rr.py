"""Intervals between beats and their features per window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardiolake.schema import ENTROPY_BINS, PNN_SECONDS, RR_BEAT_MAX, RR_LIVE, RR_RANGE, is_rr_beat


def intervals(beats: DataFrame, fs: float, width: int, key: tuple[str, ...] = ("patient_id",), order: tuple[str, ...] = ("sample",)) -> DataFrame:
    """Beats that count for intervals, with wid, rr (seconds; null at a window's first), ok, and drr between neighbours that are both ok.

    Integer difference first, division last. Intervals never cross a window: the window is in the partition.
    """
    within = Window.partitionBy(*key, "wid").orderBy(*order)
    out = beats.where(is_rr_beat(F.col("code"))).withColumn("wid", F.floor(F.col("sample") / width).cast("long"))
    out = out.withColumn("gap", F.col("sample") - F.lag("sample").over(within)).withColumn("fs", F.lit(float(fs)))
    out = out.withColumn("rr", F.col("gap") / F.col("fs")).withColumn("ok", F.col("rr").between(*RR_RANGE))
    drr = F.when(F.col("ok") & F.lag("ok").over(within), F.col("rr") - F.lag("rr").over(within))
    return out.withColumn("drr", drr)


def entropy_bin(rr: Column) -> Column:
    low, high = RR_RANGE
    return F.least(F.greatest(((rr - low) / (high - low) * ENTROPY_BINS).cast("int"), F.lit(0)), F.lit(ENTROPY_BINS - 1))


def window_features(spaced: DataFrame, key: tuple[str, ...] = ("patient_id",)) -> DataFrame:
    """Counters and seven features of each window that holds an interval.

    Two levels of sums: by window and histogram bin, then by window, so the histogram needs no second pass over beats.
    Undefined features are null.
    """
    keys = [*key, "wid"]
    rr, drr = F.when(F.col("ok"), F.col("rr")), F.col("drr")
    binned = spaced.where("rr is not null").withColumn("bin", F.when(F.col("ok"), entropy_bin(F.col("rr"))))
    per_bin = binned.groupBy(*keys, "bin").agg(
        F.count(rr).alias("n"), F.count_if(~F.col("ok")).alias("rejected"), F.sum(F.when(F.col("ok"), F.col("gap"))).alias("s1"), F.sum(F.when(F.col("ok"), F.col("gap") * F.col("gap"))).alias("s2"),
        F.max("fs").alias("fs"), F.count(drr).alias("nd"), F.sum(drr * drr).alias("d2"), F.count_if(F.abs(drr) > PNN_SECONDS).alias("over"),
    )
    total = F.sum("n").over(Window.partitionBy(*keys))
    p = F.col("n") / total
    terms = per_bin.withColumn("h", F.when(F.col("n") > 0, -p * F.log2(p)))
    sums = terms.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "rejected", "s1", "s2", "nd", "d2", "over", "h")], F.max("fs").alias("fs"))
    # samples are summed as integers, so the mean is the same in any order
    n, mean = F.col("n"), F.try_divide(F.col("s1"), F.col("n") * F.col("fs"))
    # squared deviations in whole samples, so that nothing cancels: n * s2 - s1 * s1 is exact
    spread = n * F.col("s2") - F.col("s1") * F.col("s1")
    sdnn = F.when(n >= 2, F.sqrt(spread / (n * (n - 1))) / F.col("fs"))
    return sums.select(
        *keys, n.alias("n_rr_used"), F.col("rejected").alias("n_rr_rejected"), F.col("nd").alias("n_drr_used"), mean.alias("mean_rr"), F.try_divide(F.lit(60.0), mean).alias("hr"), sdnn.alias("hrv_sdnn"),
        F.sqrt(F.try_divide("d2", "nd")).alias("rmssd"), F.try_divide("over", "nd").alias("pnn50"), F.try_divide(sdnn, mean).alias("cv_rr"), F.when(n >= 2, F.abs(F.col("h"))).alias("rr_entropy"),
    )


FEATURES = ("mean_rr", "hr", "hrv_sdnn", "rmssd", "pnn50", "cv_rr", "rr_entropy")


def beat_features(annotations: DataFrame, fs: float, key: tuple[str, ...] = ("patient_id",), order: tuple[str, ...] = ("sample",), live: bool = False) -> DataFrame:
    """rr, heart_rate, rolling hrv of five accepted intervals, and label of each annotation with a valid interval.

    The interval is taken from the annotation right before, accepted or not; hrv runs over accepted ones alone.
    live takes the narrower open range of the monitor.
    """
    record = Window.partitionBy(*key).orderBy(*order)
    rr = (F.col("sample") - F.lag("sample").over(record)) / F.lit(float(fs))
    low, high = RR_LIVE if live else (0.0, RR_BEAT_MAX)
    inside = (F.col("rr") > low) & ((F.col("rr") < high) if live else (F.col("rr") <= high))
    kept = annotations.withColumn("rr", rr).where(inside)
    return kept.withColumns(
        {
            "heart_rate": 60.0 / F.col("rr"),
            "hrv": F.stddev_pop("rr").over(record.rowsBetween(-4, 0)),
            "label": F.when(F.col("code") == 1, "Normal").otherwise("Abnormal"),
        }
    )


def narrowed(x: Column) -> Column:
    """Storage form of a feature: five places, half to even, single precision."""
    return (F.rint(x * 1e5) / 1e5).cast("float")
