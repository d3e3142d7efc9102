"""What the monitor and the record explorer show, as expressions on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardiolake.functions.dsp import beat_shapes

from cardiolake.schema import ECTOPY_LAST, LIVE_MIN_COVERAGE, LIVE_MIN_RR, RR_RANGE

NORMAL_LABELS = ("n", "normal", "--", "none", "")


def coverage(window_s: float) -> Column:
    """Share of a window that its accepted intervals fill."""
    return F.coalesce(F.col("n_rr_used") * F.col("mean_rr") / window_s, F.lit(0.0))


def gate(window_s: float, min_rr: int = LIVE_MIN_RR, min_coverage: float = LIVE_MIN_COVERAGE, features: tuple[str, ...] = ()) -> Column:
    """Status of a window, by the gates in order: warmup, leadoff, low_quality, not_finite, ok."""
    finite = F.lit(True)
    for name in features:
        finite = finite & F.col(name).isNotNull() & ~F.isnan(name)
    return (
        F.when(F.col("warmup"), "warmup").when(F.col("leadoff") > 0, "leadoff").when((F.col("n_rr_used") < min_rr) | (F.col("n_drr_used") < 1) | (coverage(window_s) < min_coverage), "low_quality").when(~finite, "not_finite").otherwise("ok")
    )


def is_abnormal(label: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(label, F.lit("")))).isin(*NORMAL_LABELS)


def headline(alarm: Column, run: Column, score: Column) -> Column:
    """What the monitor shows in large letters."""
    return F.when(alarm, "AF ALARM").when(run > 0, F.concat(F.lit("AF? "), run.cast("string"), F.lit("/3"))).when(score.isNull(), "--").when(score >= 0.5, "IRREGULAR").otherwise("NSR")


def recent_abnormal(beats: DataFrame, abnormal: Column, key: tuple[str, ...], order: tuple[str, ...], last: int = ECTOPY_LAST) -> DataFrame:
    """Abnormal ones among each beat and the last - 1 before it."""
    return beats.withColumn("n_abnormal", F.sum(abnormal.cast("int")).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(1 - last, 0)))


def tachogram(beats: DataFrame, fs: float, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """seconds_ago and interval of each beat; rejected intervals are clipped into the accepted range."""
    record = Window.partitionBy(*key).orderBy(*order)
    rr = (F.col("sample") - F.lag("sample").over(record)) / F.lit(float(fs))
    ago = (F.max("sample").over(Window.partitionBy(*key)) - F.col("sample")) / F.lit(float(fs))
    low, high = RR_RANGE
    rows = beats.withColumn("rr", rr).withColumn("seconds_ago", ago).where("rr is not null")
    return rows.withColumn("accepted", F.col("rr").between(low, high)).withColumn("shown", F.least(F.greatest("rr", F.lit(low)), F.lit(high)))


def autoscale(values: DataFrame, key: tuple[str, ...], value: str, least_pad: float = 20.0) -> DataFrame:
    """Limits of a plot: from the 1st to the 99th percentile and the extremes, padded by a tenth, by least_pad at least."""
    sums = values.groupBy(*key).agg(F.percentile(value, 0.01).alias("p1"), F.percentile(value, 0.99).alias("p99"), F.min(value).alias("low"), F.max(value).alias("high"))
    pad = F.greatest((F.col("p99") - F.col("p1")) * 0.1, F.lit(least_pad))
    return sums.withColumns({"bottom": F.col("p1") - pad, "top": F.col("p99") + pad})


def record_summary(rows: DataFrame, key: tuple[str, ...], truth: str, guess: str) -> DataFrame:
    """Beats, predicted normal and abnormal, and share of right ones of each record."""
    return rows.groupBy(*key).agg(F.count("*").alias("beats"), F.count_if(F.col(guess) == "Normal").alias("normal"), F.count_if(F.col(guess) != "Normal").alias("abnormal"), F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("match_rate"))


def matched_beats(truth: DataFrame, found: DataFrame, tolerance: int, key: str = "patient_id") -> DataFrame:
    """Annotated beats with their nearest detected one within the tolerance (null without); ties go to the earlier one.

    Samples are put into bins as wide as the tolerance; a beat meets its own and both neighbouring bins, so this is
    an equi-join.
    """
    width = max(tolerance, 1)
    left = truth.select(key, F.col("sample").alias("a")).withColumn("bin", F.explode(F.array(*[F.floor(F.col("a") / width) + d for d in (-1, 0, 1)])))
    right = found.select(key, F.col("sample").alias("b")).withColumn("bin", F.floor(F.col("b") / width))
    near = left.join(right, [key, "bin"], "left").where(F.col("b").isNull() | (F.abs(F.col("a") - F.col("b")) <= tolerance))
    best = F.min(F.when(F.col("b").isNotNull(), F.struct(F.abs(F.col("a") - F.col("b")).alias("d"), "b"))).alias("m")
    hits = near.groupBy(key, "a").agg(best).select(key, F.col("a").alias("sample"), F.col("m.b").alias("detected"))
    return truth.select(key, "sample").distinct().join(hits, [key, "sample"], "left")


def with_waveform(windows: DataFrame, waveform: DataFrame, key: tuple[str, ...] = ("patient_id", "segment", "wid")) -> DataFrame:
    """Windows with the waveform features of the same key where there are any."""
    return windows.join(waveform, list(key), "left")


def snap_to_peak(markers: DataFrame, trace: DataFrame, reach: int, key: tuple[str, ...] = ("record_id",), position: str = "pos", value: str = "x") -> DataFrame:
    """markers (key, position) with `shown`, the place of the trace's highest value within `reach` (the first of equals), and its value.

    Each marker asks for its 2 * reach + 1 places, which meet the trace in an equi-join; markers off the trace go.
    """
    here = trace.select(*key, F.col(position).alias("__at"), F.col(value).alias("shown_value"))
    on_trace = markers.select(*key, position).distinct().join(here.select(*key, F.col("__at").alias(position)), [*key, position], "left_semi")
    asked = on_trace.withColumn("__at", F.explode(F.sequence(F.col(position) - reach, F.col(position) + reach)))
    best = F.max(F.struct("shown_value", (-F.col("__at")).alias("low"))).alias("best")
    return asked.join(here, [*key, "__at"]).groupBy(*key, position).agg(best).select(*key, position, (-F.col("best.low")).alias("shown"), "best.shown_value")


def waveform_features(beats: DataFrame, signals: DataFrame, fs: float, key: tuple[str, ...] = ("record_id",), filtered: bool = True) -> DataFrame:
    """amplitude and qrs_width of the waveform at each beat: key, sample, amplitude, qrs_width.

    beats: key and sample; signals: key and signal, a record's whole waveform as an array, which is bandpass-filtered
    first. The amplitude is the waveform's value at the beat (0 behind its end), the width the seconds between the
    first and last sample within 0.1 s whose size exceeds half of it. A record's beats travel to its waveform.
    """
    at = beats.groupBy(*key).agg(F.array_sort(F.collect_set("sample")).alias("at"))
    found = beat_shapes(F.col("signal"), F.col("at"), fs, filtered)
    rows = signals.join(at, list(key)).select(*key, F.explode(F.arrays_zip("at", found["amplitude"].alias("amplitude"), found["qrs_width"].alias("qrs_width"))).alias("b"))
    return rows.select(*key, F.col("b.at").alias("sample"), "b.amplitude", "b.qrs_width")


def display_window(beats: DataFrame, until: int, label: str = "label", predicted: str = "predicted", position: str = "sample") -> DataFrame:
    """The beats that a view of a record's first samples shows, with correct: whether the model has them right (null without a label or prediction)."""
    return beats.where(F.col(position) < until).withColumn("correct", F.col(label) == F.col(predicted))
