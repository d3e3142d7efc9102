"""Reports on the window table: filters, class tables, concentration, sensitivity, reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardiolake.schema import BEAT_CODES, NON_BEAT_CODES, Q_CODES, RHYTHM_CLASSES, SV_CODES, V_CODES


def rules(min_beats: int, min_covered: float, min_purity: float) -> list[tuple[str, Column]]:
    return [("n_beats", F.col("n_beats") >= min_beats), ("frac_covered", F.col("frac_covered") >= min_covered), ("purity", F.col("purity") >= min_purity)]


def waterfall(windows: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Windows left after each step of a cumulative filter, from one pass: step, name, kept."""
    sums, test = [F.count("*").alias("s0")], None
    for i, (_, rule) in enumerate(steps, 1):
        test = rule if test is None else test & rule
        sums.append(F.count_if(test).alias(f"s{i}"))
    names = ["all"] + [n for n, _ in steps]
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.col(f"s{i}").alias("kept")) for i, n in enumerate(names)])
    return windows.agg(*sums).select(F.explode(rows).alias("r")).select("r.*")


def drop_report(windows: DataFrame) -> DataFrame:
    """Candidates, those without rhythm, those with too few intervals, those kept, and coverage over 1, over the unfiltered grid."""
    known, enough = F.col("frac_covered") > 0, F.col("n_rr_used") >= 2
    return windows.agg(F.count("*").alias("candidates"), F.count_if(~known).alias("unknown"), F.count_if(known & ~enough).alias("few_rr"), F.count_if(known & enough).alias("kept"), F.count_if(F.col("frac_sum") > 1 + 1e-6).alias("over_covered"))


def classes(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(RHYTHM_CLASSES)), "label_id int, label string")


def class_table(windows: DataFrame, window_s: float, patient: str = "patient_id") -> DataFrame:
    """Windows, hours, patients and share of each class; classes without windows stay with zeros."""
    per = windows.groupBy("label_id").agg(F.count("*").alias("windows"), F.countDistinct(patient).alias("patients"))
    out = classes(windows.sparkSession).join(per, "label_id", "left").fillna(0, ["windows", "patients"])
    total = F.sum("windows").over(Window.partitionBy())
    return out.select("label_id", "label", "windows", "patients", (F.col("windows") * window_s / 3600.0).alias("hours"), F.coalesce(F.try_divide("windows", total), F.lit(0.0)).alias("share"))


def verdicts(table: DataFrame, few: tuple[int, int] = (500, 15), thin: tuple[int, int] = (20_000, 100)) -> DataFrame:
    """unusable, thin or ok for each class, by windows and patients."""
    verdict = F.when((F.col("windows") < few[0]) | (F.col("patients") < few[1]), "unusable").when((F.col("windows") < thin[0]) | (F.col("patients") < thin[1]), "thin").otherwise("ok")
    return table.select("label", "windows", "patients", verdict.alias("verdict"))


def concentration(windows: DataFrame, top: int = 10, patient: str = "patient_id") -> DataFrame:
    """Share of a class's windows that its `top` patients hold."""
    per = windows.groupBy("label_id", patient).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("label_id").orderBy(F.col("n").desc(), patient))
    ranked = per.withColumn("rank", rank)
    return ranked.groupBy("label_id").agg(F.count("*").alias("patients"), F.sum(F.when(F.col("rank") <= top, F.col("n")).otherwise(0)).alias("top_windows"), F.sum("n").alias("windows")).withColumn("top_share", F.col("top_windows") / F.col("windows"))


def per_patient_percentiles(windows: DataFrame, patient: str = "patient_id") -> DataFrame:
    """p10, p50, p90 of windows a patient, interpolated between ranks."""
    n = windows.groupBy(patient).agg(F.count("*").alias("n"))
    return n.agg(*[F.percentile("n", p).alias(f"p{round(p * 100)}") for p in (0.1, 0.5, 0.9)])


def sensitivity(windows: DataFrame, settings: list[tuple[str, int, float, float]]) -> DataFrame:
    """Windows of each class under each setting of the quality rules, all in one pass."""
    tests = [(name, reduce(lambda a, b: a & b, [r for _, r in rules(*limits)])) for name, *limits in settings]
    kept = F.explode(F.filter(F.array(*[F.when(t, F.lit(name)) for name, t in tests]), lambda x: x.isNotNull()))
    counted = windows.select(kept.alias("setting"), "label_id").groupBy("setting").pivot("label_id", [0, 1, 2]).count().fillna(0)
    return counted.select("setting", *[F.col(str(i)).alias(c.lower()) for i, c in enumerate(RHYTHM_CLASSES)])


def effective_sample(windows: DataFrame, folds: int = 5, patient: str = "patient_id") -> DataFrame:
    """Patients of each class, and whole patients a fold."""
    per = windows.groupBy("label_id").agg(F.countDistinct(patient).alias("patients"))
    return per.withColumn("patients_per_fold", F.floor(F.col("patients") / folds).cast("long"))


def code_histogram(annotations: DataFrame) -> DataFrame:
    code = F.col("code")
    kind = F.when(code.isin(*Q_CODES), "Q").when(code.isin(*V_CODES), "V").when(code.isin(*SV_CODES), "SV").when(code.isin(*BEAT_CODES), "beat").when(code.isin(*NON_BEAT_CODES), "non-beat").otherwise("UNRECOGNISED")
    return annotations.groupBy("code").agg(F.count("*").alias("n")).withColumn("kind", kind)


def label_index(spans: DataFrame, key: tuple[str, ...] = ("patient_id",)) -> DataFrame:
    """Onsets and samples of each rhythm for each segment."""
    sums = []
    for rhythm, short in zip(RHYTHM_CLASSES, ("nsr", "afib", "afl"), strict=True):
        own = F.col("rhythm") == rhythm
        sums += [F.count_if(own).alias(f"{short}_n"), F.coalesce(F.sum(F.when(own, F.col("end_sample") - F.col("start_sample"))), F.lit(0)).alias(f"{short}_samp")]
    return spans.groupBy(*key).agg(*sums)


def index_estimate(index: DataFrame, fs: float, width: int, patient: str = "patient_id") -> DataFrame:
    """From the index alone: windows, hours and patients of each rhythm."""
    rows = [F.struct(F.lit(r).alias("rhythm"), F.col(f"{s}_samp").alias("samples")) for r, s in zip(RHYTHM_CLASSES, ("nsr", "afib", "afl"), strict=True)]
    tall = index.select(patient, F.explode(F.array(*rows)).alias("r")).select(patient, "r.*")
    per = tall.groupBy(patient, "rhythm").agg(F.sum("samples").alias("samples"))
    return per.groupBy("rhythm").agg(F.floor(F.sum("samples") / width).cast("long").alias("windows"), (F.sum("samples") / (fs * 3600.0)).alias("hours"), F.count_if(F.col("samples") > 0).alias("patients"))


def index_mismatches(index: DataFrame, other: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows of both tables whose totals differ; empty if two ways of counting agree."""
    columns = [c for c in index.columns if c not in key]
    joined = index.alias("a").join(other.alias("b"), list(key), "inner")
    differ = reduce(lambda x, y: x | y, [~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns])
    return joined.where(differ)


def scan_totals(index: DataFrame, patient: str = "patient_id") -> DataFrame:
    """Patients, segments, patients with AF, per cent, and bytes that their full records would take."""
    af = F.col("afib_n") + F.col("afl_n") > 0
    sums = index.agg(F.countDistinct(patient).alias("patients"), F.count("*").alias("segments"), F.countDistinct(F.when(af, F.col(patient))).alias("af_patients"))
    return sums.withColumn("af_percent", F.coalesce(F.try_divide(F.col("af_patients") * 100.0, "patients"), F.lit(0.0))).withColumn("projected_bytes", F.col("segments") * (2_097_154 + 44_000))
