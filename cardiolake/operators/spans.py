"""Rhythm spans, change-point episodes and what is in force at a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardiolake.schema import rhythm_of


def rhythm_spans(annotations: DataFrame, key: tuple[str, ...] = ("patient_id",), order: tuple[str, ...] = ("sample", "ann_idx"), note: str = "note") -> DataFrame:
    """start_sample, end_sample, rhythm of each span.

    A classified onset opens a span and ends the one before, ')' ends it, other notes do neither; the last one ends
    at the record's last annotation. So each kept marker ends where the next kept one stands.
    """
    # only markers are ordered; of all other annotations one number a record is needed
    ends = annotations.groupBy(*key).agg(F.max("sample").alias("last_sample"))
    kept = annotations.select(*dict.fromkeys([*key, "sample", *order]), rhythm_of(F.col(note)).alias("rhythm"), F.col(note).alias("__note")).where("rhythm is not null or __note = ')'")
    following = F.lead("sample").over(Window.partitionBy(*key).orderBy(*order))
    spans = kept.withColumn("next_sample", following).where("rhythm is not null").join(ends, list(key)).withColumn("end_sample", F.coalesce("next_sample", "last_sample"))
    return spans.select(*key, F.col("sample").alias("start_sample"), "end_sample", "rhythm")


def episodes(labels: DataFrame, key: tuple[str, ...], order: tuple[str, ...], label: str, record_end: Column, test_from: int | None = None) -> DataFrame:
    """Intervals in which a label holds: from its change to the next one, the last one to the record's end.

    test_from clips the beginnings to a test period and drops what ended before it.
    """
    record = Window.partitionBy(*key).orderBy(*order)
    changed = labels.withColumn("__before", F.lag(label).over(record)).where(F.col("__before").isNull() | (F.col("__before") != F.col(label)))
    out = changed.withColumn("start_sample", F.col("sample")).withColumn("end_sample", F.coalesce(F.lead("sample").over(record), record_end))
    if test_from is not None:
        out = out.where(F.col("end_sample") > test_from).withColumn("start_sample", F.greatest("start_sample", F.lit(test_from)))
    return out.select(*key, F.col(label).alias("label"), "start_sample", "end_sample")


def in_force(rows: DataFrame, label: Column, key: tuple[str, ...], order: tuple[str, ...], name: str = "in_force") -> DataFrame:
    """The latest non-null label at or before each row: an as-of join on rows that are in one table."""
    record = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(label, ignorenulls=True).over(record))


def runs(rows: DataFrame, label: str, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Runs of neighbouring rows of one label: key, label, first, length (gaps and islands)."""
    record = Window.partitionBy(*key).orderBy(*order)
    change = F.coalesce((F.col(label) != F.lag(label).over(record)).cast("int"), F.lit(1))
    numbered = rows.withColumn("__change", change).withColumn("__run", F.sum("__change").over(record.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*key, "__run", label).agg(F.min("sample").alias("first_sample"), F.count("*").alias("length")).drop("__run")
