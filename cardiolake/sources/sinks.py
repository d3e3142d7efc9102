"""Writers of the window table, logs, lists and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardiolake.operators.rr import FEATURES, narrowed
from cardiolake.operators.windows import consolidated
from cardiolake.schema import RHYTHM_CLASSES

SMALL = {"label_id": "tinyint", "n_beats": "int", "n_q": "int", "n_v": "int", "n_sv": "int", "n_rr_used": "int", "n_rr_rejected": "int", "n_drr_used": "int"}
ROUNDED = ("frac_nsr", "frac_afib", "frac_aflutter", "frac_covered", "frac_winner", "purity", "q_frac", *FEATURES)


def stored_form(windows: DataFrame) -> DataFrame:
    """The table as it is kept: five places in single precision, narrow counts."""
    kept = {c: narrowed(F.col(c)) for c in ROUNDED if c in windows.columns} | {c: F.col(c).cast(t) for c, t in SMALL.items() if c in windows.columns}
    return windows.withColumns(kept)


def write_parts(windows: DataFrame, path: str, parts: int, patient: str = "patient_id") -> None:
    """Parts of whole patients, zstd-compressed; a part that is written again replaces itself alone."""
    part = F.pmod(F.xxhash64(patient), F.lit(parts)).cast("int")
    rows = stored_form(windows).withColumn("part_id", part).repartition(parts, "part_id").sortWithinPartitions(patient)
    rows.write.partitionBy("part_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(path)


def missing_patients(patients: DataFrame, path: str, patient: str = "patient_id") -> DataFrame:
    """Patients that no part holds yet: where an interrupted build goes on."""
    done = patients.sparkSession.read.parquet(path).select(patient).distinct()
    return patients.join(done, patient, "left_anti")


def consolidate(parts: DataFrame, path: str, part: str = "part_id", position: str = "ord", key: tuple[str, ...] = ("patient_id", "segment", "wid")) -> None:
    """One table of unique keys, the later part winning, with the label's name."""
    label = F.element_at(F.array(*[F.lit(c) for c in RHYTHM_CLASSES]), F.col("label_id").cast("int") + 1)
    consolidated(parts, part, position, key).withColumn("label", label).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_summary(reports: dict[str, DataFrame], path: str, most_rows: int = 10_000, **settings) -> None:
    """Small reports and settings as one JSON file; a report of more than most_rows rows is an error, as it belongs in a table."""
    spark = next(iter(reports.values())).sparkSession
    body: dict = {"settings": settings}
    for name, rows in reports.items():
        body[name] = [r.asDict(recursive=True) for r in rows.limit(most_rows + 1).collect()]
        if len(body[name]) > most_rows:
            raise ValueError(f"report {name} has more than {most_rows} rows: write it as a table")
    spark.createDataFrame([(json.dumps(body, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_sealed(rows: DataFrame, failed: DataFrame, path: str, bucket: str) -> None:
    """Buckets of beats, without those in which a patient failed: they stay open for another run."""
    rows.join(failed.select(bucket).distinct(), bucket, "left_anti").write.partitionBy(bucket).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_selection(patients: DataFrame, path: str, patient: str = "patient_id", order: str = "burden") -> None:
    """Chosen patients as text, best first; a selection is as short as its limit."""
    patients.coalesce(1).sortWithinPartitions(F.col(order).desc(), patient).select(F.col(patient).cast("string")).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header, undefined values as empty fields."""
    rows.coalesce(1).write.mode("overwrite").option("header", "true").option("nullValue", "").csv(path)


def text_table(counts: DataFrame, record: str, kind: str, kinds: list[str], value: str = "total") -> DataFrame:
    """One tab-separated line a record with a column a kind, '-' for none."""
    wide = counts.groupBy(record).pivot(kind, kinds).agg(F.first(value))
    cell = lambda k: F.when(F.coalesce(F.col(f"`{k}`"), F.lit(0)) == 0, "-").otherwise(F.col(f"`{k}`").cast("string"))
    return wide.select(F.concat_ws("\t", F.col(record).cast("string"), *[cell(k) for k in kinds]).alias("line"))


def write_notes(notes: DataFrame, path: str, record: str) -> None:
    """Lines of notes as text; a file holds whole notes, one behind the other."""
    placed = notes.repartition(record).sortWithinPartitions(record, "section", "place")
    placed.select("line").write.mode("overwrite").text(path)
