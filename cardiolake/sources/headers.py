"""Text files around a recording: headers, lists, scripts, points of interest, logs and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNAL = r"^(\S+)\s+(\d+)(?:\S*)\s+([0-9.]+)(?:\((-?\d+)\))?\S*\s+(\d+)\s+(-?\d+)\s+(-?\d+)\s+(-?\d+)\s+(\d+)\s*(.*)$"


def read_headers(spark: SparkSession, glob: str) -> DataFrame:
    """One row for each header file: record line, signal lines, and what the comments say of age, sex, drugs."""
    text = spark.read.text(glob, wholetext=True)
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.regexp_replace(x, r"\r$", "")), lambda x: F.length(F.trim(x)) > 0)
    parts = text.select(F.filter(lines, lambda x: ~x.startswith("#")).alias("body"), F.transform(F.filter(lines, lambda x: x.startswith("#")), lambda x: F.trim(F.regexp_replace(x, "^#", ""))).alias("notes"))
    first = F.split(F.trim(F.col("body")[0]), r"\s+")
    number = lambda s, i, kind: F.when(F.regexp_extract(s, SIGNAL, i) != "", F.regexp_extract(s, SIGNAL, i).cast(kind))
    signal = lambda s: F.struct(
        F.regexp_extract(s, SIGNAL, 1).alias("file"), number(s, 2, "int").alias("fmt"), number(s, 3, "double").alias("gain"), number(s, 4, "int").alias("baseline"), number(s, 5, "int").alias("adc_res"),
        number(s, 6, "int").alias("adc_zero"), number(s, 7, "int").alias("init"), number(s, 8, "int").alias("checksum"), number(s, 9, "int").alias("block"), F.trim(F.regexp_extract(s, SIGNAL, 10)).alias("lead"),
    )
    about = F.coalesce(F.col("notes")[0], F.lit(""))
    return parts.select(
        first[0].alias("record_id"), first[1].cast("int").alias("nsig"), F.regexp_extract(first[2], r"^[0-9.]+", 0).cast("double").alias("fs"), F.try_element_at(first, F.lit(4)).cast("long").alias("n_samples"),
        F.transform(F.filter("body", lambda s, i: (i > 0) & s.rlike(SIGNAL)), signal).alias("signals"),
        F.when(about.rlike(r"^\d+"), F.regexp_extract(about, r"^(\d+)", 1).cast("int")).otherwise(F.when(about.rlike(r"(?i)age:\s*\d+"), F.regexp_extract(about, r"(?i)age:\s*(\d+)", 1).cast("int"))).alias("age"),
        F.nullif(F.regexp_extract(about, r"(?:^|\s|:)([MF])(?:\s|$)", 1), F.lit("")).alias("sex"), F.try_element_at("notes", F.lit(2)).alias("meds"), "notes",
    )


def read_record_list(spark: SparkSession, path: str) -> DataFrame:
    """record_id of each line, once, in order."""
    return spark.read.text(path).select(F.trim("value").alias("record_id")).where("record_id <> ''").distinct().orderBy("record_id")


def read_annotators(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("trim(value) <> ''").select(F.split("value", "\t")[0].alias("annotator"), F.try_element_at(F.split("value", "\t"), F.lit(2)).alias("description"))


def read_points_of_interest(spark: SparkSession, path: str) -> DataFrame:
    """record, at_sec, note from lines such as `100 5:30 text`."""
    line = r"^\s*(\S+)\s+(\d+):(\d+)\s+(.*)$"
    part = lambda i: F.regexp_extract("value", line, i)
    return spark.read.text(path).where(F.col("value").rlike(line)).select(part(1).alias("record"), (part(2).cast("int") * 60 + part(3).cast("int")).alias("at_sec"), F.trim(part(4)).alias("note"))


def read_display_intervals(spark: SparkSession, path: str) -> DataFrame:
    """record, from_sec and to_sec (null: to the end) from lines such as `100 0-60`."""
    line = r"^\s*(\S+)\s+(\d+)-(\d+|e)\s*$"
    part = lambda i: F.regexp_extract("value", line, i)
    return spark.read.text(path).where(F.col("value").rlike(line)).select(part(1).alias("record"), part(2).cast("int").alias("from_sec"), F.when(part(3) != "e", part(3).cast("int")).alias("to_sec"))


def read_view_scripts(spark: SparkSession, glob: str) -> DataFrame:
    """Options of view scripts, a row for each file: record, annotator, from, url."""
    text = spark.read.text(glob, wholetext=True)
    option = lambda c: F.nullif(F.regexp_extract("value", rf"(?:^|\s)-{c}\s+(\S+)", 1), F.lit(""))
    return text.select(option("r").alias("record"), option("a").alias("annotator"), option("f").alias("at"), option("p").alias("url"))


def read_log(spark: SparkSession, path: str, schema: str, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """JSON lines with a torn tail: broken lines go, the last line of each key stays."""
    from cardiolake.operators.cohort import latest_per_key

    rows = spark.read.schema(f"{schema}, _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    return latest_per_key(rows.where("_broken is null").drop("_broken"), key, order)


def read_label_index(spark: SparkSession, path: str, pretty: bool = False) -> DataFrame:
    """The gzip JSON index {patients: {pid: [[seg, nsr_n, afib_n, afl_n, nsr_samp, afib_samp, afl_samp], ..]}} as rows.

    An object a line, of which a file may hold any number; pretty: one object a file, over many lines.
    """
    whole = spark.read.schema("fs int, patients map<string, array<array<long>>>").option("multiLine", str(pretty).lower()).json(path)
    names = ("segment", "nsr_n", "afib_n", "afl_n", "nsr_samp", "afib_samp", "afl_samp")
    rows = whole.select(F.explode("patients").alias("patient_id", "rows")).select("patient_id", F.explode("rows").alias("r"))
    return rows.select("patient_id", *[F.col("r")[i].alias(n) for i, n in enumerate(names)])


def write_label_index(index: DataFrame, path: str, fs: int = 250) -> None:
    """The same index, one JSON object a patient and line, gzip-compressed, patients in order."""
    names = ("segment", "nsr_n", "afib_n", "afl_n", "nsr_samp", "afib_samp", "afl_samp")
    rows = F.sort_array(F.collect_list(F.array(*[F.col(n).cast("long") for n in names])))
    per = index.groupBy("patient_id").agg(rows.alias("rows"))
    per.select(F.lit(fs).alias("fs"), F.create_map("patient_id", "rows").alias("patients")).repartitionByRange(F.element_at(F.map_keys("patients"), 1)).write.mode("overwrite").option("compression", "gzip").json(path)
