"""A record's note: its statistics as ordered lines of tab-separated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardiolake.operators.directory import clock

#: Sections of a note in their order.
TITLE, BEATS, ECTOPY_S, ECTOPY_V, RHYTHMS, ST_T, QUALITY = range(7)


def _cell(count: Column) -> Column:
    return F.when(F.coalesce(count, F.lit(0)) == 0, "-").otherwise(count.cast("string"))


def _lines(rows: DataFrame, record: str, section: int, heading: Column, line: Column, *order: Column | str) -> DataFrame:
    """record, section, place and line; the heading stands at place 0, the rows behind it in their order.

    A section holds a row for each kind of a record, however long the record is.
    """
    numbered = rows.select(F.col(record), heading.alias("__heading"), line.alias("__line"), F.row_number().over(Window.partitionBy(record).orderBy(*order)).alias("__n"))
    both = F.when(F.col("__n") == 1, F.array("__heading", "__line")).otherwise(F.array("__line"))
    placed = numbered.select(record, "__n", F.size(both).alias("__size"), F.posexplode(both).alias("__at", "line"))
    return placed.select(record, F.lit(section).alias("section"), (F.col("__n") - F.col("__size") + 1 + F.col("__at")).alias("place"), "line")


def beat_lines(table: DataFrame, record: str, kind: str = "kind") -> DataFrame:
    """The title and the beat table: kinds by name with beats of the learning and test period and in all, then their totals.

    table: what directory.beat_table gives; its total over all records is left out.
    """
    own = table.where(F.col(record).isNotNull())
    title = own.where(F.col(kind).isNull()).select(record, F.lit(TITLE).alias("section"), F.lit(0).alias("place"), F.concat(F.lit("Record "), F.col(record).cast("string")).alias("line"))
    counts = [F.col(c) for c in ("learning", "test", "total")]
    total = F.concat_ws("\t", F.lit("Total"), *[c.cast("string") for c in counts])
    line = F.when(F.col(kind).isNull(), total).otherwise(F.concat_ws("\t", F.col(kind), *[_cell(c) for c in counts]))
    return title.unionByName(_lines(own, record, BEATS, F.lit("Beats\tLearning\tTest\tTotal"), line, F.col(kind).isNull(), kind))


def ectopy_lines(runs: DataFrame, record: str, kind: str, section: int, heading: str) -> DataFrame:
    """Runs of ectopic beats of one kind by their length; nothing for a record with no more than one isolated beat.

    runs: what directory.ectopic_runs gives.
    """
    several = F.when(F.col("runs") > 1, "s").otherwise("")
    name = F.when(F.col("length") == 1, F.concat(F.lit("isolated beat"), several)).when(F.col("length") == 2, F.concat(F.lit("couplet"), several))
    name = F.coalesce(name, F.concat(F.lit("run"), several, F.lit(" of "), F.col("length").cast("string"), F.lit(" beats")))
    beats = F.sum(F.col("length") * F.col("runs")).over(Window.partitionBy(record))
    found = runs.where(F.col("kind") == kind).withColumn("__beats", beats).where("__beats > 1")
    return _lines(found, record, section, F.lit(heading), F.concat_ws(" ", F.col("runs").cast("string"), name), "length")


def rhythm_lines(summary: DataFrame, rates: DataFrame, record: str) -> DataFrame:
    """Rhythms by name with their rates, episodes and time.

    summary: what directory.rhythm_summary gives; rates: what directory.rhythm_rates gives. Rates are rounded to whole
    beats a minute, the greatest one stands behind the least one where it is greater; '-' where none was measured.
    """
    low, high = (F.floor(F.col(c) + 0.5).cast("long") for c in ("rate_min", "rate_max"))
    rate = F.when(low.isNull(), "-").when(high > low, F.concat_ws("-", low.cast("string"), high.cast("string"))).otherwise(low.cast("string"))
    known = summary.join(rates.select(record, F.col("in_force").alias("label"), "rate_min", "rate_max"), [record, "label"], "left")
    name = F.when(F.col("label") == "", "unlabelled").otherwise(F.col("label"))
    return _lines(known, record, RHYTHMS, F.lit("Rhythm\tRate\tEpisodes\tDuration"), F.concat_ws("\t", name, rate, F.col("episodes").cast("string"), clock(F.col("seconds"))), "label")


def st_t_lines(summary: DataFrame, record: str) -> DataFrame:
    """ST and T changes by signal, with the extreme (of the change's sign), episodes and time. summary: what directory.st_t_summary gives."""
    extreme = F.coalesce(F.concat(F.substring("sign", 1, 1), F.col("extreme").cast("string")), F.lit("-"))
    line = F.concat_ws("\t", F.concat(F.col("type"), F.col("signal").cast("string"), F.col("sign")), extreme, F.col("episodes").cast("string"), clock(F.col("seconds")))
    return _lines(summary, record, ST_T, F.lit("ST-T state\tExtremum\tEpisodes\tDuration"), line, "signal", "type", "sign")


def quality_lines(summary: DataFrame, record: str) -> DataFrame:
    """States of signal quality by name with episodes and time. summary: label, episodes and seconds."""
    line = F.concat_ws("\t", F.col("label"), F.col("episodes").cast("string"), clock(F.col("seconds")))
    return _lines(summary, record, QUALITY, F.lit("Signal quality\tEpisodes\tDuration"), line, "label")


def record_notes(record: str, beats: DataFrame, runs: DataFrame, rhythms: DataFrame, rates: DataFrame, st_t: DataFrame, quality: DataFrame) -> DataFrame:
    """record, section, place and line of the notes of all records; a record's note is its lines by section and place.

    A section without rows has no heading. Null kinds, labels or lengths have no place in these tables; empty tables give no lines.
    """
    parts = [
        beat_lines(beats, record),
        ectopy_lines(runs, record, "S", ECTOPY_S, "Supraventricular ectopy"),
        ectopy_lines(runs, record, "V", ECTOPY_V, "Ventricular ectopy"),
        rhythm_lines(rhythms, rates, record),
        st_t_lines(st_t, record),
        quality_lines(quality, record),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
