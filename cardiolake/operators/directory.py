"""Statistics of a record directory: beats, ectopic runs, rhythms with rates, ST and T changes, signal quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardiolake.operators.spans import episodes, runs
from cardiolake.schema import RATE_FROM_MARK, RHYTHM_FITS

ST_T = r"^(\(|A)?(ST|T)([0-9]{1,2})?(\+\+|\+|--|-|BP)([0-9]*)(\))?$"


def beat_table(beats: DataFrame, learning_end: int, record: str = "record_id", kind: str = "kind") -> DataFrame:
    """Beats of each record and kind before and after the learning period, with totals of records and of all (null keys)."""
    early = F.col("sample") < learning_end
    sums = [F.count_if(early).alias("learning"), F.count_if(~early).alias("test"), F.count("*").alias("total")]
    return beats.rollup(record, kind).agg(*sums)


def ectopic_runs(beats: DataFrame, record: tuple[str, ...], order: tuple[str, ...], group: str = "group") -> DataFrame:
    """kind (S or V), length and number of runs of ectopic beats.

    group is N, S, V or F, or null for beats that neither extend nor end a run. The last run of a record counts for its own kind.
    """
    found = runs(beats.where(F.col(group).isNotNull()), group, record, order)
    return found.where(F.col(group).isin("S", "V")).groupBy(*record, F.col(group).alias("kind"), "length").agg(F.count("*").alias("runs"))


def rhythm_summary(labels: DataFrame, key: tuple[str, ...], order: tuple[str, ...], label: str, fs: float, test_from: int | None = None) -> DataFrame:
    """Episodes and seconds of each rhythm; labels must hold record_end."""
    spans = episodes(labels, key, order, label, F.col("record_end"), test_from)
    return spans.groupBy(*key, "label").agg(F.count("*").alias("episodes"), (F.sum(F.col("end_sample") - F.col("start_sample")) / fs).alias("seconds"))


def rate_intervals(rows: DataFrame, key: tuple[str, ...], order: tuple[str, ...], rhythm: str = "rhythm", group: str = "group", noise: str | None = None) -> DataFrame:
    """Beats with in_force (the rhythm of the last mark, '' before one) and rr3: samples over the last three intervals, where a rate can be measured.

    rows: marks (rhythm is not null) and beats (group is N, S, V, F, P or W), in one order. A counter of beats begins
    anew at -1 behind every mark (at 0 for SVTA and VT, whose first interval counts from the beat before), at a beat
    that doesn't fit the rhythm in force, and where noise (a boolean column) makes all signals unreadable; from 3 on, the last
    four beats give a sum. A beat that lacks earlier ones counts them at sample 0, as a record begins.

    The counter needs no loop: it is the number of beats so far plus what the last reset has left.
    """
    upto = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    beat = F.col(group).isNotNull()
    fits = F.create_map(*[F.lit(x) for pair in RHYTHM_FITS.items() for x in pair])
    allowed = F.try_element_at(fits, F.col("in_force"))
    misfit = beat & F.coalesce(~allowed.contains(F.col(group)), F.lit(False))
    start = F.when(F.col(rhythm).isNotNull(), F.when(F.col(rhythm).isin(*RATE_FROM_MARK), 0).otherwise(-1)).when(misfit | (F.coalesce(F.col(noise), F.lit(False)) if noise else F.lit(False)), -1)
    known = rows.withColumn("in_force", F.coalesce(F.last(rhythm, ignorenulls=True).over(upto), F.lit(""))).withColumn("__beats", F.count_if(beat).over(upto))
    counter = F.col("__beats") + F.coalesce(F.last(start - F.col("__beats"), ignorenulls=True).over(upto), F.lit(-1))
    beats = known.withColumn("__counter", counter).where(beat)
    rr3 = F.col("sample") - F.lag("sample", 3, 0).over(Window.partitionBy(*key).orderBy(*order))
    return beats.withColumn("rr3", F.when(F.col("__counter") >= 3, rr3)).drop("__beats", "__counter")


def rhythm_rates(rows: DataFrame, key: tuple[str, ...], order: tuple[str, ...], fs: float, rhythm: str = "rhythm", group: str = "group", noise: str | None = None) -> DataFrame:
    """Least and greatest rate of each rhythm in force, and how many sums of three intervals they come from (see rate_intervals)."""
    found = rate_intervals(rows, key, order, rhythm, group, noise).where("rr3 > 0")
    rate = 60.0 * 3 * fs
    return found.groupBy(*key, "in_force").agg((rate / F.max("rr3")).alias("rate_min"), (rate / F.min("rr3")).alias("rate_max"), F.count("*").alias("sums"))


def st_t_marks(notes: DataFrame, note: str = "note") -> DataFrame:
    """Parsed ST and T notes: part (open, extreme, close or none), type, signal, sign, magnitude; other notes are left out."""
    part = lambda i: F.regexp_extract(note, ST_T, i)
    place = F.when(part(6) == ")", "close").when(part(1) == "(", "open").when(part(1) == "A", "extreme").otherwise("none")
    number = lambda i: F.when(part(i) != "", part(i).cast("int"))
    return notes.where(F.col(note).rlike(ST_T)).withColumns({"place": place, "type": part(2), "signal": F.coalesce(number(3), F.lit(0)), "sign": part(4), "magnitude": number(5)})


def st_t_episodes(notes: DataFrame, key: tuple[str, ...], order: tuple[str, ...], record_end: str = "record_end", note: str = "note") -> DataFrame:
    """type, signal, sign, start_sample and end_sample of each episode of an ST or T change.

    A closing mark ends the episode that the mark before it (of the same type, signal and sign) has opened; without an
    opening mark before it, it ends one that began with the record. A second opening mark begins the episode anew; one
    that is open at the end, later than sample 0, ends with the record. One window over neighbours, whatever the number of marks.
    """
    marks = st_t_marks(notes, note).where("place in ('open', 'close') and (type = 'T' or sign in ('+', '-'))")
    ordered = Window.partitionBy(*key, "type", "signal", "sign").orderBy(*order)
    before = F.when(F.lag("place").over(ordered) == "open", F.lag("sample").over(ordered)).otherwise(0)
    rows = marks.withColumns({"__before": before, "__last": F.lead("place").over(ordered).isNull()})
    closed = F.col("place") == "close"
    rows = rows.where(closed | (F.col("__last") & (F.col("sample") > 0)))
    return rows.select(*key, "type", "signal", "sign", F.when(closed, F.col("__before")).otherwise(F.col("sample")).alias("start_sample"), F.when(closed, F.col("sample")).otherwise(F.col(record_end)).alias("end_sample"))


def st_t_summary(notes: DataFrame, key: tuple[str, ...], order: tuple[str, ...], fs: float, record_end: str = "record_end", note: str = "note") -> DataFrame:
    """Episodes, seconds and extreme of each type, signal and sign that has episodes; doubled signs share the extreme of the single one."""
    group = [*key, "type", "signal"]
    found = st_t_episodes(notes, key, order, record_end, note).groupBy(*group, "sign").agg(F.count("*").alias("episodes"), (F.sum(F.col("end_sample") - F.col("start_sample")) / fs).alias("seconds"))
    side = lambda sign: F.substring(sign, 1, 1)
    marks = st_t_marks(notes, note).where("place = 'extreme' and magnitude > 0 and sign <> 'BP' and (type = 'T' or sign in ('+', '-'))")
    extremes = marks.groupBy(*group, side(F.col("sign")).alias("__side")).agg(F.max("magnitude").alias("extreme"))
    return found.withColumn("__side", side(F.col("sign"))).join(extremes, [*group, "__side"], "left").drop("__side")


def quality_state(code, channels: int = 2):
    """Name of a signal-quality bitmask: unreadable wins over noisy."""
    low = code.bitwiseAND(0xFF)
    bad = [low.bitwiseAND(mask) == mask for mask in (0x11, 0x22, 0x44)][:channels]
    noisy = [low.bitwiseAND(mask) == mask for mask in (0x01, 0x02, 0x04)][:channels]
    out = F.when(low == 0xFF, "all unreadable").when(low == 0, "clean")
    for i, test in enumerate(bad):
        out = out.when(test, f"signal {i} unreadable")
    every = noisy[0]
    for test in noisy[1:]:
        every = every & test
    out = out.when(every, "all noisy") if channels > 1 else out
    for i, test in enumerate(noisy):
        out = out.when(test, f"signal {i} noisy")
    return out.otherwise("unknown")


def clock(seconds):
    """m:ss, rounded to the nearest second; '-' for nothing."""
    whole = F.floor(seconds + 0.5).cast("long")
    return F.when(seconds.isNull() | (seconds <= 0), "-").otherwise(F.format_string("%d:%02d", F.floor(whole / 60).cast("long"), F.pmod(whole, F.lit(60)).cast("long")))
