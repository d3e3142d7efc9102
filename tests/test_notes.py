"""Notes of records: lines by hand, files of whole notes, empty tables."""

from pyspark.sql import functions as F

from cardiolake.operators import directory, notes
from cardiolake.sources import sinks


def tables(spark):
    beats = [("a", 10, "N")] * 3 + [("a", 20, "V")] * 2 + [("a", 5, "S"), ("b", 30, "N")]
    beats = directory.beat_table(spark.createDataFrame(beats, "record string, sample long, kind string"), 15, "record")
    runs = spark.createDataFrame([("a", "S", 1, 1), ("a", "V", 5, 1), ("a", "V", 1, 2), ("a", "V", 2, 1), ("a", "V", 3, 2), ("b", "V", 2, 3)], "record string, kind string, length long, runs long")
    rhythms = spark.createDataFrame([("a", "N", 2, 61.5), ("a", "", 1, 0.0), ("a", "AFIB", 1, 3599.4), ("b", "N", 1, 5.0)], "record string, label string, episodes long, seconds double")
    rates = spark.createDataFrame([("a", "N", 59.5, 80.49), ("a", "AFIB", 100.2, 100.4), ("a", "VT", 1.0, 2.0)], "record string, in_force string, rate_min double, rate_max double")
    st_t = spark.createDataFrame([("a", "T", 1, "-", 1, 30.0, None), ("a", "ST", 0, "+", 2, 90.0, 250), ("a", "ST", 0, "--", 1, 4.0, 120)], "record string, type string, signal int, sign string, episodes long, seconds double, extreme int")
    quality = spark.createDataFrame([("b", "clean", 3, 600.0), ("b", "all noisy", 1, 0.2)], "record string, label string, episodes long, seconds double")
    return beats, runs, rhythms, rates, st_t, quality


A = [
    "Record a",
    "Beats\tLearning\tTest\tTotal", "N\t3\t-\t3", "S\t1\t-\t1", "V\t-\t2\t2", "Total\t4\t2\t6",
    "Ventricular ectopy", "2 isolated beats", "1 couplet", "2 runs of 3 beats", "1 run of 5 beats",
    "Rhythm\tRate\tEpisodes\tDuration", "unlabelled\t-\t1\t-", "AFIB\t100\t1\t59:59", "N\t60-80\t2\t1:02",
    "ST-T state\tExtremum\tEpisodes\tDuration", "ST0+\t+250\t2\t1:30", "ST0--\t-120\t1\t0:04", "T1-\t-\t1\t0:30",
]
B = [
    "Record b",
    "Beats\tLearning\tTest\tTotal", "N\t-\t1\t1", "Total\t0\t1\t1",
    "Ventricular ectopy", "3 couplets",
    "Rhythm\tRate\tEpisodes\tDuration", "N\t-\t1\t0:05",
    "Signal quality\tEpisodes\tDuration", "all noisy\t1\t0:00", "clean\t3\t10:00",
]


def test_notes_by_hand(spark):
    rows = notes.record_notes("record", *tables(spark)).orderBy("record", "section", "place").collect()
    assert [r["line"] for r in rows if r["record"] == "a"] == A
    assert [r["line"] for r in rows if r["record"] == "b"] == B
    # places count from 0 in each section
    for key in {(r["record"], r["section"]) for r in rows}:
        own = [r["place"] for r in rows if (r["record"], r["section"]) == key]
        assert own == list(range(len(own)))


def test_notes_in_files(spark, tmp_path):
    """A file holds whole notes, one behind the other."""
    sinks.write_notes(notes.record_notes("record", *tables(spark)), f"{tmp_path}/notes", "record")
    files = [p.read_text().splitlines() for p in (tmp_path / "notes").glob("part-*")]
    assert sorted(map(tuple, (f for f in files if f))) in ([tuple(A), tuple(B)], [tuple(A + B)], [tuple(B + A)])


def test_notes_of_empty_tables(spark):
    assert notes.record_notes("record", *[t.limit(0).where(F.lit(False)) for t in tables(spark)]).count() == 0
