"""Queries of the operators on the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardiolake.functions import dsp
from cardiolake.operators import cohort, directory, forest, kernel_svm, learning, metrics, neighbours, notes, ordered, quality, serving, spans, windows
from cardiolake.operators.rr import FEATURES, beat_features, intervals, window_features
from cardiolake.plans.tables import FS, SQL_A, SQL_ALL, SQL_OVER, SQL_RR, SQL_SPANS, WIDTH, annotations, table
from cardiolake.schema import is_beat
from cardiolake.sources import headers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
ORDER = ("sample", "ann_idx")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def _scratch(spark, name: str) -> str:
    """A new folder in spark.checkpoint.dir, which the driver and all executors share; a local session without one gets its own beside the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _spans(spark, sf):
    return spans.rhythm_spans(annotations(spark, sf))


def _windows(spark, sf, floor: bool = True):
    a = annotations(spark, sf)
    return windows.window_table(a, spans.rhythm_spans(a), FS, WIDTH, floor=floor, order=ORDER)


SQL_F6 = ", ".join(f"round({c}, 6) AS {c}" for c in FEATURES)
LABELS = ("frac_nsr", "frac_afib", "frac_aflutter", "frac_covered", "frac_winner", "purity")
SQL_L6 = ", ".join(f"round({c}, 6) AS {c}" for c in LABELS)


@query(f"WITH {SQL_A}, {SQL_RR} SELECT patient_id, wid, n_rr_used, n_rr_rejected, n_drr_used, {SQL_F6} FROM feats")
def rr_window_features(spark, sf):
    f = window_features(intervals(annotations(spark, sf), FS, WIDTH, order=ORDER))
    return f.select("patient_id", "wid", "n_rr_used", "n_rr_rejected", "n_drr_used", *r6(*FEATURES))


@query(f"WITH {SQL_A}, {SQL_SPANS} SELECT * FROM spans")
def rhythm_spans(spark, sf):
    return _spans(spark, sf)


@query(f"WITH {SQL_A}, {SQL_SPANS}, {SQL_OVER} SELECT patient_id, wid, label_id, {SQL_L6} FROM labels_")
def window_labels(spark, sf):
    a = annotations(spark, sf)
    s = spans.rhythm_spans(a)
    out = windows.labelled(windows.grid(windows.lengths(a, s, 0), WIDTH), windows.overlaps(s, WIDTH), WIDTH)
    return out.select("patient_id", "wid", "label_id", *r6(*LABELS))


COUNTS = "n_beats, n_q, n_v, n_sv, n_rr_used, n_rr_rejected, n_drr_used"


@query(f"WITH {SQL_ALL} SELECT patient_id, wid, wid * 600000 AS start_sample, (wid + 1) * 600000 AS end_sample, label_id, {SQL_L6}, {COUNTS}, round(q_frac, 6) AS q_frac, {SQL_F6} FROM wt")
def windows_table(spark, sf):
    return _windows(spark, sf).select("patient_id", "wid", "start_sample", "end_sample", "label_id", *r6(*LABELS), *COUNTS.split(", "), *r6("q_frac", *FEATURES))


@query(f"WITH {SQL_ALL} SELECT patient_id, wid, n_beats, n_q, n_v, n_sv FROM cnt")
def beat_counts_by_window(spark, sf):
    return windows.beat_counts(annotations(spark, sf), WIDTH)


@query(f"WITH {SQL_A} SELECT code, count(*) AS n, CASE WHEN code = 13 THEN 'Q' WHEN code = 5 THEN 'V' WHEN code = 8 THEN 'SV' WHEN code = 1 THEN 'beat' ELSE 'non-beat' END AS kind FROM a GROUP BY code")
def code_histogram(spark, sf):
    return quality.code_histogram(annotations(spark, sf))




@query(f"""WITH {SQL_ALL}, s AS (SELECT count(*) AS s0, count(*) FILTER (n_beats >= 5) AS s1, count(*) FILTER (n_beats >= 5 AND frac_covered >= 0.5) AS s2, count(*) FILTER (n_beats >= 5 AND frac_covered >= 0.5 AND purity >= 0.7) AS s3 FROM wt)
SELECT 0 AS step, 'all' AS name, s0 AS kept FROM s UNION ALL SELECT 1, 'n_beats', s1 FROM s UNION ALL SELECT 2, 'frac_covered', s2 FROM s UNION ALL SELECT 3, 'purity', s3 FROM s""")
def quality_waterfall(spark, sf):
    return quality.waterfall(_windows(spark, sf), quality.rules(5, 0.5, 0.7))


@query(f"WITH {SQL_ALL} SELECT count(*) AS candidates, count(*) FILTER (NOT frac_covered > 0) AS unknown, count(*) FILTER (frac_covered > 0 AND n_rr_used < 2) AS few_rr, count(*) FILTER (frac_covered > 0 AND n_rr_used >= 2) AS kept, count(*) FILTER (frac_sum > 1 + 1e-6) AS over_covered FROM full_")
def drop_report(spark, sf):
    return quality.drop_report(_windows(spark, sf, floor=False))


SETTINGS = [("loose", 3, 0.3, 0.5), ("default", 5, 0.5, 0.7), ("strict", 7, 0.8, 0.9)]


@query(f"""WITH {SQL_ALL}, s(setting, b, c, p) AS (VALUES ('loose', 3, 0.3, 0.5), ('default', 5, 0.5, 0.7), ('strict', 7, 0.8, 0.9))
SELECT setting, count(*) FILTER (label_id = 0) AS nsr, count(*) FILTER (label_id = 1) AS afib, count(*) FILTER (label_id = 2) AS aflutter FROM wt, s WHERE n_beats >= b AND frac_covered >= c AND purity >= p GROUP BY setting""")
def threshold_sensitivity(spark, sf):
    return quality.sensitivity(_windows(spark, sf), SETTINGS)


SQL_CLASSES = "cl(label_id, label) AS (VALUES (0, 'NSR'), (1, 'AFib'), (2, 'AFlutter')), n AS (SELECT label_id, count(*) AS windows, count(DISTINCT patient_id) AS patients FROM wt GROUP BY label_id), ct AS (SELECT cl.label_id, label, coalesce(windows, 0) AS windows, coalesce(patients, 0) AS patients FROM cl LEFT JOIN n USING (label_id))"


@query(f"WITH {SQL_ALL}, {SQL_CLASSES} SELECT *, round(windows * 20.0 / 3600, 6) AS hours, round(windows / sum(windows) OVER (), 6) AS share FROM ct")
def class_table(spark, sf):
    return quality.class_table(_windows(spark, sf), WIDTH / FS).select("label_id", "label", "windows", "patients", *r6("hours", "share"))


@query(f"WITH {SQL_ALL}, {SQL_CLASSES} SELECT label, windows, patients, CASE WHEN windows < 500 OR patients < 15 THEN 'unusable' WHEN windows < 20000 OR patients < 100 THEN 'thin' ELSE 'ok' END AS verdict FROM ct")
def class_verdicts(spark, sf):
    return quality.verdicts(quality.class_table(_windows(spark, sf), WIDTH / FS))


@query(f"""WITH {SQL_ALL}, p AS (SELECT label_id, patient_id, count(*) AS n FROM wt GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY n DESC, patient_id) AS rank FROM p)
SELECT label_id, count(*) AS patients, sum(CASE WHEN rank <= 10 THEN n ELSE 0 END)::BIGINT AS top_windows, sum(n)::BIGINT AS windows, round(sum(CASE WHEN rank <= 10 THEN n ELSE 0 END) / sum(n), 6) AS top_share FROM r GROUP BY label_id""")
def patient_concentration(spark, sf):
    return quality.concentration(_windows(spark, sf)).withColumn("top_share", F.round("top_share", 6))


@query(f"WITH {SQL_ALL}, p AS (SELECT patient_id, count(*) AS n FROM wt GROUP BY ALL) SELECT round(quantile_cont(n, 0.1), 6) AS p10, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90 FROM p")
def windows_per_patient_percentiles(spark, sf):
    return quality.per_patient_percentiles(_windows(spark, sf)).select(*r6("p10", "p50", "p90"))


@query(f"WITH {SQL_ALL} SELECT label_id, count(DISTINCT patient_id) AS patients, count(DISTINCT patient_id) // 5 AS patients_per_fold FROM wt GROUP BY label_id")
def effective_sample(spark, sf):
    return quality.effective_sample(_windows(spark, sf))


SQL_INDEX = """sseg AS (SELECT s.*, 1 + start_sample // 86400 AS segment FROM spans s),
ix AS (SELECT patient_id, segment, count(*) FILTER (rhythm = 'NSR') AS nsr_n, coalesce(sum(end_sample - start_sample) FILTER (rhythm = 'NSR'), 0)::BIGINT AS nsr_samp,
  count(*) FILTER (rhythm = 'AFib') AS afib_n, coalesce(sum(end_sample - start_sample) FILTER (rhythm = 'AFib'), 0)::BIGINT AS afib_samp,
  count(*) FILTER (rhythm = 'AFlutter') AS afl_n, coalesce(sum(end_sample - start_sample) FILTER (rhythm = 'AFlutter'), 0)::BIGINT AS afl_samp FROM sseg GROUP BY ALL)"""


def _index(spark, sf):
    s = _spans(spark, sf).withColumn("segment", F.floor(F.col("start_sample") / 86_400).cast("long") + 1)
    return quality.label_index(s, ("patient_id", "segment"))


@query(f"WITH {SQL_A}, {SQL_SPANS}, {SQL_INDEX} SELECT * FROM ix")
def label_index(spark, sf):
    return _index(spark, sf)


@query(f"WITH {SQL_A}, {SQL_SPANS}, {SQL_INDEX} SELECT patient_id::VARCHAR AS patient_id, segment, nsr_n, afib_n, afl_n, nsr_samp, afib_samp, afl_samp FROM ix")
def label_index_files(spark, sf):
    """The index written as gzip JSON files and read again."""
    path = _scratch(spark, "index")
    headers.write_label_index(_index(spark, sf).withColumn("patient_id", F.col("patient_id").cast("string")), path)
    return headers.read_label_index(spark, path)


@query(f"""WITH {SQL_A}, {SQL_SPANS}, {SQL_INDEX}, t AS (SELECT patient_id, 'NSR' AS rhythm, nsr_samp AS s FROM ix UNION ALL SELECT patient_id, 'AFib', afib_samp FROM ix UNION ALL SELECT patient_id, 'AFlutter', afl_samp FROM ix), p AS (SELECT patient_id, rhythm, sum(s) AS s FROM t GROUP BY ALL)
SELECT rhythm, (sum(s) // 600000)::BIGINT AS windows, round(sum(s) / (30000 * 3600.0), 6) AS hours, count(*) FILTER (s > 0) AS patients FROM p GROUP BY rhythm""")
def index_estimate(spark, sf):
    return quality.index_estimate(_index(spark, sf), FS, WIDTH).withColumn("hours", F.round("hours", 6))


@query(f"""WITH {SQL_A}, {SQL_SPANS}, {SQL_OVER}, one AS (SELECT patient_id, coalesce(sum(end_sample - start_sample) FILTER (rhythm = 'NSR'), 0) AS a, coalesce(sum(end_sample - start_sample) FILTER (rhythm = 'AFib'), 0) AS b, coalesce(sum(end_sample - start_sample) FILTER (rhythm = 'AFlutter'), 0) AS c FROM spans GROUP BY ALL),
other AS (SELECT patient_id, sum(nsr) AS a, sum(afib) AS b, sum(afl) AS c FROM covered GROUP BY ALL)
SELECT count(*) FILTER (one.a <> coalesce(other.a, 0) OR one.b <> coalesce(other.b, 0) OR one.c <> coalesce(other.c, 0)) AS mismatches, count(*) AS joined FROM one LEFT JOIN other USING (patient_id)""")
def index_crosscheck(spark, sf):
    """Totals from spans and totals from window overlaps plus cut tails must agree for every patient."""
    s = _spans(spark, sf)
    names = {"NSR": "nsr", "AFib": "afib", "AFlutter": "afl"}
    one = quality.label_index(s).select("patient_id", *[f"{n}_samp" for n in names.values()])
    sums = windows.overlaps(s, WIDTH).groupBy("patient_id").agg(F.sum("frac_nsr").alias("nsr_samp"), F.sum("frac_afib").alias("afib_samp"), F.sum("frac_aflutter").alias("afl_samp"))
    other = one.select("patient_id").join(sums, "patient_id", "left").fillna(0)
    return quality.index_mismatches(one, other, ("patient_id",)).agg(F.count("*").alias("mismatches")).crossJoin(one.agg(F.count("*").alias("joined")))


@query(f"WITH {SQL_A}, {SQL_SPANS}, {SQL_INDEX} SELECT count(DISTINCT patient_id) AS patients, count(*) AS segments, count(DISTINCT CASE WHEN afib_n + afl_n > 0 THEN patient_id END) AS af_patients, round(count(DISTINCT CASE WHEN afib_n + afl_n > 0 THEN patient_id END) * 100.0 / count(DISTINCT patient_id), 6) AS af_percent, count(*) * 2141154 AS projected_bytes FROM ix")
def scan_totals(spark, sf):
    return quality.scan_totals(_index(spark, sf)).withColumn("af_percent", F.round("af_percent", 6))


@query(f"WITH {SQL_A}, {SQL_SPANS}, {SQL_INDEX}, p AS (SELECT patient_id, sum(afib_n + afl_n)::BIGINT AS burden, sum(nsr_n)::BIGINT AS nsr_n FROM ix GROUP BY ALL) SELECT * FROM p ORDER BY burden > 0 DESC, burden DESC, nsr_n DESC, patient_id LIMIT 20")
def select_patients(spark, sf):
    return cohort.select_patients(_index(spark, sf), 20)


@query(f"""WITH {SQL_A}, {SQL_SPANS}, {SQL_INDEX}, r AS (SELECT *, afib_samp + afl_samp AS ab FROM ix), q AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY (ab > 0) DESC, ab DESC, segment) AS rank, CASE WHEN ab > 0 THEN 'abnormal' WHEN nsr_samp > 0 THEN 'nsr' END AS pool FROM r),
n AS (SELECT q.*, row_number() OVER (PARTITION BY patient_id, pool ORDER BY CASE WHEN pool = 'abnormal' THEN rank ELSE segment END) AS nth FROM q WHERE pool IS NOT NULL),
c AS (SELECT patient_id, least(sum(CASE WHEN pool = 'abnormal' THEN 1 ELSE 0 END), 10) AS n_ab FROM q GROUP BY patient_id)
SELECT patient_id, segment, pool, nth FROM n JOIN c USING (patient_id) WHERE nth <= (CASE WHEN pool = 'abnormal' THEN 10 ELSE least(greatest(n_ab, 1), 5, 10 - n_ab) END)""")
def choose_segments(spark, sf):
    return cohort.choose_segments(_index(spark, sf))


@query(f"WITH {SQL_A} SELECT patient_id, segment, sample, ann_idx, code FROM a QUALIFY row_number() OVER (PARTITION BY patient_id, segment ORDER BY sample DESC, ann_idx DESC) = 1")
def dedup_latest(spark, sf):
    return cohort.latest_per_key(annotations(spark, sf), ("patient_id", "segment"), ORDER).select("patient_id", "segment", "sample", "ann_idx", "code")


@query(f"WITH {SQL_ALL} SELECT patient_id, wid, label_id FROM wt QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY md5(patient_id::VARCHAR || '|' || wid::VARCHAR)) <= 3")
def capped_sample(spark, sf):
    return cohort.capped(_windows(spark, sf), 3, "patient_id", "wid").select("patient_id", "wid", "label_id")


SQL_SPLIT = "pr AS (SELECT patient_id, row_number() OVER (ORDER BY md5(patient_id::VARCHAR), patient_id) AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT patient_id FROM wt)), sp AS (SELECT wt.patient_id, wid, label_id, CASE WHEN rank <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS fold FROM wt JOIN pr USING (patient_id))"


@query(f"WITH {SQL_ALL}, {SQL_SPLIT} SELECT * FROM sp")
def group_split(spark, sf):
    return cohort.group_split(_windows(spark, sf).select("patient_id", "wid", "label_id"), 0.2, "patient_id")


@query(f"WITH {SQL_ALL}, {SQL_SPLIT} SELECT count(*) AS leaked FROM (SELECT patient_id FROM sp WHERE fold = 'train' INTERSECT SELECT patient_id FROM sp WHERE fold = 'test')")
def leakage_check(spark, sf):
    return cohort.leaks(group_split(spark, sf), "patient_id").agg(F.count("*").alias("leaked"))


@query(f"WITH {SQL_ALL} SELECT patient_id, wid, label_id, CASE WHEN row_number() OVER (PARTITION BY label_id ORDER BY md5(patient_id::VARCHAR || '|' || wid::VARCHAR), patient_id, wid) <= ceil(count(*) OVER (PARTITION BY label_id) * 0.2) THEN 'test' ELSE 'train' END AS fold FROM wt")
def stratified_split(spark, sf):
    return cohort.stratified_split(_windows(spark, sf).select("patient_id", "wid", "label_id"), 0.2, "label_id", "patient_id", "wid")


#: Folds from the window table, as a query to stand inside another: the greedy dealing played through.
FOLDS = """WITH RECURSIVE p AS (SELECT patient_id, count(*) FILTER (label_id = 0) AS a, count(*) FILTER (label_id = 1) AS b, count(*) FILTER (label_id = 2) AS c, count(*) AS rows FROM wt GROUP BY patient_id),
t AS (SELECT sum(a)::BIGINT AS ta, sum(b)::BIGINT AS tb, sum(c)::BIGINT AS tc FROM p), g AS (SELECT a, b, c, count(*) AS m, row_number() OVER (ORDER BY 3 * (a * a + b * b + c * c) - (a + b + c) * (a + b + c) DESC, a DESC, b DESC, c DESC) AS n FROM p GROUP BY a, b, c),
u AS (SELECT g.*, j, row_number() OVER (ORDER BY n, j) AS s FROM g, LATERAL (SELECT unnest(range(0, m % 5)) AS j)),
x AS (SELECT 0::BIGINT AS s, [[0, 0, 0], [0, 0, 0], [0, 0, 0], [0, 0, 0], [0, 0, 0]]::BIGINT[][] AS st, -1 AS f UNION ALL
  SELECT s, [CASE WHEN i - 1 = pick THEN [st[i][1] + a, st[i][2] + b, st[i][3] + c] ELSE st[i] END for i in range(1, 6)], pick FROM (SELECT u.s, u.a, u.b, u.c, x.st, list_min([{'cost': coalesce((st[i][1] * a)::DOUBLE / nullif(ta * ta, 0), 0) + coalesce((st[i][2] * b)::DOUBLE / nullif(tb * tb, 0), 0) + coalesce((st[i][3] * c)::DOUBLE / nullif(tc * tc, 0), 0), 'n': list_sum(st[i]), 'f': i - 1} for i in range(1, 6)]).f::INT AS pick FROM x JOIN u ON u.s = x.s + 1, t)),
r AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY md5(patient_id::VARCHAR), patient_id) - 1 AS r FROM p JOIN g USING (a, b, c))
SELECT patient_id, r.rows, CASE WHEN r.r < r.m // 5 * 5 THEN (r.r % 5)::INT ELSE f END AS fold FROM r LEFT JOIN u ON u.n = r.n AND u.j = r.r - r.m // 5 * 5 LEFT JOIN x ON x.s = u.s"""


@query(f"WITH {SQL_ALL}, folded AS ({FOLDS}) SELECT * FROM folded")
def group_folds(spark, sf):
    return cohort.group_folds(_windows(spark, sf), 5, "patient_id", "label_id")


@query(f"""WITH {SQL_A}, x AS (SELECT *, (sample - lag(sample) OVER (PARTITION BY patient_id ORDER BY sample, ann_idx)) / 30000.0::DOUBLE AS rr FROM a)
SELECT patient_id, ann_idx, sample, round(rr, 6) AS rr, round(60.0 / rr, 6) AS heart_rate, round(stddev_pop(rr) OVER (PARTITION BY patient_id ORDER BY sample, ann_idx ROWS 4 PRECEDING), 6) AS hrv, CASE WHEN code = 1 THEN 'Normal' ELSE 'Abnormal' END AS label FROM x WHERE rr > 0 AND rr <= 3""")
def beat_features_rr(spark, sf):
    f = beat_features(annotations(spark, sf), FS, order=ORDER)
    return f.select("patient_id", "ann_idx", "sample", *r6("rr", "heart_rate", "hrv"), "label")


def _grouped(a: DataFrame) -> DataFrame:
    """N, S, V or F of each beat; markers are null."""
    return a.withColumn("group", F.when(F.col("code") == 1, "N").when(F.col("code") == 8, "S").when(F.col("code") == 5, "V").when(F.col("code") == 13, "F"))


SQL_GROUP = "g AS (SELECT *, CASE code WHEN 1 THEN 'N' WHEN 8 THEN 'S' WHEN 5 THEN 'V' WHEN 13 THEN 'F' END AS grp FROM a)"


@query(f"""WITH {SQL_A}, {SQL_GROUP}, c AS (SELECT *, CASE WHEN grp = lag(grp) OVER w THEN 0 ELSE 1 END AS ch FROM g WHERE grp IS NOT NULL WINDOW w AS (PARTITION BY patient_id ORDER BY sample, ann_idx)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY patient_id ORDER BY sample, ann_idx) AS run FROM c), n AS (SELECT patient_id, run, grp, count(*) AS length FROM r GROUP BY ALL)
SELECT patient_id, grp AS kind, length, count(*) AS runs FROM n WHERE grp IN ('S', 'V') GROUP BY ALL""")
def ectopic_runs(spark, sf):
    return directory.ectopic_runs(_grouped(annotations(spark, sf)), ("patient_id",), ORDER)


@query(f"WITH {SQL_A}, {SQL_GROUP} SELECT patient_id, grp AS kind, count(*) FILTER (sample < 432000) AS learning, count(*) FILTER (sample >= 432000) AS test, count(*) AS total FROM g WHERE grp IS NOT NULL GROUP BY ROLLUP (patient_id, grp)")
def beat_table_learning_test(spark, sf):
    g = _grouped(annotations(spark, sf)).where("group is not null").withColumnRenamed("group", "kind")
    return directory.beat_table(g, 432_000, "patient_id")


SQL_EP = """m AS (SELECT *, max(sample) OVER (PARTITION BY patient_id) AS record_end FROM a), lb AS (SELECT * FROM m WHERE note IS NOT NULL), ch AS (SELECT * FROM lb QUALIFY note IS DISTINCT FROM lag(note) OVER (PARTITION BY patient_id ORDER BY sample, ann_idx)),
ep AS (SELECT patient_id, note AS label, sample AS start_sample, coalesce(lead(sample) OVER (PARTITION BY patient_id ORDER BY sample, ann_idx), record_end) AS end_sample FROM ch)"""


def _labels(spark, sf):
    return annotations(spark, sf).withColumn("record_end", F.max("sample").over(Window.partitionBy("patient_id"))).where("note is not null")


@query(f"WITH {SQL_A}, {SQL_EP} SELECT patient_id, label, count(*) AS episodes, round(sum(end_sample - start_sample) / 30000.0, 6) AS seconds FROM ep GROUP BY ALL")
def rhythm_episodes(spark, sf):
    return directory.rhythm_summary(_labels(spark, sf), ("patient_id",), ORDER, "note", FS).withColumn("seconds", F.round("seconds", 6))


@query(f"WITH {SQL_A}, {SQL_EP} SELECT patient_id, label, count(*) AS episodes, round(sum(end_sample - greatest(start_sample, 432000)) / 30000.0, 6) AS seconds FROM ep WHERE end_sample > 432000 GROUP BY ALL")
def rhythm_episodes_test_period(spark, sf):
    return directory.rhythm_summary(_labels(spark, sf), ("patient_id",), ORDER, "note", FS, test_from=432_000).withColumn("seconds", F.round("seconds", 6))


@query(f"""WITH RECURSIVE {SQL_A}, ends AS (SELECT patient_id, max(sample) AS record_end FROM a GROUP BY ALL),
o AS (SELECT patient_id, sample, [1, 1, 1, 2, 2, 2, 3, 3][k % 9 + 1] AS kind, k, ['o', 'a', 'c', 'o', 'a', 'c', 'o', 'c'][k % 9 + 1] AS place, row_number() OVER (PARTITION BY patient_id ORDER BY sample, ann_idx) AS n FROM a WHERE code = 28 AND k % 9 < 8),
x AS (SELECT DISTINCT patient_id, 0::BIGINT AS n, [0, 0, 0]::BIGINT[] AS began, [0, 0, 0]::BIGINT[] AS episodes, [0, 0, 0]::BIGINT[] AS took, [0, 0]::BIGINT[] AS extreme FROM o UNION ALL
  SELECT o.patient_id, o.n, [CASE WHEN i <> kind OR place = 'a' THEN began[i] WHEN place = 'o' THEN sample ELSE 0 END for i in range(1, 4)], [CASE WHEN i = kind AND place = 'c' THEN episodes[i] + 1 ELSE episodes[i] END for i in range(1, 4)],
    [CASE WHEN i = kind AND place = 'c' THEN took[i] + sample - began[i] ELSE took[i] END for i in range(1, 4)], [CASE WHEN i = kind AND place = 'a' THEN greatest(extreme[i], (100 + k)) ELSE extreme[i] END for i in range(1, 3)] FROM x JOIN o ON o.patient_id = x.patient_id AND o.n = x.n + 1),
z AS (SELECT x.*, record_end FROM x JOIN ends USING (patient_id) QUALIFY row_number() OVER (PARTITION BY x.patient_id ORDER BY n DESC) = 1),
y AS (SELECT patient_id, i, CASE WHEN i = 1 THEN 'ST' ELSE 'T' END AS type, CASE WHEN i = 1 THEN 0 ELSE 1 END AS signal, ['+', '--', '-'][i] AS sign, episodes[i] + (began[i] > 0)::INT AS episodes, took[i] + CASE WHEN began[i] > 0 THEN record_end - began[i] ELSE 0 END AS took, CASE WHEN extreme[least(i, 2)] > 0 THEN extreme[least(i, 2)]::INT END AS extreme FROM z, range(1, 4) r(i))
SELECT patient_id, type, signal, sign, episodes, round(took / 30000.0, 6) AS seconds, extreme FROM y WHERE episodes > 0""")
def st_t_summary(spark, sf):
    """ST and T notes by the numbers of markers: three kinds of changes on two signals."""
    number = (F.col("k") + 100).cast("string")
    notes = [F.lit("(ST0+"), F.concat(F.lit("AST0+"), number), F.lit("ST0+)"), F.lit("(T1--"), F.concat(F.lit("AT1--"), number), F.lit("T1--)"), F.lit("(T1-"), F.lit("T1-)"), F.lit("x")]
    rows = _labels(spark, sf).withColumn("note", F.element_at(F.array(*notes), F.pmod("k", F.lit(9)) + 1))
    return directory.st_t_summary(rows, ("patient_id",), ORDER, FS).withColumn("seconds", F.round("seconds", 6))


SQL_ASOF = "asof_ AS (SELECT *, last_value(note IGNORE NULLS) OVER (PARTITION BY patient_id ORDER BY sample, ann_idx ROWS UNBOUNDED PRECEDING) AS in_force FROM a)"


@query(f"WITH {SQL_A}, {SQL_ASOF} SELECT patient_id, ann_idx, sample, code, in_force FROM asof_ WHERE code <> 28")
def asof_rhythm_at_beat(spark, sf):
    out = spans.in_force(annotations(spark, sf), F.col("note"), ("patient_id",), ORDER)
    return out.where(is_beat(F.col("code"))).select("patient_id", "ann_idx", "sample", "code", "in_force")


#: Rhythm marks of more kinds for the rates: by the number of a marker.
RATE_RHYTHMS = ("N", "AFIB", "VT", "SVTA", "AB", "IVR", "B", "")


@query(f"""WITH RECURSIVE {SQL_A}, {SQL_GROUP}, o AS (SELECT patient_id, sample, CASE WHEN code = 28 THEN {list(RATE_RHYTHMS)}[k % 8 + 1] END AS mark, CASE WHEN grp = 'F' AND k % 10 = 0 THEN NULL ELSE grp END AS grp, row_number() OVER (PARTITION BY patient_id ORDER BY sample, ann_idx) AS n FROM g),
x AS (SELECT DISTINCT patient_id, 0::BIGINT AS n, '' AS in_force, -1 AS counter, [0, 0, 0, 0]::BIGINT[] AS last, NULL::BIGINT AS rr3 FROM o
UNION ALL SELECT o.patient_id, o.n, coalesce(mark, in_force), c, l, CASE WHEN grp IS NOT NULL AND c >= 3 THEN l[4] - l[1] END FROM x JOIN o ON o.patient_id = x.patient_id AND o.n = x.n + 1,
  LATERAL (SELECT CASE WHEN mark IN ('VT', 'SVTA') THEN 0 WHEN mark IS NOT NULL OR grp IS NULL THEN -1 WHEN in_force = 'N' AND grp <> 'N' OR in_force = 'AB' AND grp NOT IN ('N', 'S') OR in_force = 'SVTA' AND grp <> 'S' OR in_force IN ('VT', 'IVR') AND grp NOT IN ('V', 'F') THEN -1 ELSE counter + 1 END AS c, CASE WHEN grp IS NULL THEN last ELSE list_append(last[2:4], sample) END AS l))
SELECT patient_id, in_force, round(60.0 * 3 * 30000 / max(rr3), 6) AS rate_min, round(60.0 * 3 * 30000 / min(rr3), 6) AS rate_max, count(*) AS sums FROM x WHERE rr3 > 0 GROUP BY ALL""")
def rhythm_rates(spark, sf):
    names = F.array(*map(F.lit, RATE_RHYTHMS))
    rows = _grouped(annotations(spark, sf)).withColumn("rhythm", F.when(F.col("code") == 28, F.element_at(names, F.pmod("k", F.lit(8)) + 1)))
    noise = (F.col("group") == "F") & (F.col("k") % 10 == 0)
    rows = rows.withColumn("noise", noise).withColumn("group", F.when(~F.coalesce(noise, F.lit(False)), F.col("group")))
    return directory.rhythm_rates(rows, ("patient_id",), ORDER, FS, noise="noise").select("patient_id", "in_force", *r6("rate_min", "rate_max"), "sums")

SQL_STATE = """CASE WHEN k & 255 = 255 THEN 'all unreadable' WHEN k & 255 = 0 THEN 'clean' WHEN k & 17 = 17 THEN 'signal 0 unreadable' WHEN k & 34 = 34 THEN 'signal 1 unreadable' WHEN k & 3 = 3 THEN 'all noisy'
  WHEN k & 1 = 1 THEN 'signal 0 noisy' WHEN k & 2 = 2 THEN 'signal 1 noisy' ELSE 'unknown' END"""


@query(f"""WITH {SQL_A}, st AS (SELECT patient_id, sample, ann_idx, max(sample) OVER (PARTITION BY patient_id) AS record_end, CASE WHEN code = 28 THEN {SQL_STATE} END AS state FROM a),
ch AS (SELECT * FROM st WHERE state IS NOT NULL QUALIFY state IS DISTINCT FROM lag(state) OVER (PARTITION BY patient_id ORDER BY sample, ann_idx)),
qe AS (SELECT patient_id, state AS label, coalesce(lead(sample) OVER (PARTITION BY patient_id ORDER BY sample, ann_idx), record_end) - sample AS took FROM ch)
SELECT patient_id, label, count(*) AS episodes, round(sum(took) / 30000.0, 6) AS seconds FROM qe GROUP BY ALL""")
def quality_episodes(spark, sf):
    """Episodes and time of each state of signal quality; a marker's number is the bitmask."""
    rows = _labels(spark, sf).withColumn("state", directory.quality_state(F.col("k")))
    return directory.rhythm_summary(rows, ("patient_id",), ORDER, "state", FS).withColumn("seconds", F.round("seconds", 6))


def _sql_clock(seconds: str) -> str:
    whole = f"floor({seconds} + 0.5)::BIGINT"
    return f"CASE WHEN {seconds} > 0 THEN printf('%d:%02d', {whole} // 60, {whole} % 60) ELSE '-' END"


SQL_RUN_LINES = """SELECT patient_id, {section} AS section, row_number() OVER (PARTITION BY patient_id ORDER BY length) AS place, '{heading}' AS heading,
  concat(n, ' ', CASE length WHEN 1 THEN 'isolated beat' WHEN 2 THEN 'couplet' ELSE 'run' END, CASE WHEN n > 1 THEN 's' ELSE '' END, CASE WHEN length > 2 THEN concat(' of ', length, ' beats') ELSE '' END) AS line
FROM (SELECT *, runs AS n FROM er WHERE kind = '{kind}' QUALIFY sum(length * runs) OVER (PARTITION BY patient_id) > 1)"""


@query(f"""WITH {SQL_A}, {SQL_GROUP}, er AS ({ORACLE_SQL["ectopic_runs"]}), rr AS ({ORACLE_SQL["rhythm_rates"]}), stt AS ({ORACLE_SQL["st_t_summary"]}), qs AS ({ORACLE_SQL["quality_episodes"]}),
b AS (SELECT patient_id, grp, count(*) FILTER (sample < 432000) AS l, count(*) FILTER (sample >= 432000) AS t, count(*) AS n FROM g WHERE grp IS NOT NULL GROUP BY GROUPING SETS ((patient_id, grp), (patient_id))),
mr AS (SELECT patient_id, sample, ann_idx, max(sample) OVER (PARTITION BY patient_id) AS record_end, CASE WHEN code = 28 THEN {list(RATE_RHYTHMS)}[k % 8 + 1] END AS mark FROM a),
cr AS (SELECT * FROM mr WHERE mark IS NOT NULL QUALIFY mark IS DISTINCT FROM lag(mark) OVER (PARTITION BY patient_id ORDER BY sample, ann_idx)),
re AS (SELECT patient_id, mark AS label, coalesce(lead(sample) OVER (PARTITION BY patient_id ORDER BY sample, ann_idx), record_end) - sample AS took FROM cr),
rs AS (SELECT patient_id, label, count(*) AS episodes, sum(took) / 30000.0 AS seconds FROM re GROUP BY ALL),
ry AS (SELECT rs.*, floor(rate_min + 0.5)::BIGINT AS low, floor(rate_max + 0.5)::BIGINT AS high FROM rs LEFT JOIN rr ON rr.patient_id = rs.patient_id AND rr.in_force = rs.label),
parts AS (
  SELECT patient_id, 1 AS section, row_number() OVER (PARTITION BY patient_id ORDER BY grp IS NULL, grp) AS place, concat_ws(chr(9), 'Beats', 'Learning', 'Test', 'Total') AS heading,
    CASE WHEN grp IS NULL THEN concat_ws(chr(9), 'Total', l, t, n) ELSE concat_ws(chr(9), grp, CASE WHEN l = 0 THEN '-' ELSE l::VARCHAR END, CASE WHEN t = 0 THEN '-' ELSE t::VARCHAR END, n) END AS line FROM b
  UNION ALL {SQL_RUN_LINES.format(section=2, kind="S", heading="Supraventricular ectopy")}
  UNION ALL {SQL_RUN_LINES.format(section=3, kind="V", heading="Ventricular ectopy")}
  UNION ALL SELECT patient_id, 4, row_number() OVER (PARTITION BY patient_id ORDER BY label), concat_ws(chr(9), 'Rhythm', 'Rate', 'Episodes', 'Duration'),
    concat_ws(chr(9), CASE WHEN label = '' THEN 'unlabelled' ELSE label END, CASE WHEN low IS NULL THEN '-' WHEN high > low THEN concat(low, '-', high) ELSE low::VARCHAR END, episodes, {_sql_clock("seconds")}) FROM ry
  UNION ALL SELECT patient_id, 5, row_number() OVER (PARTITION BY patient_id ORDER BY signal, type, sign), concat_ws(chr(9), 'ST-T state', 'Extremum', 'Episodes', 'Duration'),
    concat_ws(chr(9), concat(type, signal, sign), coalesce(sign[1] || extreme::VARCHAR, '-'), episodes, {_sql_clock("seconds")}) FROM stt
  UNION ALL SELECT patient_id, 6, row_number() OVER (PARTITION BY patient_id ORDER BY label), concat_ws(chr(9), 'Signal quality', 'Episodes', 'Duration'), concat_ws(chr(9), label, episodes, {_sql_clock("seconds")}) FROM qs)
SELECT patient_id, 0 AS section, 0 AS place, concat('Record ', patient_id) AS line FROM (SELECT DISTINCT patient_id FROM b)
UNION ALL SELECT patient_id, section, 0, heading FROM parts WHERE place = 1
UNION ALL SELECT patient_id, section, place::INT, line FROM parts""")
def record_notes(spark, sf):
    """The notes of all records: beats, ectopy, rhythms with rates, ST and T changes, signal quality."""
    a = annotations(spark, sf)
    g = _grouped(a).where("group is not null")
    names = F.array(*map(F.lit, RATE_RHYTHMS))
    marks = _labels(spark, sf).withColumn("mark", F.element_at(names, F.pmod("k", F.lit(8)) + 1))
    rhythms = directory.rhythm_summary(marks, ("patient_id",), ORDER, "mark", FS)
    beats = directory.beat_table(g.withColumnRenamed("group", "kind"), 432_000, "patient_id")
    runs = directory.ectopic_runs(g, ("patient_id",), ORDER)
    return notes.record_notes("patient_id", beats, runs, rhythms, rhythm_rates(spark, sf), st_t_summary(spark, sf), quality_episodes(spark, sf))


@query("SELECT event_type, day(ts)::INT AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY CUBE (event_type, day(ts)::INT)")
def cube_type_day(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.dayofmonth("ts").alias("day"), "value")
    return e.cube("event_type", "day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {SQL_A}, {SQL_SPANS}, {SQL_OVER} SELECT g.patient_id, g.wid, rhythm, sum(least(end_sample, (g.wid + 1) * 600000) - greatest(start_sample, g.wid * 600000))::BIGINT AS covered FROM grid g JOIN spans s ON g.patient_id = s.patient_id AND start_sample < (g.wid + 1) * 600000 AND end_sample > g.wid * 600000 GROUP BY ALL")
def overlap_join_theta(spark, sf):
    a = annotations(spark, sf)
    s = spans.rhythm_spans(a)
    return windows.overlaps_theta(s, windows.grid(windows.lengths(a, s, 0), WIDTH))


@query(f"""WITH RECURSIVE {SQL_A}, o AS (SELECT patient_id, sample, row_number() OVER (PARTITION BY patient_id ORDER BY sample, ann_idx) AS n FROM a WHERE code <> 28),
w AS (SELECT patient_id, sample, n, sample AS last, true AS keep FROM o WHERE n = 1 UNION ALL SELECT o.patient_id, o.sample, o.n, CASE WHEN o.sample - w.last >= 6000 THEN o.sample ELSE w.last END, o.sample - w.last >= 6000 FROM w JOIN o ON o.patient_id = w.patient_id AND o.n = w.n + 1)
SELECT patient_id, sample FROM w WHERE keep""")
def refractory_dedup(spark, sf):
    return ordered.refractory(annotations(spark, sf).where(is_beat(F.col("code"))), "patient_id", "sample", 6_000)


@query("""WITH RECURSIVE s AS (SELECT user_id, event_id, (row_number() OVER w - 1) * 15 AS tm, CASE WHEN event_type = 'error' THEN NULL ELSE least(value / 40, 1) END AS score, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
x AS (SELECT user_id, event_id, n, CASE WHEN score >= 0.9 THEN 1 ELSE 0 END AS run, CASE WHEN score < 0.9 THEN 1 ELSE 0 END AS clear, false AS alarm, CASE WHEN score IS NOT NULL THEN tm END AS good FROM s WHERE n = 1
UNION ALL SELECT s.user_id, s.event_id, s.n, y.run, y.clear, CASE WHEN s.score IS NULL THEN y.alarm WHEN NOT y.alarm AND y.run >= 3 THEN true WHEN y.alarm AND y.clear >= 2 THEN false ELSE y.alarm END, CASE WHEN s.score IS NULL THEN y.good ELSE s.tm END
FROM x JOIN s ON s.user_id = x.user_id AND s.n = x.n + 1, LATERAL (SELECT CASE WHEN s.score IS NULL THEN x.run WHEN s.score >= 0.9 THEN (CASE WHEN s.tm - x.good > 30 THEN 0 ELSE x.run END) + 1 ELSE 0 END AS run, CASE WHEN s.score IS NULL THEN x.clear WHEN s.score < 0.9 THEN (CASE WHEN s.tm - x.good > 30 THEN 0 ELSE x.clear END) + 1 ELSE 0 END AS clear, x.alarm AS alarm, x.good AS good) y)
SELECT user_id AS patient_id, event_id AS ann_idx, run AS af_run, clear AS clear_run, alarm FROM x""")
def alarm_state_machine(spark, sf):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").withColumn("n", F.row_number().over(order))
    s = e.select(F.col("user_id").alias("patient_id"), F.col("event_id").alias("ann_idx"), "n", ((F.col("n") - 1) * 15).cast("long").alias("sample"), F.when(F.col("event_type") != "error", F.least(F.col("value") / 40, F.lit(1.0))).alias("score"))
    return ordered.alarm_states(s, "patient_id", ["n"], 15, ["ann_idx"])


@query(f"WITH {SQL_A} SELECT patient_id, ann_idx, count(*) OVER (PARTITION BY patient_id ORDER BY sample RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW) AS n_recent FROM a")
def trailing_history(spark, sf):
    w = Window.partitionBy("patient_id").orderBy("sample").rangeBetween(-60_000, 0)
    return annotations(spark, sf).select("patient_id", "ann_idx", F.count("*").over(w).alias("n_recent"))


@query("""WITH e AS (SELECT user_id, (epoch_us(ts) // 1000000)::BIGINT AS t, value FROM events), w AS (SELECT user_id, value, unnest([t // 43200 * 43200, t // 43200 * 43200 - 43200]) AS w0, t FROM e)
SELECT user_id, w0 AS window_start, count(*) AS n, round(avg(value), 6) AS mean FROM w WHERE t < w0 + 86400 GROUP BY ALL""")
def sliding_window_counts(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.groupBy("user_id", F.window("ts", "24 hours", "12 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return out.select("user_id", F.unix_seconds("w.start").alias("window_start"), "n", "mean")


@query("""WITH e AS (SELECT user_id, (epoch_us(ts) // 1000000)::BIGINT AS t, epoch_us(ts) AS us FROM events), c AS (SELECT *, CASE WHEN us - lag(us) OVER w < 21600000000 THEN 0 ELSE 1 END AS ch FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)), s AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY us) AS sid FROM c)
SELECT user_id, min(t) AS session_start, count(*) AS n FROM s GROUP BY user_id, sid""")
def session_gaps(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.unix_seconds("w.start").alias("session_start"), "n")


@query("SELECT user_id, count(*) AS n, round((count(*) - 1) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6), 9) AS rate, CASE WHEN abs((count(*) - 1) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6) - 2.6e-5) / 2.6e-5 > 0.15 THEN 'fatal' WHEN abs((count(*) - 1) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6) - 2.6e-5) / 2.6e-5 > 0.05 THEN 'warn' ELSE 'ok' END AS verdict FROM events GROUP BY user_id")
def sample_rate_check(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    per = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), ((F.max(us) - F.min(us)) / 1e6).alias("s"))
    rate = F.try_divide(F.col("n") - 1, "s")
    off = F.abs(rate - 2.6e-5) / 2.6e-5
    return per.select("user_id", "n", F.round(rate, 9).alias("rate"), F.when(off > 0.15, "fatal").when(off > 0.05, "warn").otherwise("ok").alias("verdict"))


SQL_CM = "SELECT quality AS truth, toxic AS guess, doc_id FROM labels"


def _pairs(spark, sf):
    return table(spark, sf, "labels").select(F.col("quality").cast("int").alias("truth"), F.col("toxic").cast("int").alias("guess"), "doc_id")


@query(f"WITH p AS ({SQL_CM}), v(truth) AS (VALUES (0), (1)) SELECT v.truth, count(*) FILTER (guess = 0) AS guess_0, count(*) FILTER (guess = 1) AS guess_1 FROM v LEFT JOIN p USING (truth) GROUP BY v.truth")
def confusion_matrix(spark, sf):
    return metrics.confusion(_pairs(spark, sf), "truth", "guess", [0, 1]).select("truth", F.col("0").alias("guess_0"), F.col("1").alias("guess_1"))


@query(f"""WITH p AS ({SQL_CM}), l(label) AS (VALUES (0), (1)), c AS (SELECT label, count(*) FILTER (truth = label AND guess = label) AS tp, count(*) FILTER (guess = label) AS guessed, count(*) FILTER (truth = label) AS support FROM l, p GROUP BY label),
s AS (SELECT *, CASE WHEN guessed > 0 THEN tp / guessed ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM c), f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM s)
SELECT label, tp, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(sum(tp) OVER () / sum(support) OVER (), 6) AS accuracy, round(avg(f1) OVER (), 6) AS macro_f1 FROM f""")
def classification_report(spark, sf):
    return metrics.report(_pairs(spark, sf), "truth", "guess").select("label", "tp", "support", *r6("precision", "recall", "f1", "accuracy", "macro_f1"))


def _scores(spark, sf):
    e = table(spark, sf, "events")
    return e.select((F.col("event_type") == "error").cast("int").alias("y"), F.least(F.col("value") / 100.0, F.lit(1.0)).alias("score"))


SQL_SC = "sc AS (SELECT (event_type = 'error')::INT AS y, least(value / 100.0::DOUBLE, 1.0::DOUBLE) AS score FROM events)"


@query(f"WITH {SQL_SC}, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM sc), t AS (SELECT sum(rk) FILTER (y = 1) AS s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM r) SELECT round((s - p * (p + 1) / 2.0) / (p * n), 6) AS auc, p AS positives, n AS negatives FROM t")
def roc_auc(spark, sf):
    return metrics.roc_auc(_scores(spark, sf), "y", "score").withColumn("auc", F.round("auc", 6))


@query(f"""WITH {SQL_SC}, g(threshold) AS (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)), c AS (SELECT threshold, count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (score >= threshold AND y = 0) AS fp, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM g, sc GROUP BY threshold),
t AS (SELECT threshold, tp, fp, tp / p AS tpr, fp / n AS fpr FROM c)
SELECT threshold, round(tpr, 6) AS recall, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tpr + fpr > 0 THEN 0.02 * tpr / (0.02 * tpr + 0.98 * fpr) ELSE 0 END, 6) AS precision_rescaled FROM t""")
def threshold_table(spark, sf):
    return metrics.thresholds(_scores(spark, sf), "y", "score", [0.1, 0.2, 0.3, 0.5, 0.9], 0.02).select("threshold", *r6("recall", "precision", "precision_rescaled"))


@query("WITH p AS (SELECT event_type AS t, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events), q AS (SELECT * FROM p WHERE g IS NOT NULL), c AS (SELECT count(*) FILTER (t IN ('view', 'purchase')) AS abnormal, count(*) FILTER (t IN ('view', 'purchase') AND g IN ('view', 'purchase') AND t <> g) AS mixed_up, count(*) FILTER (t IN ('view', 'purchase') AND g = 'click') AS missed FROM q) SELECT *, round(mixed_up / abnormal, 6) AS mixed_share, round(missed / abnormal, 6) AS missed_share FROM c")
def error_split(spark, sf):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = table(spark, sf, "events").select(F.col("event_type").alias("t"), F.lead("event_type").over(order).alias("g")).where("g is not null")
    return metrics.error_split(p, "t", "g", "click", ("view", "purchase")).select("abnormal", "mixed_up", "missed", *r6("mixed_share", "missed_share"))


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def class_balance(spark, sf):
    per = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return per.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.col("label").alias("label"))


@query("""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), d AS (SELECT q.id AS query, b.id, b.label, round(list_sum(list_transform(list_zip(q.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS d FROM e q, e b WHERE q.id % 50 = 0 AND b.id <> q.id),
n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) AS rank FROM d QUALIFY rank <= 5), v AS (SELECT query, label, count(*) AS votes, min(rank) AS best FROM n GROUP BY ALL)
SELECT query, label AS predicted, votes FROM v QUALIFY row_number() OVER (PARTITION BY query ORDER BY votes DESC, best) = 1""")
def knn_embeddings(spark, sf):
    v = _vectors(spark, sf)
    return neighbours.nearest(v.where("id % 50 = 0"), v, 5)


@query("""WITH e AS (SELECT vec_id AS id, label, unnest(range(64)) AS f, embedding FROM embeddings), t AS (SELECT id, label, f, embedding[f + 1]::DOUBLE AS x FROM e), st AS (SELECT label, f, avg(x) AS m, var_pop(x) + 1e-9 AS v FROM t GROUP BY ALL), pr AS (SELECT label, ln(count(*) / sum(count(*)) OVER ()) AS prior FROM embeddings GROUP BY label),
s AS (SELECT t.id, st.label AS c, sum(-0.5 * ln(2 * pi() * v) - (x - m) * (x - m) / (2 * v)) AS ll FROM t JOIN st USING (f) GROUP BY ALL)
SELECT id, c AS predicted, round(ll + prior, 4) AS ll FROM s JOIN pr ON pr.label = s.c QUALIFY row_number() OVER (PARTITION BY id ORDER BY ll + prior DESC, c) = 1""")
def gaussian_nb(spark, sf):
    v = _vectors(spark, sf).select("id", "label", *[F.col("v")[i].alias(f"x{i}") for i in range(64)])
    return learning.gaussian_bayes(v, v, [f"x{i}" for i in range(64)], "label", "id").withColumn("ll", F.round("ll", 4))


def _sides(spark, sf):
    """Training windows with weights and test windows, by patients. Fits and predictions read the table again and again: it is written once."""
    path = _scratch(spark, "windows")
    _windows(spark, sf).select("patient_id", "wid", "label_id", "n_drr_used", *FEATURES).write.parquet(path)
    w = spark.read.parquet(path).where("n_drr_used >= 1").withColumn("label", F.element_at(F.array(F.lit("NSR"), F.lit("AFib"), F.lit("AFlutter")), F.col("label_id") + 1))
    split = cohort.group_split(w, 0.2, "patient_id")
    return learning.balanced_weights(cohort.capped(split.where("fold = 'train'"), 25, "patient_id", "wid"), "label"), split.where("fold = 'test'")


def _ml(kind):
    def run(spark, sf):
        weighted, test = _sides(spark, sf)
        if kind == "kernel_svm":
            found = kernel_svm.predict_kernel_svm(kernel_svm.fit_kernel_svm(weighted, list(FEATURES), "label", "weight"), test)
            return found.select("patient_id", "wid", "label", "predicted")
        if kind == "forest":
            found = forest.predict_forest(weighted, test, list(FEATURES), "label", "weight", ["patient_id", "wid"], _scratch(spark, "forest"))
            return found.select("patient_id", "wid", "label", "predicted")
        fitted = learning.fit(weighted, kind, list(FEATURES), "label", "weight")
        return learning.predict(fitted, test).select("patient_id", "wid", "label", "predicted")

    run.__name__ = f"{kind}_predictions"
    return run


for _kind in ("logistic", "forest", "tree", "bayes", "svm", "kernel_svm"):
    query()(_ml(_kind))

@query()
def bundle_predictions(spark, sf):
    """A model and the stage that makes its features, saved, loaded again, and given the raw annotations."""
    from cardiolake.operators.stages import from_annotations

    train, test = _sides(spark, sf)
    fitted = learning.fit(train, "bayes", list(FEATURES), "label", "weight")
    path = _scratch(spark, "bundle")
    learning.save_bundle(from_annotations(fitted, FS, WIDTH, list(ORDER)), path, list(FEATURES))
    loaded, _ = learning.load_bundle(spark, path, list(FEATURES))
    found = learning.predict(loaded, annotations(spark, sf)).select("patient_id", "wid", "predicted")
    return test.select("patient_id", "wid", "label").join(found, ["patient_id", "wid"])


_VALUES = f"unnest([{', '.join(FEATURES)}])::DOUBLE AS x, unnest(range({len(FEATURES)})) AS f"
#: Weights make all classes equal, so means of the classes' means stand for the weighted ones, and priors cancel.
ORACLE_SQL["bayes_predictions"] = f"""WITH {SQL_ALL}, used AS (SELECT *, ['NSR', 'AFib', 'AFlutter'][label_id + 1] AS label FROM wt WHERE n_drr_used >= 1), {SQL_SPLIT.replace("wt", "used")},
sided AS (SELECT used.*, fold FROM used JOIN sp USING (patient_id, wid)), few AS (SELECT patient_id, wid FROM sided WHERE fold = 'train' QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY md5(patient_id::VARCHAR || '|' || wid::VARCHAR)) <= 25),
tall AS (SELECT patient_id, wid, label, fold, {_VALUES} FROM sided), learnt AS (SELECT * FROM tall SEMI JOIN few USING (patient_id, wid)), scale AS (SELECT f, avg(x) AS mid, stddev_samp(x) AS dev FROM learnt GROUP BY f),
z AS (SELECT patient_id, wid, label, fold, f, CASE WHEN dev > 0 THEN (x - mid) / dev ELSE 0 END AS z FROM tall JOIN scale USING (f)),
per AS (SELECT label, f, avg(z) AS mu, var_pop(z) AS v, avg(z * z) AS square FROM z SEMI JOIN few USING (patient_id, wid) GROUP BY label, f), eps AS (SELECT max(v) * 1e-9 AS eps FROM (SELECT avg(square) - avg(mu) * avg(mu) AS v FROM per GROUP BY f)),
ll AS (SELECT patient_id, wid, z.label, per.label AS guess, sum(-0.5 * ln(v + eps) - (z - mu) * (z - mu) / (2 * (v + eps))) AS ll FROM z JOIN per USING (f), eps WHERE fold = 'test' GROUP BY ALL)
SELECT patient_id, wid, label, arg_max(guess, ll) AS predicted FROM ll GROUP BY patient_id, wid, label"""
ORACLE_SQL["bundle_predictions"] = ORACLE_SQL["bayes_predictions"]


@query()
def rbf_predictions(spark, sf):
    v = _vectors(spark, sf).withColumn("label", F.col("label").cast("string")).select("id", "label", *[F.col("v")[i].alias(f"x{i}") for i in range(64)])
    return kernel_svm.predict_kernel_svm(kernel_svm.fit_kernel_svm(v, [f"x{i}" for i in range(64)], "label"), v).select("id", "label", "predicted")


@query()
def bandpass_chunks(spark, sf):
    return _vectors(spark, sf).select("id", F.transform(dsp.bandpass_column(F.col("v"), 100.0), lambda x: F.round(x, 6)).alias("filtered"))


@query("""WITH t AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), m AS (SELECT id, avg(x) + stddev_pop(x) AS h FROM t GROUP BY id),
n AS (SELECT *, lag(x) OVER w AS p, lead(x) OVER w AS q FROM t WINDOW w AS (PARTITION BY id ORDER BY i)) SELECT n.id, i::INT AS pos FROM n JOIN m USING (id) WHERE x > p AND x > q AND x >= h""")
def peaks_height_only(spark, sf):
    t = _vectors(spark, sf).select("id", F.posexplode("v").alias("pos", "x"))
    w = Window.partitionBy("id").orderBy("pos")
    per = Window.partitionBy("id")
    n = t.withColumns({"p": F.lag("x").over(w), "q": F.lead("x").over(w), "h": F.avg("x").over(per) + F.stddev_pop("x").over(per)})
    return n.where("x > p and x > q and x >= h").select("id", "pos")


@query("""WITH v AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
h AS (SELECT id, avg(x) + stddev_pop(x) AS least FROM v GROUP BY id),
u AS (SELECT *, CASE WHEN x = lag(x) OVER (PARTITION BY id ORDER BY i) THEN 0 ELSE 1 END AS begins FROM v),
f AS (SELECT id, x, (min(i) + max(i)) // 2 AS pos, min(i) AS i FROM (SELECT *, sum(begins) OVER (PARTITION BY id ORDER BY i) AS flat FROM u) GROUP BY id, x, flat),
n AS (SELECT *, lag(x) OVER (PARTITION BY id ORDER BY i) AS p, lead(x) OVER (PARTITION BY id ORDER BY i) AS q FROM f),
c AS (SELECT id, list(pos ORDER BY x DESC, pos DESC) AS tops FROM n JOIN h USING (id) WHERE x > p AND x > q AND x >= least GROUP BY id),
k AS (SELECT id, list_sort(list_reduce(list_transform(tops, lambda t: [t]), lambda kept, t: CASE WHEN len(list_filter(kept, lambda a: abs(a - t[1]) < 8)) > 0 THEN kept ELSE list_append(kept, t[1]) END)) AS kept FROM c)
SELECT e.vec_id AS id, coalesce(len(kept), 0)::INT AS n, coalesce(array_to_string(kept, ','), '') AS peaks FROM embeddings e LEFT JOIN k ON k.id = e.vec_id""")
def peaks_chunks(spark, sf):
    found = _vectors(spark, sf).select("id", dsp.peaks_column(F.col("v"), 20.0).alias("at"))
    return found.select("id", F.size("at").alias("n"), F.array_join(F.col("at").cast("array<string>"), ",").alias("peaks"))


@query("""WITH t AS (SELECT vec_id AS record_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::BIGINT - 1 AS i FROM embeddings), b AS (SELECT vec_id AS record_id, unnest([vec_id % 64, (vec_id * 7 + 11) % 64, 70])::BIGINT AS sample FROM embeddings), d AS (SELECT DISTINCT * FROM b),
a AS (SELECT d.*, coalesce(x, 0) AS amplitude FROM d LEFT JOIN t ON t.record_id = d.record_id AND t.i = d.sample), w AS (SELECT a.record_id, a.sample, count(*) AS n, max(t.i) - min(t.i) AS far FROM a JOIN t ON t.record_id = a.record_id AND t.i >= a.sample - 10 AND t.i < a.sample + 10 AND abs(t.x) > abs(a.amplitude * 0.5) WHERE a.amplitude <> 0 GROUP BY ALL)
SELECT a.record_id, a.sample, round(amplitude, 6) AS amplitude, round(CASE WHEN n > 1 THEN far / 100.0::DOUBLE ELSE 0 END, 6) AS qrs_width FROM a LEFT JOIN w USING (record_id, sample)""")
def beat_waveform_features(spark, sf):
    v = _vectors(spark, sf).withColumnRenamed("id", "record_id")
    at = F.array(F.col("record_id") % 64, (F.col("record_id") * 7 + 11) % 64, F.lit(70).cast("long"))
    found = serving.waveform_features(v.select("record_id", F.explode(at).alias("sample")), v.select("record_id", F.col("v").alias("signal")), 100.0, filtered=False)
    return found.select("record_id", "sample", *r6("amplitude", "qrs_width"))


@query("""WITH t AS (SELECT vec_id AS record_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::BIGINT - 1 AS i FROM embeddings), m AS (SELECT vec_id AS record_id, (vec_id * 7) % 80 AS pos FROM embeddings)
SELECT m.record_id, pos, arg_max(i, x) AS shown, round(max(x), 6) AS shown_value FROM m JOIN t ON t.record_id = m.record_id AND i BETWEEN pos - 5 AND pos + 5 WHERE pos < 64 GROUP BY ALL""")
def markers_snapped(spark, sf):
    v = _vectors(spark, sf)
    trace = v.select(F.col("id").alias("record_id"), F.posexplode("v").alias("pos", "x")).withColumn("pos", F.col("pos").cast("long"))
    found = serving.snap_to_peak(v.select(F.col("id").alias("record_id"), (F.col("id") * 7 % 80).alias("pos")), trace, 5)
    return found.withColumn("shown_value", F.round("shown_value", 6))


@query("""WITH t AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::BIGINT - 1 AS i FROM embeddings), m AS (SELECT id, arg_max(i, x ORDER BY i) AS pos, max(x) AS top FROM t GROUP BY id),
w AS (SELECT id, count(*) AS n, max(i) - min(i) AS far FROM t JOIN m USING (id) WHERE top <> 0 AND i >= pos - 10 AND i < pos + 10 AND abs(x) > abs(top * 0.5) GROUP BY id)
SELECT id, round(CASE WHEN n > 1 THEN far / 100.0::DOUBLE ELSE 0 END, 6) AS qrs_width FROM m LEFT JOIN w USING (id)""")
def qrs_width_chunks(spark, sf):
    return _vectors(spark, sf).select("id", F.round(dsp.qrs_column(F.col("v"), 100.0), 6).alias("qrs_width"))


@query(f"WITH {SQL_ALL}, folded AS ({FOLDS}), s AS (SELECT wt.patient_id, label_id, fold FROM wt JOIN folded USING (patient_id)) SELECT fold, count(*) AS test_rows, count(DISTINCT patient_id) AS test_patients, count(*) FILTER (label_id = 0) AS n_0, count(*) FILTER (label_id = 1) AS n_1, count(*) FILTER (label_id = 2) AS n_2, ((SELECT count(*) FROM s) - count(*))::BIGINT AS train_rows FROM s GROUP BY fold")
def fold_preview(spark, sf):
    return cohort.fold_preview(_windows(spark, sf).select("patient_id", "label_id"), 5, "patient_id", "label_id", [0, 1, 2])


SQL_WALK = "row_number() OVER (PARTITION BY patient_id, segment ORDER BY sample, ann_idx) - 1 AS ann_idx"


def _annotation_files(spark, sf):
    """The events of each patient and day as one file's annotation bytes."""
    from cardiolake.sources.annotations import write_annotations

    return write_annotations(annotations(spark, sf), "patient_id", "segment")


@query(f"WITH {SQL_A} SELECT patient_id, segment, {SQL_WALK}, sample, code, note, max(sample) OVER (PARTITION BY patient_id, segment) AS last_sample FROM a")
def parse_annotations(spark, sf):
    """Events written as annotation bytes, a file for each patient and day, and walked again."""
    from cardiolake.sources.annotations import parse_annotations as parse

    return parse(_annotation_files(spark, sf), "content", "patient_id", "segment").select("patient_id", "segment", F.col("ann_idx").cast("long").alias("ann_idx"), "sample", "code", F.try_element_at("notes", F.lit(1)).alias("note"), "last_sample")


@query(f"WITH {SQL_A} SELECT patient_id, segment, {SQL_WALK}, sample, code, note, round(sample / 30000.0::DOUBLE, 6) AS seconds FROM a")
def annotations_lateral(spark, sf):
    """The same files walked by a table function in SQL."""
    from cardiolake.sources.annotations import register_walk

    register_walk(spark)
    return spark.sql("SELECT f.patient_id, f.segment, t.ann_idx, t.sample, t.code, t.note, round(t.seconds, 6) AS seconds FROM {files} f, LATERAL walk_annotations(f.content, 30000) t", files=_annotation_files(spark, sf))


LIVE_FS = 100.0
#: Lines of the longest gap between beats: ten of the beat, then the base line. A shorter gap has the first of them.
LONGEST_BEAT = "\n".join(str(512 + 90 * t if t < 5 else 512 + 90 * (10 - t) if t < 10 else 512 + t % 3) for t in range(120))


def event_lines(spark, sf):
    """Lines of devices: a user is a device, and an event a read of three beats, whose intervals hang on its number and value; some errors are lead-off marks."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("device_id"), (F.row_number().over(order) - 1).cast("long").alias("seq"), "event_type", F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)).alias("k"), F.coalesce("value", F.lit(0.0)).alias("value"))
    gap = lambda i: F.when(F.col("k") % 3 == 0, 60 + F.pmod(F.floor(F.col("value") * (7 + i)), F.lit(60))).otherwise(80 + F.pmod(F.col("k") + i, F.lit(5))).cast("int")
    beat = lambda i: F.left(F.lit(LONGEST_BEAT), 4 * gap(i) - 1)
    block = F.concat_ws("\n", beat(0), beat(1), beat(2))
    return e.select("device_id", "seq", F.when((F.col("event_type") == "error") & (F.col("k") % 16 == 0), "!").otherwise(block).alias("line"))


@query()
def stream_live_replay(spark, sf):
    """The devices of `events` through the stateful stream, in batches of their lines, read back from its sink."""
    from cardiolake.streaming.monitor import monitor_stream, read_lines

    path = _scratch(spark, "replay")
    event_lines(spark, sf).write.parquet(f"{path}/in")
    rows = monitor_stream(read_lines(spark, f"{path}/in"), LIVE_FS, ("rhythm", "alert", "error"))
    rows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("device_id", "kind", "sample_pos", "status", "af_run", "alarm", F.round("af_score", 4).alias("af_score"))


def _filter_sql(fs: float = 100.0) -> str:
    """The recursion of the filter, sample by sample: state z of four, y = b0 x + z1."""
    b, a = (list(map(float, c)) for c in dsp.bandpass_design(0.5, 40.0, fs))
    step = ", ".join(f"{b[i]!r}::DOUBLE * x - {a[i]!r}::DOUBLE * y" + (f" + z[{i + 1}]" if i < 4 else "") for i in range(1, 5))
    return f"""WITH RECURSIVE v AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS n, unnest(embedding)::DOUBLE AS x FROM embeddings),
f AS (SELECT vec_id, 0::BIGINT AS n, NULL::DOUBLE AS y, [0, 0, 0, 0]::DOUBLE[] AS z FROM embeddings UNION ALL
  SELECT vec_id, n, y, [{step}] FROM (SELECT v.vec_id, v.n, v.x, f.z, {b[0]!r}::DOUBLE * v.x + f.z[1] AS y FROM f JOIN v ON v.vec_id = f.vec_id AND v.n = f.n + 1))
SELECT vec_id::VARCHAR AS device_id, n AS sample, round(y, 6) AS filtered FROM f WHERE n > 0"""


@query(_filter_sql())
def causal_filter_stream(spark, sf):
    """Every embedding as a signal that arrives in blocks of 16 samples, filtered as a stream, read back from its sink."""
    from cardiolake.streaming.filters import filter_stream

    path = _scratch(spark, "filter")
    v = _vectors(spark, sf).select(F.col("id").cast("string").alias("device_id"), F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("v") - 1) / 16)), lambda i: F.struct(i.cast("long").alias("seq"), F.slice("v", (i * 16 + 1).cast("int"), 16).alias("samples")))).alias("b"))
    v.select("device_id", "b.*").write.parquet(f"{path}/in")
    rows = filter_stream(spark.readStream.schema("device_id string, seq long, samples array<double>").parquet(f"{path}/in"), 100.0)
    rows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{path}/out").select("device_id", "seq", F.posexplode("filtered").alias("pos", "y"))
    return out.select("device_id", (F.col("seq") * 16 + F.col("pos") + 1).alias("sample"), F.round("y", 6).alias("filtered"))


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<ul>(.*?)</ul>', 1)) AS body, generate_subscripts(regexp_extract_all(html, '<ul>(.*?)</ul>', 1), 1) - 1 AS n FROM pages),
c AS (SELECT page_id, n, list_transform(regexp_extract_all(body, '<li>(.*?)</li>', 1), lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g'))) AS cells FROM l)
SELECT page_id, n::INT AS "table", 0 AS "row", array_to_string(cells, ' | ') AS cells, len(cells)::INT AS n_cells FROM c WHERE len(cells) > 0""")
def page_list_rows(spark, sf):
    """The lists of all pages as rows of cells."""
    from cardiolake.sources.html import LISTS, html_rows

    rows = html_rows(table(spark, sf, "pages").select("page_id", "html"), "html", LISTS)
    return rows.select("page_id", "table", "row", F.array_join("cells", " | ").alias("cells"), F.size("cells").alias("n_cells"))


@query(f"""WITH RECURSIVE {SQL_A}, o AS (SELECT patient_id, ann_idx, code NOT IN (1, 13) AS abnormal, row_number() OVER (PARTITION BY patient_id ORDER BY sample, ann_idx) AS n FROM a WHERE code <> 28),
x AS (SELECT DISTINCT patient_id, 0::BIGINT AS ann_idx, 0::BIGINT AS n, []::INT[] AS labels, false AS alert FROM o UNION ALL
  SELECT patient_id, ann_idx, n, l, CASE WHEN alert THEN list_sum(l) > 2 ELSE list_sum(l) >= 5 END FROM (SELECT o.patient_id, o.ann_idx, o.n, x.alert, list_append(x.labels, abnormal::INT)[-10:] AS l FROM x JOIN o ON o.patient_id = x.patient_id AND o.n = x.n + 1))
SELECT patient_id, ann_idx, list_sum(labels)::INT AS n_abnormal, alert FROM x WHERE n > 0""")
def ectopy_alert(spark, sf):
    """The alert of ectopic beats with its hysteresis, behind every beat."""
    beats = annotations(spark, sf).where(is_beat(F.col("code"))).withColumn("abnormal", ~F.col("code").isin(1, 13))
    return ordered.ectopy_states(beats, "patient_id", list(ORDER), ["ann_idx"])


@query(f"WITH {SQL_ALL}, v AS (SELECT patient_id, sample // 600000 AS wid, round(avg(value), 4) AS amplitude, count(*) AS n_values FROM a WHERE code = 1 GROUP BY ALL HAVING count(*) >= 2) SELECT wt.patient_id, wt.wid, n_beats, amplitude, n_values FROM wt LEFT JOIN v USING (patient_id, wid)")
def windows_with_waveform(spark, sf):
    """Windows with the values of their normal beats, where there are two of them."""
    key = ("patient_id", "wid")
    normal = annotations(spark, sf).where("code = 1").withColumn("wid", F.floor(F.col("sample") / WIDTH).cast("long"))
    values = normal.groupBy(*key).agg(F.round(F.avg("value"), 4).alias("amplitude"), F.count("*").alias("n_values")).where("n_values >= 2")
    return serving.with_waveform(_windows(spark, sf), values, key).select(*key, "n_beats", "amplitude", "n_values")


@query(f"WITH {SQL_A}, b AS (SELECT patient_id, ann_idx, sample, CASE WHEN code = 1 THEN 'Normal' ELSE 'Abnormal' END AS label, CASE WHEN value < 60 THEN 'Normal' WHEN value < 90 THEN 'Abnormal' END AS predicted FROM a WHERE code <> 28) SELECT *, label = predicted AS correct FROM b WHERE sample < 600000")
def explorer_view(spark, sf):
    """What a view of each record's first window shows, with a rule on the value as the model."""
    beats = annotations(spark, sf).where(is_beat(F.col("code")))
    beats = beats.select("patient_id", "ann_idx", "sample", F.when(F.col("code") == 1, "Normal").otherwise("Abnormal").alias("label"), F.when(F.col("value") < 60, "Normal").when(F.col("value") < 90, "Abnormal").alias("predicted"))
    return serving.display_window(beats, WIDTH)


SQL_GATE = "CASE WHEN wid = 0 THEN 'warmup' WHEN n_q > 10 THEN 'leadoff' WHEN n_rr_used < 4 OR n_drr_used < 1 OR coalesce(n_rr_used * mean_rr / 20.0, 0) < 0.1 THEN 'low_quality' WHEN rmssd IS NULL OR hrv_sdnn IS NULL THEN 'not_finite' ELSE 'ok' END"


@query(f"WITH {SQL_ALL} SELECT patient_id, wid, {SQL_GATE} AS status FROM full_")
def serve_gates(spark, sf):
    w = _windows(spark, sf, floor=False).withColumn("warmup", F.col("wid") == 0).withColumn("leadoff", F.greatest(F.col("n_q") - 10, F.lit(0)))
    return w.select("patient_id", "wid", serving.gate(WIDTH / FS, 4, 0.1, ("rmssd", "hrv_sdnn")).alias("status"))


@query(f"WITH {SQL_ALL} SELECT patient_id, wid, CASE WHEN n_v > 8 THEN 'AF ALARM' WHEN n_sv > 6 THEN 'AF? ' || n_sv || '/3' WHEN cv_rr IS NULL THEN '--' WHEN cv_rr >= 0.5 THEN 'IRREGULAR' ELSE 'NSR' END AS verdict FROM full_")
def headline_verdict(spark, sf):
    run = F.when(F.col("n_sv") > 6, F.col("n_sv")).otherwise(0)
    return _windows(spark, sf, floor=False).select("patient_id", "wid", serving.headline(F.col("n_v") > 8, run, F.col("cv_rr")).alias("verdict"))


@query(f"WITH {SQL_A} SELECT patient_id, ann_idx, sum((code <> 1)::INT) OVER (PARTITION BY patient_id ORDER BY sample, ann_idx ROWS 9 PRECEDING)::BIGINT AS n_abnormal FROM a WHERE code <> 28")
def recent_abnormal_beats(spark, sf):
    beats = annotations(spark, sf).where(is_beat(F.col("code")))
    label = F.when(F.col("code") == 1, " Normal ").otherwise("V")
    return serving.recent_abnormal(beats, serving.is_abnormal(label), ("patient_id",), ORDER).select("patient_id", "ann_idx", "n_abnormal")


@query(f"WITH {SQL_A}, t AS (SELECT *, (sample - lag(sample) OVER w) / 30000.0::DOUBLE AS rr, (max(sample) OVER (PARTITION BY patient_id) - sample) / 30000.0::DOUBLE AS ago FROM a WHERE code <> 28 WINDOW w AS (PARTITION BY patient_id ORDER BY sample, ann_idx)) SELECT patient_id, ann_idx, round(ago, 6) AS seconds_ago, rr BETWEEN 0.24 AND 2.0 AS accepted, round(least(greatest(rr, 0.24), 2.0), 6) AS shown FROM t WHERE rr IS NOT NULL")
def tachogram_points(spark, sf):
    beats = annotations(spark, sf).where(is_beat(F.col("code")))
    return serving.tachogram(beats, FS, ("patient_id",), ORDER).select("patient_id", "ann_idx", *r6("seconds_ago"), "accepted", *r6("shown"))


@query("WITH s AS (SELECT user_id, quantile_cont(value, 0.01) AS p1, quantile_cont(value, 0.99) AS p99, min(value) AS low, max(value) AS high FROM events GROUP BY user_id) SELECT user_id, round(low, 6) AS low, round(high, 6) AS high, round(p1 - greatest((p99 - p1) * 0.1, 20), 6) AS bottom, round(p99 + greatest((p99 - p1) * 0.1, 20), 6) AS top FROM s")
def plot_limits(spark, sf):
    return serving.autoscale(table(spark, sf, "events"), ("user_id",), "value").select("user_id", *r6("low", "high", "bottom", "top"))


@query(f"WITH {SQL_A}, b AS (SELECT patient_id, CASE WHEN code = 1 THEN 'Normal' ELSE 'Abnormal' END AS t, CASE WHEN value < 20 THEN 'Normal' ELSE 'Abnormal' END AS g FROM a WHERE code <> 28) SELECT patient_id, count(*) AS beats, count(*) FILTER (g = 'Normal') AS normal, count(*) FILTER (g <> 'Normal') AS abnormal, round(avg((t = g)::INT), 6) AS match_rate FROM b GROUP BY patient_id")
def record_summary(spark, sf):
    named = lambda test: F.when(test, "Normal").otherwise("Abnormal")
    b = annotations(spark, sf).where(is_beat(F.col("code"))).select("patient_id", named(F.col("code") == 1).alias("t"), named(F.col("value") < 20).alias("g"))
    return serving.record_summary(b, ("patient_id",), "t", "g").withColumn("match_rate", F.round("match_rate", 6))


@query(f"""WITH {SQL_A}, t AS (SELECT DISTINCT patient_id, sample FROM a WHERE code = 1), d AS (SELECT DISTINCT patient_id, sample FROM a WHERE code = 5), m AS (SELECT t.patient_id, t.sample, arg_min(d.sample, abs(d.sample - t.sample) * 10000000 + d.sample) AS detected FROM t JOIN d ON t.patient_id = d.patient_id AND d.sample BETWEEN t.sample - 20000 AND t.sample + 20000 GROUP BY ALL)
SELECT t.patient_id, t.sample, detected FROM t LEFT JOIN m USING (patient_id, sample)""")
def beats_matched_in_tolerance(spark, sf):
    a = annotations(spark, sf)
    return serving.matched_beats(a.where("code = 1"), a.where("code = 5"), 20_000)


@query("SELECT c_mktsegment, o_orderpriority, count(*) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY ALL")
def join_inner(spark, sf):
    li = table(spark, sf, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ'1995-01-01 00:00:00'").select("l_orderkey", "l_extendedprice", "l_discount")
    joined = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey")).join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_left_outer(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def join_semi(spark, sf):
    big = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(big, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_anti(spark, sf):
    done = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return cohort.todo(table(spark, sf, "customer"), done, "c_custkey").select("c_custkey", "c_name")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def top_k_per_key(spark, sf):
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    return table(spark, sf, "orders").withColumn("n", rank).where("n <= 2").select("o_custkey", "o_orderkey", "o_totalprice")


@query("(SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def set_operations(spark, sf):
    both = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()
    return both.exceptAll(table(spark, sf, "nation").where("n_regionkey = 0").select("n_nationkey"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark, sf):
    o = table(spark, sf, "orders")
    c = [F.col("o_orderpriority"), F.col("o_orderstatus")]
    return o.groupingSets([c, c[:1], []], *c).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query(f"WITH {SQL_ALL} SELECT patient_id, wid, label_id, ['NSR', 'AFib', 'AFlutter'][label_id + 1] AS label, n_beats, n_rr_used, round((round_even(purity * 1e5, 0) / 1e5)::FLOAT::DOUBLE, 6) AS purity FROM wt")
def parts_consolidated(spark, sf):
    """The window table through its parts: a build that stops halfway, goes on with the patients that are missing, and becomes one table of unique keys."""
    parts, whole = _scratch(spark, "parts"), _scratch(spark, "windows")
    built = _windows(spark, sf).withColumn("segment", F.lit(0)).withColumn("ord", F.col("wid"))
    half = F.pmod(F.xxhash64("patient_id"), F.lit(8)) < 4
    sinks.write_parts(built.where(half), parts, 8)
    left = sinks.missing_patients(built.select("patient_id").distinct(), parts)
    sinks.write_parts(built.join(left, "patient_id", "left_semi"), parts, 8)
    sinks.consolidate(spark.read.parquet(parts), whole)
    return spark.read.parquet(whole).select("patient_id", "wid", F.col("label_id").cast("int").alias("label_id"), "label", "n_beats", "n_rr_used", F.round(F.col("purity").cast("double"), 6).alias("purity"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows_table(spark, sf_dir)

