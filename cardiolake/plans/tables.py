"""The driver's tables as recordings: events become annotations, beats and markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the projection: samples a second and samples a window.
FS, WIDTH = 30_000, 600_000
EPOCH = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patient_id, segment (day of month), sample, ann_idx, code, k, note of each event; a marker's note is its k modulo 4."""
    code = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 5).when(F.col("event_type") == "purchase", 8).when(F.col("event_type") == "error", 13).otherwise(28)
    k = F.get_json_object("props", "$.k").cast("int")
    note = F.element_at(F.array(F.lit("(N"), F.lit("(AFIB"), F.lit("(AFL"), F.lit(")")), F.pmod("k", F.lit(4)) + 1)
    sample = F.expr(f"timestampdiff(SECOND, {EPOCH}, ts)").cast("long")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("patient_id"), F.dayofmonth("ts").alias("segment"), sample.alias("sample"), F.col("event_id").alias("ann_idx"), code.alias("code"), k.alias("k"), "value")
    return rows.withColumn("note", F.when(F.col("code") == 28, note))


SQL_A = """a AS (
  SELECT user_id AS patient_id, day(ts)::INT AS segment, ((epoch_us(ts) - 1704067200000000) // 1000000)::BIGINT AS sample, event_id AS ann_idx,
    CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 5 WHEN 'purchase' THEN 8 WHEN 'error' THEN 13 ELSE 28 END AS code,
    (props->>'$.k')::INT AS k, value,
    CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'error') THEN ['(N', '(AFIB', '(AFL', ')'][(props->>'$.k')::INT % 4 + 1] END AS note
  FROM events)"""
SQL_SPANS = """mk AS (
  SELECT *, max(sample) OVER (PARTITION BY patient_id) AS last_sample,
    CASE WHEN note LIKE '(AFIB%' THEN 'AFib' WHEN note LIKE '(AFL%' THEN 'AFlutter' WHEN note LIKE '(N%' THEN 'NSR' END AS rhythm FROM a),
kp AS (SELECT *, lead(sample) OVER (PARTITION BY patient_id ORDER BY sample, ann_idx) AS nxt FROM mk WHERE rhythm IS NOT NULL OR note = ')'),
spans AS (SELECT patient_id, sample AS start_sample, coalesce(nxt, last_sample) AS end_sample, rhythm FROM kp WHERE rhythm IS NOT NULL)"""
SQL_RR = """bt AS (SELECT *, sample // 600000 AS wid FROM a WHERE code IN (1, 5, 8)),
r1 AS (SELECT *, sample - lag(sample) OVER w AS gap, (sample - lag(sample) OVER w) / 30000.0::DOUBLE AS rr FROM bt WINDOW w AS (PARTITION BY patient_id, wid ORDER BY sample, ann_idx)),
r2 AS (SELECT *, rr BETWEEN 0.24 AND 2.0 AS ok FROM r1),
r3 AS (SELECT *, CASE WHEN ok AND lag(ok) OVER w THEN rr - lag(rr) OVER w END AS drr FROM r2 WINDOW w AS (PARTITION BY patient_id, wid ORDER BY sample, ann_idx)),
bins AS (SELECT patient_id, wid, least(greatest(trunc((rr - 0.24::DOUBLE) / (2.0::DOUBLE - 0.24::DOUBLE) * 16)::INT, 0), 15) AS bin, count(*) AS n FROM r3 WHERE ok GROUP BY ALL),
ent AS (SELECT patient_id, wid, abs(-sum(p * log2(p))) AS h FROM (SELECT *, n / sum(n) OVER (PARTITION BY patient_id, wid) AS p FROM bins) GROUP BY ALL),
agg AS (
  SELECT patient_id, wid, count(*) FILTER (ok) AS n_rr_used, count(*) FILTER (NOT ok) AS n_rr_rejected, count(drr) AS n_drr_used,
    sum(gap) FILTER (ok) / (count(*) FILTER (ok) * 30000.0::DOUBLE) AS mean_rr, stddev_samp(rr) FILTER (ok) AS sdnn, sqrt(avg(drr * drr)) AS rmssd, avg((abs(drr) > 0.05)::INT) FILTER (drr IS NOT NULL) AS pnn50
  FROM r3 WHERE rr IS NOT NULL GROUP BY ALL),
feats AS (
  SELECT patient_id, wid, n_rr_used, n_rr_rejected, n_drr_used, mean_rr, 60.0 / mean_rr AS hr, CASE WHEN n_rr_used >= 2 THEN sdnn END AS hrv_sdnn, rmssd, pnn50,
    CASE WHEN n_rr_used >= 2 THEN sdnn / mean_rr END AS cv_rr, CASE WHEN n_rr_used >= 2 THEN h END AS rr_entropy
  FROM agg LEFT JOIN ent USING (patient_id, wid))"""
SQL_OVER = """cut AS (SELECT *, unnest(range(start_sample // 600000, (end_sample - 1) // 600000 + 1)) AS wid FROM spans WHERE end_sample > start_sample),
ov AS (SELECT patient_id, wid, rhythm, least(end_sample, (wid + 1) * 600000) - greatest(start_sample, wid * 600000) AS c FROM cut),
covered AS (SELECT patient_id, wid, sum(CASE WHEN rhythm = 'NSR' THEN c ELSE 0 END) AS nsr, sum(CASE WHEN rhythm = 'AFib' THEN c ELSE 0 END) AS afib, sum(CASE WHEN rhythm = 'AFlutter' THEN c ELSE 0 END) AS afl FROM ov GROUP BY ALL),
len AS (SELECT patient_id, max(sample) + 1 AS length FROM a GROUP BY ALL),
grid AS (SELECT patient_id, unnest(range(0, CASE WHEN length >= 600000 THEN (length - 600000) // 600000 + 1 ELSE 0 END)) AS wid FROM len),
f AS (SELECT g.patient_id, g.wid, coalesce(nsr, 0) / 600000.0::DOUBLE AS frac_nsr, coalesce(afib, 0) / 600000.0::DOUBLE AS frac_afib, coalesce(afl, 0) / 600000.0::DOUBLE AS frac_aflutter FROM grid g LEFT JOIN covered c ON g.patient_id = c.patient_id AND g.wid = c.wid),
l AS (SELECT *, frac_nsr + frac_afib + frac_aflutter AS frac_sum, greatest(frac_nsr, frac_afib, frac_aflutter) AS frac_winner FROM f),
labels_ AS (SELECT *, least(greatest(frac_sum, 0), 1) AS frac_covered, CASE WHEN frac_nsr = frac_winner THEN 0 WHEN frac_afib = frac_winner THEN 1 ELSE 2 END AS label_id,
  CASE WHEN frac_sum > 0 THEN frac_winner / least(frac_sum, 1) ELSE 0 END AS purity FROM l)"""
SQL_TABLE = """cnt AS (SELECT patient_id, sample // 600000 AS wid, count(*) FILTER (code IN (1, 5, 8, 13)) AS n_beats, count(*) FILTER (code = 13) AS n_q, count(*) FILTER (code = 5) AS n_v, count(*) FILTER (code = 8) AS n_sv FROM a GROUP BY ALL),
full_ AS (
  SELECT l.*, coalesce(n_beats, 0) AS n_beats, coalesce(n_q, 0) AS n_q, coalesce(n_v, 0) AS n_v, coalesce(n_sv, 0) AS n_sv, CASE WHEN n_beats > 0 THEN n_q / n_beats ELSE 0 END AS q_frac,
    coalesce(n_rr_used, 0) AS n_rr_used, coalesce(n_rr_rejected, 0) AS n_rr_rejected, coalesce(n_drr_used, 0) AS n_drr_used, mean_rr, hr, hrv_sdnn, rmssd, pnn50, cv_rr, rr_entropy
  FROM labels_ l LEFT JOIN cnt USING (patient_id, wid) LEFT JOIN feats USING (patient_id, wid)),
wt AS (SELECT * FROM full_ WHERE frac_covered > 0 AND n_rr_used >= 2)"""
SQL_ALL = ", ".join([SQL_A, SQL_SPANS, SQL_RR, SQL_OVER, SQL_TABLE])
