"""Writers that can go on after an interruption, and the expressions behind the displays."""

import json

import pytest
from pyspark.sql import functions as F

from cardiolake.operators import learning, serving
from cardiolake.sources import sinks


@pytest.fixture
def table(spark):
    return spark.range(40).select((F.col("id") % 8).alias("patient_id"), F.lit(1).alias("segment"), F.col("id").alias("wid"), (F.col("id") % 3).cast("int").alias("label_id"), (F.col("id") / 7.0).alias("mean_rr"), F.col("id").alias("ord"))


def test_parts(spark, tmp_path, table):
    path = f"{tmp_path}/parts"
    sinks.write_parts(table.where("patient_id < 4"), path, 4)
    assert sinks.missing_patients(table.select("patient_id").distinct(), path).count() == 4
    sinks.write_parts(table.where("patient_id >= 4").unionByName(table.where("patient_id < 4")), path, 4)
    sinks.write_parts(table, path, 4)
    back = spark.read.parquet(path)
    assert back.count() == 40 and dict(back.dtypes)["mean_rr"] == "float" and dict(back.dtypes)["label_id"] == "tinyint"
    sinks.consolidate(back.unionByName(back.withColumn("ord", F.col("ord") + 100)), f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    assert one.count() == 40 and one.agg(F.min("ord")).first()[0] == 100 and one.where("label_id = 1").select("label").distinct().first()[0] == "AFib"


def test_logs_and_reports(spark, tmp_path, table):
    sinks.append_log(table.limit(2), f"{tmp_path}/log")
    sinks.append_log(table.limit(3), f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 5
    sinks.write_summary({"classes": table.groupBy("label_id").count()}, f"{tmp_path}/summary", width=60)
    body = json.loads(spark.read.text(f"{tmp_path}/summary").first()[0])
    assert body["settings"]["width"] == 60 and len(body["classes"]) == 3
    sinks.write_selection(table.groupBy("patient_id").agg(F.sum("wid").alias("burden")), f"{tmp_path}/chosen")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/chosen").collect()] == [str(i) for i in range(7, -1, -1)]
    sinks.write_sealed(table.withColumn("bucket", F.col("patient_id") % 2), spark.createDataFrame([(1,)], "bucket long"), f"{tmp_path}/sealed", "bucket")
    assert spark.read.parquet(f"{tmp_path}/sealed").count() == 20
    sinks.write_csv(table.limit(1).withColumn("x", F.lit(None).cast("int")), f"{tmp_path}/csv")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/csv").columns[-1] == "x"
    counts = spark.createDataFrame([("100", "N", 5), ("100", "V", 0)], "record_id string, kind string, total int")
    assert sinks.text_table(counts, "record_id", "kind", ["N", "V"]).first()[0] == "100\t5\t-"


def test_headline(spark):
    rows = spark.createDataFrame([(True, 3, 0.9), (False, 2, 0.9), (False, 0, None), (False, 0, 0.6), (False, 0, 0.1)], "a boolean, r int, s double")
    assert [r[0] for r in rows.select(serving.headline(F.col("a"), F.col("r"), F.col("s"))).collect()] == ["AF ALARM", "AF? 2/3", "--", "IRREGULAR", "NSR"]


def test_matching(spark):
    truth = spark.createDataFrame([("p", 100), ("p", 200), ("p", 400)], "patient_id string, sample long")
    found = spark.createDataFrame([("p", 103), ("p", 97), ("p", 205), ("p", 300)], "patient_id string, sample long")
    assert sorted(tuple(r)[1:] for r in serving.matched_beats(truth, found, 5).collect()) == [(100, 97), (200, 205), (400, None)]


def test_models(spark):
    rows = spark.range(120).select("id", F.when(F.col("id") % 2 == 0, "AFib").otherwise("NSR").alias("label"), (F.col("id") % 2 + F.col("id") / 1_000).alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    got = learning.compare(rows, rows, ["tree", "bayes"], ["x", "y"], "label")
    assert got[0]["macro_f1"] == pytest.approx(1.0)
    fitted = learning.fit(rows, "tree", ["x", "y"], "label")
    assert learning.importances(fitted, ["x", "y"])[0][0] == "x"
    best = learning.predict(fitted, rows).select(learning.af_score(F.col("probabilities")).alias("s"), "label").where("label = 'AFib'").agg(F.min("s")).first()[0]
    assert best == pytest.approx(1.0)
    assert {r["weight"] for r in learning.balanced_weights(rows, "label").collect()} == {1.0}
