"""A saved model that begins with annotations."""

from pyspark.sql import functions as F

from cardiolake.operators import learning
from cardiolake.operators.rr import FEATURES, intervals, window_features
from cardiolake.operators.stages import from_annotations
from cardiolake.plans.queries import ORDER
from cardiolake.plans.tables import FS, WIDTH, annotations

SF = "/root/testdata/sf0.001"


def test_loaded_bundle_scores_annotations(spark, tmp_path):
    raw = annotations(spark, SF)
    features = window_features(intervals(raw, FS, WIDTH, order=ORDER)).where("n_drr_used >= 1").withColumn("label", F.when(F.pmod("wid", F.lit(2)) == 0, "even").otherwise("odd"))
    for kind in ("tree", "logistic"):
        fitted = learning.fit(features, kind, list(FEATURES), "label")
        learning.save_bundle(from_annotations(fitted, FS, WIDTH, list(ORDER)), f"{tmp_path}/{kind}", list(FEATURES))
        loaded, about = learning.load_bundle(spark, f"{tmp_path}/{kind}", list(FEATURES))
        assert about["labels"] == ["even", "odd"]
        key = lambda frame: sorted((r["patient_id"], r["wid"], r["predicted"]) for r in frame.collect())
        assert key(learning.predict(loaded, raw)) == key(learning.predict(fitted, features)) and features.count() > 10
        assert learning.predict(loaded, raw.where("false")).count() == 0
