"""Classifiers: weights, scaling, models and comparison, on Spark ML; neighbours and naive Bayes as queries."""

from __future__ import annotations

import json
import time

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardiolake.operators.metrics import report


#: Rows that a task of a fit is worth.
ROWS_A_TASK = 20_000


def balanced_weights(rows: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """rows with weight n / (k * n_class)."""
    per = rows.groupBy(label).agg(F.count("*").alias("__n"))
    sums = per.select(label, (F.sum("__n").over(Window.partitionBy()) / (F.count("*").over(Window.partitionBy()) * F.col("__n"))).alias(name))
    return rows.join(sums, label)


def model(kind: str, label: str = "label_index", features: str = "features", weight: str | None = None, trees: int = 100):
    common = {"labelCol": label, "featuresCol": features} | ({"weightCol": weight} if weight else {})
    if kind == "logistic":
        return LogisticRegression(maxIter=1_000, regParam=0.001, family="multinomial", **common)
    if kind == "forest":
        return RandomForestClassifier(numTrees=trees, maxDepth=30, maxMemoryInMB=1024, seed=42, **common)
    if kind == "tree":
        return DecisionTreeClassifier(maxDepth=30, seed=42, **common)
    if kind == "bayes":
        return NaiveBayes(modelType="gaussian", **common)
    if kind == "svm":
        return OneVsRest(classifier=LinearSVC(regParam=0.01), parallelism=4, **common)
    raise ValueError(kind)


def fit(rows: DataFrame, kind: str, columns: list[str], label: str, weight: str | None = None, trees: int = 100) -> PipelineModel:
    """Indexer in alphabetical order, assembler in the order of columns, scaler, classifier."""
    stages = [
        StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="skip"),
        VectorAssembler(inputCols=columns, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        model(kind, weight=weight, trees=trees),
    ]
    # the fits pass over the rows again and again, in as few tasks as the rows are worth
    held = rows.select(*dict.fromkeys([*columns, label, *([weight] if weight else [])])).persist()
    parts = max(1, -(-held.count() // ROWS_A_TASK))
    fitted = Pipeline(stages=stages).fit(held.coalesce(parts))
    held.unpersist()
    return fitted


def labels_of(fitted: PipelineModel) -> list[str]:
    """The names of the classes, wherever the stage that numbers them stands."""
    return list(next(s for s in fitted.stages if isinstance(s, StringIndexerModel)).labels)


def predict(fitted: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows (or what the model's first stage makes of them) with predicted label and, where the model has them, probabilities by class name."""
    labels = labels_of(fitted)
    out = fitted.transform(rows)
    names = F.array(*[F.lit(x) for x in labels])
    out = out.withColumn("predicted", F.element_at(names, F.col("prediction").cast("int") + 1))
    if "probability" in out.columns:
        p = vector_to_array("probability")
        out = out.withColumn("probabilities", F.map_from_arrays(names, p))
    return out


def af_score(probabilities: Column) -> Column:
    return F.coalesce(probabilities["AFib"], F.lit(0.0)) + F.coalesce(probabilities["AFlutter"], F.lit(0.0))


def importances(fitted: PipelineModel, columns: list[str]) -> list[tuple[str, float]]:
    """Importance of each feature of a tree model, greatest first."""
    return sorted(zip(columns, map(float, fitted.stages[-1].featureImportances.toArray()), strict=True), key=lambda x: (-x[1], x[0]))


def save_bundle(fitted: PipelineModel, path: str, columns: list[str], **about) -> None:
    """The fitted stages and, beside them, what a scorer must know: feature columns in order, class names, and more as given."""
    fitted.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    body = json.dumps({"columns": columns, "labels": labels_of(fitted), **about})
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_bundle(spark: SparkSession, path: str, columns: list[str] | None = None) -> tuple[PipelineModel, dict]:
    """The model and what was said of it; other columns than those asked for, or in another order, are an error."""
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    if columns is not None and list(columns) != about["columns"]:
        raise ValueError(f"the model was fitted on {about['columns']}")
    return PipelineModel.load(f"{path}/model"), about


def refit_best(results: list[dict], rows: DataFrame, columns: list[str], label: str, path: str, weight: str | None = None) -> PipelineModel:
    """The best model of `compare`, fitted again on all training rows and saved with its scores."""
    best = results[0]
    fitted = fit(rows, best["model"], columns, label, weight)
    save_bundle(fitted, path, columns, **{k: best[k] for k in ("model", "accuracy", "macro_f1")})
    return fitted


def compare(train: DataFrame, test: DataFrame, kinds: list[str], columns: list[str], label: str) -> list[dict]:
    """Accuracy, macro F1 and seconds of each model, best first."""
    out = []
    for kind in kinds:
        began = time.time()
        r = report(predict(fit(train, kind, columns, label), test), label, "predicted").select("accuracy", "macro_f1").first()
        out.append({"model": kind, "accuracy": r["accuracy"], "macro_f1": r["macro_f1"], "seconds": time.time() - began})
    return sorted(out, key=lambda x: (-x["macro_f1"], x["model"]))


def gaussian_bayes(train: DataFrame, test: DataFrame, features: list[str], label: str, key: str, smoothing: float = 1e-9) -> DataFrame:
    """Naive Bayes with normal densities as two aggregations: predicted label and log-likelihood for each key."""
    tall = lambda rows: rows.select(key, label, F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("x")) for i, c in enumerate(features)])).alias("e")).select(key, label, "e.*")
    stats = tall(train).groupBy(label, "f").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    prior = train.groupBy(label).agg(F.count("*").alias("n"))
    prior = prior.select(F.col(label).alias("c"), F.log(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("prior"))
    v = F.col("v") + smoothing
    term = -0.5 * F.log(2 * float(np.pi) * v) - (F.col("x") - F.col("m")) * (F.col("x") - F.col("m")) / (2 * v)
    scored = tall(test).select(key, "f", "x").join(F.broadcast(stats.select(F.col(label).alias("c"), "f", "m", "v")), "f").groupBy(key, "c").agg(F.sum(term).alias("ll"))
    joined = scored.join(F.broadcast(prior), "c").withColumn("ll", F.col("ll") + F.col("prior"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("ll").desc(), "c"))
    return joined.withColumn("n", rank).where("n = 1").select(key, F.col("c").alias("predicted"), "ll")


__all__ = ["af_score", "array_to_vector", "balanced_weights", "compare", "fit", "gaussian_bayes", "importances", "load_bundle", "predict", "refit_best", "save_bundle"]
