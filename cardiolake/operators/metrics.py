"""Classification metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges of scores in which running sums are taken apart.
RANGES = 200


def confusion(rows: DataFrame, truth: str, guess: str, labels: list) -> DataFrame:
    """A row for each true label, a column for each guess, zeros kept."""
    base = rows.sparkSession.createDataFrame([(x,) for x in labels], f"{truth} {dict(rows.dtypes)[truth]}")
    counts = rows.groupBy(truth).pivot(guess, labels).count()
    return base.join(counts, truth, "left").fillna(0)


def _zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def report(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """precision, recall, f1 and support of each label, with accuracy and macro F1 of all; undefined ratios are 0."""
    hit = F.col(truth) == F.col(guess)
    tall = rows.select(F.explode(F.array_distinct(F.array(truth, guess))).alias("__label"), F.col(truth).alias("__truth"), F.col(guess).alias("__guess"), hit.alias("hit"))
    guessed, true = F.col("__guess") == F.col("__label"), F.col("__truth") == F.col("__label")
    per = tall.groupBy(F.col("__label").alias("label")).agg(F.count_if("hit").alias("tp"), F.count_if(guessed).alias("guessed"), F.count_if(true).alias("support"))
    precision, recall = _zero(F.col("tp"), F.col("guessed")), _zero(F.col("tp"), F.col("support"))
    scored = per.withColumns({"precision": precision, "recall": recall}).withColumn("f1", _zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    every = Window.partitionBy()
    return scored.withColumns({"accuracy": F.sum("tp").over(every) / F.sum("support").over(every), "macro_f1": F.avg("f1").over(every)})


def roc_auc(rows: DataFrame, positive: str, score: str) -> DataFrame:
    """Area under the curve from sums by distinct score: ties count half.

    The running sum is over scores, not rows, and inside ranges of scores only: what lies below a range is added to it
    from the sums of the ranges. The result is the same for any ranges.
    """
    per = rows.where(F.col(score).isNotNull()).groupBy(score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum(1 - F.col(positive).cast("long")).alias("n"))
    cuts = sorted(set(per.approxQuantile(score, [i / RANGES for i in range(1, RANGES)], 0.5 / RANGES)))
    per = per.withColumn("range", F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(score))) if cuts else F.lit(0))
    ranges = per.groupBy("range").agg(F.sum("n").alias("rn"))
    ranges = ranges.select("range", (F.sum("rn").over(Window.orderBy("range")) - F.col("rn")).alias("lower"))
    below = F.sum("n").over(Window.partitionBy("range").orderBy(score)) - F.col("n")
    wins = per.withColumn("below", below).join(F.broadcast(ranges), "range").withColumn("wins", F.col("p") * (F.col("lower") + F.col("below") + F.col("n") / 2.0))
    return wins.agg(F.try_divide(F.sum("wins"), F.sum("p") * F.sum("n").cast("double")).alias("auc"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))


def thresholds(rows: DataFrame, positive: str, score: str, grid: list[float], prevalence: float) -> DataFrame:
    """Recall, precision, and precision at another prevalence, for each threshold, in one pass."""
    at = F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("threshold")
    alarm, truth = F.col(score) >= F.col("threshold"), F.col(positive).cast("int") == 1
    per = rows.select(positive, score, at).groupBy("threshold").agg(F.count_if(alarm & truth).alias("tp"), F.count_if(alarm & ~truth).alias("fp"), F.count_if(truth).alias("p"), F.count_if(~truth).alias("n"))
    tpr, fpr = _zero(F.col("tp"), F.col("p")), _zero(F.col("fp"), F.col("n"))
    return per.select("threshold", tpr.alias("recall"), _zero(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _zero(prevalence * tpr, prevalence * tpr + (1 - prevalence) * fpr).alias("precision_rescaled"))


def error_split(rows: DataFrame, truth: str, guess: str, normal: str, kinds: tuple[str, str]) -> DataFrame:
    """Of the abnormal rows: taken for the other kind, and missed as normal."""
    abnormal = F.col(truth).isin(*kinds)
    mixed = abnormal & F.col(guess).isin(*kinds) & (F.col(truth) != F.col(guess))
    missed = abnormal & (F.col(guess) == normal)
    sums = rows.agg(F.count_if(abnormal).alias("abnormal"), F.count_if(mixed).alias("mixed_up"), F.count_if(missed).alias("missed"))
    return sums.withColumn("mixed_share", _zero(F.col("mixed_up"), F.col("abnormal"))).withColumn("missed_share", _zero(F.col("missed"), F.col("abnormal")))
