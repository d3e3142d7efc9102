"""Selection of patients, segments and training rows."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_order(*columns: str) -> Column:
    """A pseudo-random order that every engine and rerun shares: md5 over the columns."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).cast("binary"))


def select_patients(index: DataFrame, top: int, patient: str = "patient_id") -> DataFrame:
    """The `top` patients: those with AF or flutter by onsets, filled up with the others; ties by id."""
    per = index.groupBy(patient).agg(F.sum(F.col("afib_n") + F.col("afl_n")).alias("burden"), F.sum("nsr_n").alias("nsr_n"))
    order = [(F.col("burden") > 0).desc(), F.col("burden").desc(), F.col("nsr_n").desc(), F.col(patient)]
    return per.orderBy(*order).limit(top)


def choose_segments(index: DataFrame, most: int = 10, nsr: int = 5, patient: str = "patient_id", segment: str = "segment") -> DataFrame:
    """Per patient the abnormal segments of longest AF and flutter, and some normal ones by number.

    Normal ones: as many as abnormal ones (one at least), `nsr` at most, within what is left of `most`.
    """
    abnormal = F.col("afib_samp") + F.col("afl_samp")
    by_burden = Window.partitionBy(patient).orderBy((abnormal > 0).desc(), abnormal.desc(), segment)
    rows = index.withColumn("abnormal", abnormal).withColumn("rank", F.row_number().over(by_burden))
    rows = rows.withColumn("pool", F.when(F.col("abnormal") > 0, "abnormal").when(F.col("nsr_samp") > 0, "nsr"))
    in_pool = Window.partitionBy(patient, "pool").orderBy(F.when(F.col("pool") == "abnormal", F.col("rank")).otherwise(F.col(segment)))
    rows = rows.where("pool is not null").withColumn("nth", F.row_number().over(in_pool))
    n_ab = F.least(F.count_if(F.col("pool") == "abnormal").over(Window.partitionBy(patient)), F.lit(most))
    rows = rows.withColumn("n_ab", n_ab)
    quota = F.least(F.greatest("n_ab", F.lit(1)), F.lit(nsr), F.lit(most) - F.col("n_ab"))
    kept = F.when(F.col("pool") == "abnormal", F.col("nth") <= most).otherwise(F.col("nth") <= quota)
    return rows.where(kept).select(patient, segment, "pool", "nth")


def capped(rows: DataFrame, most: int, patient: str, *unique: str) -> DataFrame:
    """At most `most` rows of each patient, in the stable order."""
    rank = F.row_number().over(Window.partitionBy(patient).orderBy(stable_order(patient, *unique)))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")


def first_share(keys: DataFrame, share: float, order: Column, by: list[str], ties: list[str]) -> DataFrame:
    """keys with __first: whether the row is among the first `share` (rounded up) of its `by` group in the given order, an md5.

    Counts by the order's first three digits tell which rows are in without ranking: only ranks inside one of the
    4096 parts are needed, so no task sees all rows of a group.
    """
    part = [*by, "__part"]
    parts = keys.withColumn("__order", order).withColumn("__part", F.substring("__order", 1, 3))
    upto, every = Window.partitionBy(*by).orderBy("__part"), Window.partitionBy(*by)
    counts = parts.groupBy(*part).agg(F.count("*").alias("__n")).select(*part, (F.sum("__n").over(upto) - F.col("__n")).alias("__before"), F.ceil(F.sum("__n").over(every) * share).alias("__wanted"))
    rank = F.row_number().over(Window.partitionBy(*part).orderBy("__order", *ties))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in part]
    ranked = parts.withColumn("__rank", rank).alias("a").join(counts.alias("b"), same)
    return ranked.select(*[F.col(f"a.{c}") for c in keys.columns], (F.col("__before") + F.col("__rank") <= F.col("__wanted")).alias("__first"))


def group_split(rows: DataFrame, share: float, patient: str) -> DataFrame:
    """rows with fold 'test' for a share of the patients (rounded up), 'train' for the others: whole patients only."""
    ranked = first_share(rows.select(patient).distinct(), share, stable_order(patient), [], [patient])
    return rows.join(ranked.select(patient, F.when(F.col("__first"), "test").otherwise("train").alias("fold")), patient)


def stratified_split(rows: DataFrame, share: float, label: str, *unique: str) -> DataFrame:
    """rows with fold: of each class a share (rounded up) is 'test', in the stable order."""
    ranked = first_share(rows, share, stable_order(*unique), [label], list(unique))
    return ranked.withColumn("fold", F.when(F.col("__first"), "test").otherwise("train")).drop("__first")


def leaks(rows: DataFrame, patient: str) -> DataFrame:
    """Patients on both sides of a split; must be empty."""
    return rows.where("fold = 'train'").select(patient).intersect(rows.where("fold = 'test'").select(patient))


#: Different class vectors that one task deals to folds.
VECTORS = 20_000


def deal(vectors: list[tuple[tuple[int, ...], int]], totals: list[int], folds: int) -> tuple[list[list[int]], list[list[int]]]:
    """For each class vector with its number of patients, the folds of those beyond whole rounds; and the folds' sums of these.

    The most uneven vectors come first. A patient goes to the fold where the spread of the classes' shares over the folds
    grows least: the sum over the classes of (rows there) * (own rows) / (all rows) ** 2 is least; then to that with fewer rows.
    """
    state, out = [[0] * len(totals) for _ in range(folds)], []
    squares = [t * t for t in totals]
    for v, n in vectors:
        extra = []
        for _ in range(n % folds):
            cost = lambda f: (sum(float(state[f][c] * v[c]) / squares[c] for c in range(len(v)) if squares[c]), sum(state[f]), f)
            f = min(range(folds), key=cost)
            state[f] = [x + y for x, y in zip(state[f], v)]
            extra.append(f)
        out.append(extra)
    return out, state


def group_folds(rows: DataFrame, folds: int, patient: str, label: str) -> DataFrame:
    """A fold (0 .. folds-1) for each patient, with its rows: whole patients, classes spread as evenly as greedy dealing gets them.

    Patients with the same number of rows of each class are one vector with a count: of them, as many whole rounds as
    there are go one to each fold, which leaves the spread as it is, and `deal` places the rest. Vectors are dealt in
    buckets of about VECTORS; where there are several, the heaviest fold of a bucket joins the lightest so far. Among
    patients of one vector the stable order decides. Rows without a label count as none of the classes.
    """
    labels = sorted(r[0] for r in rows.select(label).dropna().distinct().collect())  # classes are few
    vector = F.array(*[F.count_if(F.col(label) == x) for x in labels]) if labels else F.array().cast("array<long>")
    per = rows.groupBy(patient).agg(F.count("*").alias("rows"), vector.alias("v")).persist()
    counts = per.groupBy("v").agg(F.count("*").alias("n"))
    facts = counts.agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i] * F.col("n")).alias(f"t{i}") for i in range(len(labels))]).first()
    totals = [facts[f"t{i}"] or 0 for i in range(len(labels))]
    buckets = max(1, -(-facts["n"] // VECTORS))

    def dealt(frame: pd.DataFrame) -> pd.DataFrame:
        pairs = sorted(((tuple(map(int, v)), int(n)) for v, n in zip(frame["v"], frame["n"])), key=lambda p: (-(len(p[0]) * sum(x * x for x in p[0]) - sum(p[0]) ** 2), [-x for x in p[0]]))
        extra, state = deal(pairs, totals, folds)
        sums = [json.dumps(state)] + [None] * (len(pairs) - 1)
        return pd.DataFrame({"bucket": frame["bucket"].iloc[0], "v": [list(v) for v, _ in pairs], "n": [n for _, n in pairs], "extra": extra, "sums": sums})

    bucket = F.pmod(F.xxhash64("v"), F.lit(buckets)).cast("int")
    placed = counts.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(dealt, "bucket int, v array<long>, n long, extra array<int>, sums string").persist()
    state, turns = [[0] * len(totals) for _ in range(folds)], []
    share = lambda sums: sum(x / t for x, t in zip(sums, totals) if t)
    for number, text in sorted(placed.where("sums is not null").select("bucket", "sums").collect()):  # folds times classes a bucket
        own = json.loads(text)
        turn = dict(zip(sorted(range(folds), key=lambda f: -share(own[f])), sorted(range(folds), key=lambda f: (share(state[f]), f)))) if number and turns else {f: f for f in range(folds)}
        for f, g in turn.items():
            state[g] = [x + y for x, y in zip(state[g], own[f])]
        turns.append((number, [turn[f] for f in range(folds)]))
    moves = rows.sparkSession.createDataFrame(turns, "bucket int, turn array<int>")
    ranked = ranks(per.withColumn("__order", stable_order(patient)), ["v"], [patient])
    whole = F.floor(F.col("n") / folds) * folds
    first = F.when(F.col("__rank") < whole, F.pmod("__rank", F.lit(folds))).otherwise(F.try_element_at("extra", (F.col("__rank") - whole + 1).cast("int"))).cast("int")
    joined = ranked.join(placed.drop("sums"), "v").join(F.broadcast(moves), "bucket")
    return joined.select(patient, "rows", F.element_at("turn", first + 1).alias("fold"))


def ranks(rows: DataFrame, by: list[str], ties: list[str]) -> DataFrame:
    """rows with __rank (from 0) by __order, an md5, inside each `by` group; parts of a group are ranked apart and counted together."""
    part = [*by, "__part"]
    parts = rows.withColumn("__part", F.substring("__order", 1, 3))
    counts = parts.groupBy(*part).agg(F.count("*").alias("__n")).select(*part, (F.sum("__n").over(Window.partitionBy(*by).orderBy("__part")) - F.col("__n")).alias("__before"))
    inside = parts.withColumn("__inside", F.row_number().over(Window.partitionBy(*part).orderBy("__order", *ties)) - 1)
    return inside.join(counts, part).withColumn("__rank", F.col("__before") + F.col("__inside")).drop("__part", "__before", "__inside", "__order")


def fold_preview(rows: DataFrame, folds: int, patient: str, label: str, labels: list) -> DataFrame | None:
    """A row for each fold of group_folds: train and test rows, test patients, test rows of each label (n_<label>).

    None where there are fewer patients than folds.
    """
    if rows.select(patient).distinct().limit(folds).count() < folds:
        return None
    sided = rows.select(patient, label).join(group_folds(rows, folds, patient, label).select(patient, "fold"), patient)
    counts = [F.count_if(F.col(label) == x).alias(f"n_{x}") for x in labels]
    per = sided.groupBy("fold").agg(F.count("*").alias("test_rows"), F.countDistinct(patient).alias("test_patients"), *counts)
    return per.withColumn("train_rows", F.sum("test_rows").over(Window.partitionBy()) - F.col("test_rows"))


def todo(patients: DataFrame, done: DataFrame, patient: str = "patient_id") -> DataFrame:
    """Patients not done yet."""
    return patients.join(done, patient, "left_anti")


def latest_per_key(rows: DataFrame, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The last row of each key in the given order."""
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])))
    return ranked.where("__n = 1").drop("__n")
