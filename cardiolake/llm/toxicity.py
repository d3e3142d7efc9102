"""Toxic passages as maximum-scoring segments of token log-odds, with extreme-value calibration."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardiolake.llm.common import FOLD, per_text, raw_bytes, stored, word_codes
from cardiolake.llm.decontamination import OUTSIDE
from cardiolake.llm.near_duplicates import near_duplicates

#: Labelled texts that training takes at most, of each label.
SAMPLE = 8_000
#: Bytes of a word's head that its stem keeps; pseudo-tokens of the two Dirichlet priors, and what every type has besides.
STEM, PRIOR, STEM_PRIOR, LEAST = 4, 50.0, 50.0, 0.5
#: Log-odds that a stem or word needs at least.
LEAST_ODDS = 3.0
#: Standard errors that a stem's or word's log-odds must exceed to score; what every other token costs.
SURE, DRIFT = 3.0, -0.15
#: Segments below this E-value are significant.
SIGNIFICANT = 0.05


@dataclass
class ToxicModel:
    words: dict[bytes, float] = field(default_factory=dict)
    stems: dict[bytes, float] = field(default_factory=dict)
    drift: float = DRIFT
    rate: float = 1.0
    k: float = 0.1
    slope: float = 1.0
    base: float = -4.0

    def token_scores(self, distinct: pa.Array) -> np.ndarray:
        words, stems, drift = self.words, self.stems, self.drift
        return np.fromiter((words[w] if w in words else stems.get(w[:STEM], drift) for w in distinct.to_pylist()), dtype=float, count=len(distinct))

    def segments(self, column: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Words of each text, and its maximal scoring segments of positive score: first word, word behind the last, score."""
        data, offsets = raw_bytes(column)
        codes, distinct, at, _ = word_codes(FOLD[data], offsets, OUTSIDE)
        scores = self.token_scores(distinct)[codes] if len(codes) else np.zeros(0)
        found: list[list[tuple[int, int, float]]] = [[] for _ in range(len(at) - 1)]
        hot = np.flatnonzero(scores > 0)
        if len(hot):
            sums = np.concatenate([[0.0], np.cumsum(scores)])
            docs = np.searchsorted(at, hot, side="right") - 1
            for d in np.unique(docs).tolist():
                own = hot[np.searchsorted(docs, d) : np.searchsorted(docs, d, side="right")]
                first = int(at[d])
                found[d] = [(a - first, b - first, s) for a, b, s in maximal_segments(own, sums)]
        return np.diff(at), found

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> float:
        """-ln p of a text's best segment and of its other significant ones, where p is the chance of such a segment in n tokens of harmless text."""
        total, best = 0.0, 0.0
        for _, _, s in segments:
            e = self.k * max(n, 1) * math.exp(-min(self.rate * s, 700.0))
            own = -math.log(max(-math.expm1(-e), 1e-300))
            best = max(best, own)
            total += own if e < SIGNIFICANT else 0.0
        return max(total, best)

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, self.base + self.slope * math.log1p(evidence)))))


def maximal_segments(positive: np.ndarray, sums: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, in time linear in the positive tokens.

    positive: places of the tokens that score above zero; sums: running sums of all scores. Candidates keep the sums
    at both ends. A new one looks back for the last candidate that begins lower: if that one also ends lower, the
    two and all between become one, which is looked at anew; else it stands.
    """
    kept: list[tuple[int, int, float, float]] = []
    below: list[int] = []  # for each candidate the last one that begins at a lower sum, or -1
    for i in positive.tolist():
        a, b, low, high = i, i + 1, float(sums[i]), float(sums[i + 1])
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = below[j]
            if j < 0 or kept[j][3] >= high:
                kept.append((a, b, low, high))
                below.append(j)
                break
            a, low = kept[j][0], kept[j][2]
            del kept[j:], below[j:]
    return [(a, b, high - low) for a, b, low, high in kept]


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> ToxicModel:
    """Log-odds, calibration and score of labelled texts.

    At most `sample` labelled ids of each label are taken, those of lowest hash (ids with both labels count as
    toxic; null ids and labels are left out; of an id with several texts that of least hash is taken). Counts of stems and words (once a text) in the two classes have Dirichlet priors: a
    stem's is its share of all text, a word's that of its stem. Only log-odds over SURE standard errors and over
    LEAST_ODDS are kept; other tokens cost a little. The harmless texts give the background of the extreme-value law: its
    rate solves sum p exp(rate s) = 1 over token scores; its factor is the share of texts that reach a score.
    Without labels of either kind, every text gets the same low score.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.max(F.col(label).cast("int")).alias("__y"))
    ranked = F.xxhash64("__k")
    some = known.where("__y = 0").orderBy(ranked, "__k").limit(sample).unionByName(known.where("__y = 1").orderBy(ranked, "__k").limit(sample))
    some = stored(some, "toxic-labels")  # at most 2 * sample rows of two numbers: a proven bound for the broadcast
    rows = docs.select(F.col(key).alias("__k"), F.col(text).alias("text")).join(F.broadcast(some), "__k")
    # one text an id, so that the sample is bounded by the labels whatever repeats
    rows = rows.groupBy("__k", "__y").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("one")).select("one.text", "__y")
    rows = stored(_unlike(rows), "toxic-sample")

    def counted(batches):
        for batch in batches:
            data, offsets = raw_bytes(batch.column(0))
            codes, distinct, at, _ = word_codes(FOLD[data], offsets, OUTSIDE)
            # a word counts once in a text, however often the text repeats it
            pairs = np.unique(np.repeat(np.arange(len(at) - 1), np.diff(at)) * max(len(distinct), 1) + codes)
            codes = pairs % max(len(distinct), 1)
            toxic = batch.column(1).to_numpy(zero_copy_only=False)[pairs // max(len(distinct), 1)] == 1
            n = [np.bincount(codes[pick], minlength=len(distinct)).astype(np.int64) for pick in (toxic, ~toxic)]
            yield pa.RecordBatch.from_arrays([distinct.cast(pa.binary()), pa.array(n[0]), pa.array(n[1])], names=["word", "t", "c"])

    words = rows.mapInArrow(counted, "word binary, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    words = stored(words.withColumn("stem", F.substring("word", 1, STEM)), "toxic-words")
    nt, nc = (int(x or 0) for x in words.agg(F.sum("t"), F.sum("c")).first())
    model = ToxicModel()
    if not nt or not nc:
        return model

    def log_odds(t, c, prior_t, prior_c, weight: float):
        t, c = t + weight * prior_t + LEAST, c + weight * prior_c + LEAST
        odds = F.log(t / (F.lit(nt + weight + 1.0) - t)) - F.log(c / (F.lit(nc + weight + 1.0) - c))
        return odds, odds / F.sqrt(1 / t + 1 / c)

    stems = words.groupBy("stem").agg(F.sum("t").alias("st"), F.sum("c").alias("sc"))
    share = (F.col("st") + F.col("sc")) / F.lit(float(nt + nc))
    odds, z = log_odds(F.col("st"), F.col("sc"), share, share, STEM_PRIOR)
    # stored, so that the join below deals both its sides out on their own and a frequent stem's words can be split
    stems = stored(stems.withColumns({"odds": odds, "z": z}), "toxic-stems")
    sure_stems = stems.where((F.col("z") > SURE) & (F.col("odds") > LEAST_ODDS)).select("stem", "odds")
    # a word's prior follows its stem's rates, scaled so that both classes lend the same mass to the stem
    rates = stems.select("stem", ((F.col("st") + STEM_PRIOR * share) / (nt + STEM_PRIOR)).alias("pt"), ((F.col("sc") + STEM_PRIOR * share) / (nc + STEM_PRIOR)).alias("pc"))
    odds, z = log_odds(F.col("t"), F.col("c"), F.col("pt"), F.col("pc"), PRIOR)
    rated = words.join(rates, "stem").withColumns({"odds": odds, "z": z})
    # words of a sure stem that are not toxic themselves are needed, too: they override the stem
    exact = rated.where((F.col("z") > SURE) & (F.col("odds") > LEAST_ODDS) | (F.col("z") < -SURE) & (F.col("odds") < -1)).select("word", "odds")
    model.stems = {bytes(r["stem"]): float(r["odds"]) for r in sure_stems.collect()}
    model.words = {bytes(r["word"]): float(r["odds"]) for r in exact.collect()}
    model.words = {w: (s if s > 0 else DRIFT) for w, s in model.words.items() if s > 0 or w[:STEM] in model.stems}

    shared = spark.sparkContext.broadcast(model)

    def best(batches):
        scorer = shared.value
        for batch in batches:
            n, found = scorer.segments(batch.column(0))
            flat = [[s for _, _, s in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n.astype(np.int64)), pa.array(flat, pa.list_(pa.float64()))], names=["y", "n", "s"])

    seen = rows.mapInArrow(best, "y int, n long, s array<double>").toPandas()
    calm = seen[seen["y"] == 0]
    n_tokens = float(calm["n"].sum())
    scores = np.array([s for f in calm["s"] for s in f])
    # background: positive segments as tokens of their score, all others of the drift; one of the least score is added
    values = np.append(scores, max(min(model.stems.values(), default=3.0), 1.0))
    model.rate = _rate(values, max(n_tokens - len(values), 1.0), DRIFT)
    top = np.array([max(f) if len(f) else 0.0 for f in calm["s"]])
    floor = float(np.median(values))
    model.k = float((np.sum(top >= floor) + 1) / ((n_tokens + 1) * math.exp(-model.rate * floor)))
    t = np.log1p([model.evidence(int(n), [(0, 0, s) for s in f]) for n, f in zip(seen["n"], seen["s"], strict=True)])
    # the classes are sampled apart: each text weighs as many as it stands for
    totals = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    weight = np.where(seen["y"] == 1, totals.get(1, 0) / max((seen["y"] == 1).sum(), 1), totals.get(0, 0) / max((seen["y"] == 0).sum(), 1))
    model.slope, model.base = _logistic(t, seen["y"].to_numpy(), weight / weight.mean())
    return model


def _unlike(rows: DataFrame) -> DataFrame:
    """One text of each class of near copies of one label (5-word n-grams, Jaccard 0.8 verified on whole sets).

    Copies and near copies of a text would lend its harmless words false weight. A text of the other label is never
    a reason to leave one out; texts without words all stay.
    """
    rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()), "toxic-rows")
    clean, toxic = (near_duplicates(rows.where(F.col("__y") == y), width=5, similarity=0.8, key="__row").where("is_first").select("__row") for y in (0, 1))
    return rows.join(clean.unionByName(toxic), "__row", "left_semi").select("text", "__y")


def _rate(scores: np.ndarray, others: float, drift: float) -> float:
    """The positive root of the mean of exp(rate * score) = 1."""
    n = len(scores) + others
    f = lambda x: (np.exp(np.minimum(x * scores, 600)).sum() + others * math.exp(x * drift)) / n - 1
    low, high = 1e-6, 1.0
    if f(low) >= 0:
        return low
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a small ridge on the slope."""
    a = np.stack([x, np.ones_like(x)], 1)
    b = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -500, 500)))
        g = a.T @ (weight * (p - y)) + np.array([ridge * b[0], 0.001 * b[1]])
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([ridge, 0.001])
        step = np.linalg.solve(h, g)
        b = b - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def score_toxicity(docs: DataFrame, model: ToxicModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with score, predicted and passages (first word, word behind the last, score and E-value of each significant one).

    Null and empty texts have no segment and get the lowest score. Columns of these names that docs has are replaced;
    repeated rows are scored alike; an empty table gives no rows.
    """
    docs = docs.drop("score", "predicted", "passages")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("first", pa.int64()), ("behind", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())])

    def make():
        scorer = shared.value

        def score(column: pa.Array) -> list[pa.Array]:
            n, found = scorer.segments(column)
            p, passages = [], []
            for k, segments in zip(n.tolist(), found, strict=True):
                p.append(scorer.probability(scorer.evidence(k, segments)))
                rated = [{"first": a, "behind": b, "score": s, "e_value": scorer.k * k * math.exp(-min(scorer.rate * s, 700.0))} for a, b, s in segments]
                passages.append([r for r in rated if r["e_value"] < SIGNIFICANT])
            p = np.array(p)
            return [pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(passages, pa.list_(passage))]

        return score

    return per_text(docs, text, make, "score double, predicted int, passages array<struct<first: long, behind: long, score: double, e_value: double>>", keep)
