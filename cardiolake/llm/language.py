"""Language identification with a convolutional network over bytes, trained in NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardiolake.llm.common import per_text, raw_bytes, stored, strided_counts

#: Bytes of a window, filters of each width, and the widths.
WINDOW, FILTERS, WIDTHS = 128, 16, (2, 3, 4)
#: Texts that training gathers of each language at most, and windows that it takes from each text at most.
SAMPLE, PER_TEXT = 600, 4
#: Languages that a network can tell apart.
MOST_LANGUAGES = 1_000
#: Byte classes: the network folds case, takes digits as one, and keeps other bytes apart.
CLASSES = np.zeros(256, dtype=np.int64)
CLASSES[0x20] = CLASSES[0x09:0x0E] = 1
CLASSES[0x61:0x7B] = CLASSES[0x41:0x5B] = np.arange(2, 28)
CLASSES[0x30:0x3A] = 28
CLASSES[0x80:0xC0] = np.arange(29, 93)
CLASSES[0xC0:] = np.arange(93, 157)
N_CLASSES = 157


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte behind the last, and text of each window of WINDOW bytes that the texts are cut into."""
    n = -(-np.diff(offsets) // WINDOW)
    owner = np.repeat(np.arange(len(n)), n)
    begin = offsets[:-1][owner] + strided_counts(n) * WINDOW
    return begin, np.minimum(begin + WINDOW, offsets[1:][owner]), owner


def byte_classes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes' classes of some windows, a row each; behind a text's end stands class 0."""
    at = begin[:, None] + np.arange(WINDOW)
    inside = at < end[:, None]
    return np.where(inside, CLASSES[data[np.where(inside, at, 0)]], 0)


class ByteNetwork:
    """Filters of several widths over one-hot bytes, maximum over the window, softmax.

    A filter of width w is w rows of weights picked by the bytes: on one-hot input a convolution is a sum of w rows.
    """

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.filters = [rng.normal(0, 0.1, (w, N_CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), dtype=np.float32)

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        tops, where = [], []
        for w, table in zip(WIDTHS, self.filters, strict=True):
            n = WINDOW - w + 1
            y = table[0][x[:, :n]]
            for k in range(1, w):
                y = y + table[k][x[:, k : k + n]]
            at = y.argmax(1)
            where.append(at)
            tops.append(np.take_along_axis(y, at[:, None], 1)[:, 0])
        return np.concatenate(tops, 1), where

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.004, seed: int = 7) -> None:
        """Adam on the cross-entropy of single windows; the same rows in the same order give the same weights."""
        rng = np.random.default_rng(seed)
        params = [*self.filters, self.bias, self.out, self.out_bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                xb, yb = x[rows], y[rows]
                top, where = self._pooled(xb)
                hidden = np.maximum(top + self.bias, 0)
                z = hidden @ self.out + self.out_bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(yb)), yb] -= 1
                p /= len(yb)
                back = (p @ self.out.T) * (hidden > 0)
                grads = []
                for i, (w, at) in enumerate(zip(WIDTHS, where, strict=True)):
                    g = np.zeros_like(self.filters[i])
                    part = back[:, i * FILTERS : (i + 1) * FILTERS]
                    for k in range(w):
                        np.add.at(g[k], (np.take_along_axis(xb, at + k, 1), np.arange(FILTERS)[None, :]), part)
                    grads.append(g)
                grads += [back.sum(0), hidden.T @ p, p.sum(0)]
                step += 1
                for j, (param, g) in enumerate(zip(params, grads, strict=True)):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    param -= (rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def prepare(self) -> None:
        """Tables for pairs of bytes, so that a width-4 filter takes two look-ups."""
        first = [t for t in self.filters]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(-1, FILTERS)
        self.pairs = [np.ascontiguousarray(pair(first[0][0], first[0][1])), np.ascontiguousarray(pair(first[1][0], first[1][1])), np.ascontiguousarray(pair(first[2][0], first[2][1])), np.ascontiguousarray(pair(first[2][2], first[2][3]))]

    def log_softmax(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities of the labels for each window."""
        two = x[:, :-1] * N_CLASSES + x[:, 1:]
        tops = [
            self.pairs[0][two].max(1),
            (self.pairs[1][two[:, :-1]] + self.filters[1][2][x[:, 2:]]).max(1),
            (self.pairs[2][two[:, :-2]] + self.pairs[3][two[:, 2:]]).max(1),
        ]
        hidden = np.maximum(np.concatenate(tops, 1) + self.bias, 0)
        z = hidden @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, per_text_windows: int = PER_TEXT) -> ByteNetwork | None:
    """A network from docs with a language: `sample` texts of each language at most.

    Texts are dealt by their hash to `sample` buckets a language, and of each bucket the distinct text of least hash
    is taken: the bound holds whatever repeats, and a language with any text has one. Of a text, the bytes of at most
    `per_text_windows` windows at places spread over all of it. Texts that are null or empty, and languages that are
    null, take no part; equal texts of one language count once, of two languages once for each. None, if no document
    has a language and a text.
    """
    spark = docs.sparkSession
    known = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    known = known.withColumn("h", F.xxhash64("text"))
    picked = stored(known.groupBy("lang", F.pmod("h", F.lit(sample)).alias("bucket")).agg(F.min("h").alias("h")).select("lang", "h"), "lang-sample")
    languages = picked.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not languages:
        return None
    # `sample` rows of two values a language: a proven bound for the broadcast
    rows = known.join(F.broadcast(picked), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", "text")

    def spread(batches):
        for batch in batches:
            data, offsets = raw_bytes(batch.column(1))
            begin, end, owner = windows(offsets)
            n = np.bincount(owner, minlength=len(offsets) - 1)
            first = np.cumsum(n) - n
            parts = []
            for f, c in zip(first.tolist(), n.tolist(), strict=True):
                own = f + np.unique(np.linspace(0, c - 1, min(c, per_text_windows)).astype(int))
                parts.append(byte_classes(data, begin[own], end[own]).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.binary())], names=["lang", "x"])

    gathered = rows.mapInArrow(spread, "lang string, x binary").toPandas().sort_values(["lang", "x"], ignore_index=True)
    labels = sorted(r["lang"] for r in languages)
    xs = [np.frombuffer(b, np.uint8).reshape(-1, WINDOW).astype(np.int64) for b in gathered["x"]]
    ys = [np.full(len(x), labels.index(name)) for x, name in zip(xs, gathered["lang"], strict=True)]
    network = ByteNetwork(labels)
    network.fit(np.concatenate(xs), np.concatenate(ys))
    network.prepare()
    return network


def identify(docs: DataFrame, network: ByteNetwork | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred and score: the label of highest mean log-probability over all windows, and its share.

    `und` with score 0 for a text that is null or has no letter, and for every text without a network. Ties go to
    the first label. Empty tables give no rows; repeated rows get the same result.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def make():
        net = shared.value

        def predict(column: pa.Array) -> list[pa.Array]:
            n = len(column)
            if net is None:
                return [pa.array(["und"] * n), pa.array(np.zeros(n))]
            data, offsets = raw_bytes(column)
            begin, end, owner = windows(offsets)
            total = np.zeros((n, len(net.labels)))
            for first in range(0, len(owner), 256):
                part = slice(first, first + 256)
                np.add.at(total, owner[part], net.log_softmax(byte_classes(data, begin[part], end[part])))
            mean = total / np.maximum(np.bincount(owner, minlength=n), 1)[:, None]
            p = np.exp(mean - mean.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            return [pa.array(np.array(net.labels, dtype=object)[p.argmax(1)], pa.string()), pa.array(p.max(1).astype(np.float64))]

        return predict

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    columns = list(docs.columns if keep is None else keep)
    rows = per_text(docs.withColumn("__lettered", lettered), text, make, "lang_pred string, score double", [*columns, "__lettered"], most_bytes=1_000_000)
    return rows.withColumns({"lang_pred": F.when(F.col("__lettered"), F.col("lang_pred")).otherwise("und"), "score": F.when(F.col("__lettered"), F.col("score")).otherwise(0.0)}).select(*columns, "lang_pred", "score")
