"""Language-model scores: a gated recurrent network over words with a class-factored softmax, in NumPy."""

from __future__ import annotations

import copy
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardiolake.llm.common import FOLD, blocks, per_text, raw_bytes, stored, strided_counts, text_id, with_facts, word_codes

#: Units of the network; classes of frequent words and words of each; classes of all other words.
UNITS, HEAD_CLASSES, HEAD_WIDTH, TAIL_CLASSES = 32, 32, 32, 64
#: Of the classes of other words, those that hold what has no class of its own.
SPARE = 16
#: Words with counts that every task holds: the most frequent ones, this many at most.
DICTIONARY = 200_000
#: Texts, on average, of the first weights, from which training on all texts starts; epochs over them; streams and steps of a window of truncated backpropagation.
SAMPLE, EPOCHS, STREAMS, STEPS = 400, 4, 48, 24
#: Rounds over all training texts; parallel streams of a window there at most; tokens of a part, whose weights are averaged with those of the others.
ROUNDS, WIDE, PART = 4, 256, 2_000_000
BLOCK_BYTES = 10_000_000
#: Bytes of a text of the first sample at most.
LONGEST = 100_000
#: States gathered before the softmax is taken; rows of it at once; rows of the input table whose gradients are summed at once.
FLUSH, CACHED, MARKS = 8_192, 1_024, 32
#: Logarithms of rare words are summed as whole parts of this size.
BILLION = 1_000_000_000


@dataclass
class Vocabulary:
    """What all tasks know of the training tokens: totals, frequent words, and the sums of the classes of the others."""

    total: int
    types: int
    ends: int
    words: dict[bytes, int]
    counts: np.ndarray
    head: int
    class_of_heads: np.ndarray
    tail_total: np.ndarray
    tail_types: np.ndarray


def head_code(distinct: pa.Array) -> np.ndarray:
    """The first two bytes of each word as a number."""
    data, offsets = raw_bytes(distinct)
    lengths = np.diff(offsets)
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    first = padded[offsets[:-1]].astype(np.int64)
    second = np.where(lengths > 1, padded[np.minimum(offsets[:-1] + 1, len(padded) - 1)], 0)
    return first * 256 + second


def tokens_of(column: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Tokens of each text with an end: dictionary number (-1 without), tail class, n+1 offsets, code of the distinct word (-1: end), distinct words.

    The end has dictionary number 0.
    """
    data, offsets = raw_bytes(column)
    codes, distinct, at, _ = word_codes(FOLD[data], offsets)
    lookup = vocabulary.words
    number = np.fromiter((lookup.get(w, -1) for w in distinct.to_pylist()), dtype=np.int64, count=len(distinct))
    tail = vocabulary.class_of_heads[head_code(distinct)] if len(distinct) else np.zeros(0, np.int64)
    bounds = at + np.arange(len(at))
    full = np.full(int(bounds[-1]), -1, dtype=np.int64)
    place = np.ones(len(full), dtype=bool)
    place[bounds[1:] - 1] = False
    full[place] = codes
    numbers = np.zeros(len(full), dtype=np.int64)
    numbers[place] = number[codes] if len(codes) else 0
    tails = np.zeros(len(full), dtype=np.int64)
    tails[place] = tail[codes] if len(codes) else 0
    return numbers, tails, bounds, full, distinct


def _picked(y: np.ndarray, column: np.ndarray, calm: bool) -> np.ndarray:
    """Log-softmax of one column of each row. calm: no logit can overflow exp in single precision."""
    if not calm:
        y -= y.max(1, keepdims=True)
    chosen = y[np.arange(len(y)), column].astype(float)
    np.exp(y, out=y)
    return chosen - np.log(y @ np.ones(y.shape[1], y.dtype))


def _misses(y: np.ndarray, column: np.ndarray, scale: np.ndarray, calm: bool) -> np.ndarray:
    """scale times (softmax of each row, less one in its column), written over y."""
    if not calm:
        y -= y.max(1, keepdims=True)
    np.exp(y, out=y)
    y *= (scale / (y @ np.ones(y.shape[1], y.dtype)))[:, None]
    y.reshape(-1)[np.arange(len(y)) * y.shape[1] + column] -= scale
    return y


def _sigmoid(y: np.ndarray, out: np.ndarray) -> None:
    """Sigmoid of -y, 0 where exp overflows. NumPy's exp takes half the time of its tanh."""
    np.exp(y, out=out)
    out += 1
    np.reciprocal(out, out=out)


def _tanh(y: np.ndarray) -> None:
    """Tanh of -y / 2, written over y."""
    _sigmoid(y, y)
    y *= 2
    y -= 1


class Adam:
    """Running moments of the gradients, whose common length is cut to 1."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.m, self.v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
        self.updates = 0

    def update(self, p: dict[str, np.ndarray], grads: dict[str, np.ndarray], rate: float) -> None:
        self.updates += 1
        scale = np.float32(min(1.0, 1.0 / (np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values())) + 1e-12)))
        first, second = np.float32(rate / (1 - 0.9**self.updates)), np.float32(1 / (1 - 0.999**self.updates))
        for k, g in grads.items():
            m, v, step = self.m[k], self.v[k], np.empty_like(g)
            g *= scale
            m *= np.float32(0.9)
            np.multiply(g, np.float32(0.1), out=step)
            m += step
            g *= g
            g *= np.float32(0.001)
            v *= np.float32(0.999)
            v += g
            np.multiply(v, second, out=step)
            np.sqrt(step, out=step)
            step += np.float32(1e-8)
            np.divide(m, step, out=step)
            step *= first
            p[k] -= step


class GatedNetwork:
    """Embedding, gated recurrent units, softmax over classes, softmax over the words of a class of frequent words."""

    def __init__(self, used: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        n_in, c = HEAD_CLASSES * HEAD_WIDTH + TAIL_CLASSES + 1, HEAD_CLASSES + TAIL_CLASSES
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.p = {"x": small(n_in, 3 * UNITS), "u": small(UNITS, 3 * UNITS), "c": small(UNITS, c), "cb": np.zeros(c, np.float32), "w": small(HEAD_CLASSES, UNITS, HEAD_WIDTH), "wb": np.zeros((HEAD_CLASSES, HEAD_WIDTH), np.float32)}
        #: places of a class that no word has
        self.mask = np.zeros(HEAD_CLASSES * HEAD_WIDTH, np.float32)
        self.mask[used:] = -1e9
        self.mask = self.mask.reshape(HEAD_CLASSES, HEAD_WIDTH)
        #: arrays of a window, which the next window of equal shape takes over
        self.room: dict[tuple, np.ndarray] = {}

    @staticmethod
    def inputs(number: np.ndarray, tail: np.ndarray, head: int) -> np.ndarray:
        """Row of the input table: frequent words have their own, others that of their class."""
        return np.where((number >= 0) & (number < head), number, HEAD_CLASSES * HEAD_WIDTH + tail)

    START = HEAD_CLASSES * HEAD_WIDTH + TAIL_CLASSES

    def by_gate(self, k: str) -> np.ndarray:
        """Weights of one gate after the other, so that a gate's values lie end to end; negative, as exp takes them (see _sigmoid), those of the last one twofold for its tanh."""
        scale = np.array([-1, -1, -2], self.p[k].dtype)[:, None, None]
        return np.ascontiguousarray(self.p[k].reshape(-1, 3, UNITS).transpose(1, 0, 2) * scale)

    def is_calm(self) -> bool:
        """No logit can overflow exp: states lie within -1 and 1, so none exceeds these sums."""
        return bool(max((np.abs(self.p["c"]).sum(0) + np.abs(self.p["cb"])).max(), (np.abs(self.p["w"]).sum(1) + np.abs(self.p["wb"])).max()) < 60)

    def _room(self, name: str, *shape: int) -> np.ndarray:
        if (name, shape) not in self.room:
            self.room[name, shape] = np.empty(shape, self.p["u"].dtype)
        return self.room[name, shape]

    def step(self, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        g, u = self.p["x"][x], h @ self.p["u"]
        zr = 0.5 * (1 + np.tanh(0.5 * (g[:, : 2 * UNITS] + u[:, : 2 * UNITS])))
        z, r = zr[:, :UNITS], zr[:, UNITS:]
        n = np.tanh(g[:, 2 * UNITS :] + r * u[:, 2 * UNITS :])
        return n + z * (h - n), (h, x, z, r, n, u)

    def log_class(self, h: np.ndarray) -> np.ndarray:
        y = h @ self.p["c"] + self.p["cb"]
        y -= y.max(1, keepdims=True)
        return y - np.log(np.exp(y).sum(1, keepdims=True))

    def log_word(self, h: np.ndarray, k: int) -> np.ndarray:
        y = h @ self.p["w"][k] + self.p["wb"][k] + self.mask[k]
        y -= y.max(1, keepdims=True)
        return y - np.log(np.exp(y).sum(1, keepdims=True))

    def log_probability(self, h: np.ndarray, target: np.ndarray, tail: np.ndarray, head: int) -> np.ndarray:
        """Natural log-probability of each target's class and, for frequent words, of the word in it."""
        own = target < head
        own &= target >= 0
        group = np.where(own, target // HEAD_WIDTH, HEAD_CLASSES + tail)
        out = np.empty(len(h))
        for first in range(0, len(h), CACHED):
            y = h[first : first + CACHED] @ self.p["c"]
            y += self.p["cb"]
            out[first : first + CACHED] = _picked(y, group[first : first + CACHED], self.calm)
        at = np.flatnonzero(own)
        at = at[np.argsort(group[at].astype(np.int16), kind="stable")]
        edges = np.searchsorted(group[at], np.arange(HEAD_CLASSES + 1))
        for k in range(HEAD_CLASSES):
            rows = at[edges[k] : edges[k + 1]]
            if len(rows):
                y = h[rows] @ self.p["w"][k]
                y += self.shifts[k]
                out[rows] += _picked(y, target[rows] % HEAD_WIDTH, self.calm)
        return out

    def fit(self, rows: np.ndarray, bounds: np.ndarray, epochs: int = EPOCHS, rate: float = 0.006, seed: int = 11, streams: int = STREAMS, adam: Adam | None = None) -> None:
        """Truncated backpropagation over windows of STEPS tokens; each stream's state goes on to its next window, texts begin anew.

        rows: each token's row of the input table, which also names its class and its word in it. All tokens are
        dealt to the streams; places behind the last one have no gradient.
        """
        rng = np.random.default_rng(seed)
        adam = adam or Adam(self.p)
        begins = np.zeros(len(rows), dtype=bool)
        begins[bounds[:-1]] = True
        streams = max(1, min(streams, len(rows) // 2))
        length = -(-len(rows) // streams)
        inputs = np.where(begins, self.START, np.roll(rows, 1))
        for epoch in range(epochs):
            order = rng.permutation(len(bounds) - 1)
            lengths = np.diff(bounds)[order]
            places = np.repeat(bounds[:-1][order], lengths) + strided_counts(lengths)
            grid = np.concatenate([places, np.full(length * streams - len(places), -1)]).reshape(streams, length).T
            h = np.zeros((streams, UNITS), np.float32)
            for first in range(0, length, STEPS):
                at = grid[first : first + STEPS]
                grads, h = self._gradients(inputs[at], rows[at], begins[at], at >= 0, h)
                adam.update(self.p, grads, rate * (1 - epoch / epochs * 0.8))
        self.room = {}

    @np.errstate(over="ignore")
    def _gradients(self, x: np.ndarray, target: np.ndarray, new: np.ndarray, live: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean loss of a window (steps by streams), and the last states.

        Each gate's values lie end to end, and the backward pass writes the gradients over them: long inner loops, and
        a window that stays in the cache.
        """
        steps, streams = x.shape
        table, w = self.by_gate("x"), self.by_gate("u")
        back_w = self.p["u"].reshape(UNITS, 3, UNITS).transpose(1, 2, 0)
        shape = (steps, streams, UNITS)
        before, un, states = (self._room(k, *shape) for k in ("before", "un", "states"))
        gates = self._room("gates", 3, *shape)
        g, u, a, b = self._room("g", 3, *shape[1:]), self._room("u", 2, *shape[1:]), self._room("a", *shape[1:]), self._room("b", *shape[1:])
        begun = [np.flatnonzero(row) for row in new]
        for t in range(steps):
            own, (zr, n) = before[t], (gates[:2, t], gates[2, t])
            own[:] = h
            own[begun[t]] = 0
            np.take(table, x[t], axis=1, out=g, mode="clip")
            np.matmul(own, w[:2], out=u)
            np.matmul(own, w[2], out=un[t])
            g[:2] += u
            _sigmoid(g[:2], zr)
            np.multiply(zr[1], un[t], out=n)
            n += g[2]
            _tanh(n)
            h = states[t]
            np.subtract(own, n, out=h)
            h *= zr[0]
            h += n
        grads, d_states = self._output_grads(states.reshape(-1, UNITS), target.ravel(), live.ravel())
        d_states = d_states.reshape(shape)
        back = np.zeros(shape[1:], before.dtype)
        for t in range(steps - 1, -1, -1):
            d, (z, r, n), u_n = d_states[t], gates[:, t], un[t]
            d += back
            np.multiply(d, z, out=back)
            # to z: d (before - n) z (1 - z)
            np.subtract(before[t], n, out=a)
            a *= back
            np.subtract(1, z, out=b)
            np.multiply(a, b, out=z)
            # to n: d (1 - z) (1 - n n)
            b *= d
            np.multiply(n, n, out=n)
            np.subtract(1, n, out=n)
            n *= b
            # to r: what comes to n, by u r (1 - r); to u: by r
            np.multiply(n, r, out=a)
            np.subtract(1, r, out=r)
            r *= a
            u_n *= -0.5  # by_gate
            r *= u_n
            u_n[:] = a
            for gate, own in zip((z, r, u_n), back_w, strict=True):
                back += np.matmul(gate, own, out=a)
            back[begun[t]] = 0
        flat = before.reshape(-1, UNITS).T
        to_u = [flat @ d.reshape(-1, UNITS) for d in (gates[0], gates[1], un)]
        return grads | {"x": self._table_grads(x.ravel(), gates.reshape(3, -1, UNITS)), "u": np.concatenate(to_u, 1)}, h.copy()

    def _table_grads(self, x: np.ndarray, gates: np.ndarray) -> np.ndarray:
        """Sums of the gates' gradients over the places of each row of the input table: of each MARKS rows at once, by a product with their marks."""
        order = np.argsort(x.astype(np.int16), kind="stable")
        x = x[order]
        marks = self._room("marks", len(x), MARKS)
        marks[:] = 0
        marks.reshape(-1)[np.arange(len(x)) * MARKS + x % MARKS] = 1
        dealt = self._room("dealt", *gates.shape)
        np.take(gates, order, axis=1, out=dealt, mode="clip")
        edges = np.searchsorted(x, np.arange(0, self.START + MARKS + 1, MARKS)).tolist()
        sums = np.zeros((3, MARKS * (len(edges) - 1), UNITS), gates.dtype)
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if a < b:
                np.matmul(marks[a:b].T, dealt[:, a:b], out=sums[:, MARKS * k : MARKS * k + MARKS])
        return sums[:, : self.START + 1].transpose(1, 0, 2).reshape(-1, 3 * UNITS)

    def _output_grads(self, h: np.ndarray, target: np.ndarray, live: np.ndarray) -> tuple[dict, np.ndarray]:
        n, heads, calm = max(int(live.sum()), 1), HEAD_CLASSES * HEAD_WIDTH, self.is_calm()
        c, cb, w, wb = (self.p[k] for k in ("c", "cb", "w", "wb"))
        group = np.where(target < heads, target // HEAD_WIDTH, HEAD_CLASSES + target - heads)
        scale = (live / n).astype(h.dtype)
        back = self._room("back", *h.shape)
        grads = {"c": np.zeros_like(c), "cb": np.zeros_like(cb), "w": np.zeros_like(w), "wb": np.zeros_like(wb)}
        for first in range(0, len(h), CACHED):
            own = slice(first, first + CACHED)
            p = np.matmul(h[own], c, out=self._room("p", len(h[own]), c.shape[1]))
            p += cb
            _misses(p, group[own], scale[own], calm)
            grads["c"] += h[own].T @ p
            grads["cb"] += np.ones(len(p), p.dtype) @ p
            np.matmul(p, c.T, out=back[own])
        order = np.flatnonzero(live & (target < heads))
        order = order[np.argsort(group[order].astype(np.int16), kind="stable")]
        edges = np.searchsorted(group[order], np.arange(HEAD_CLASSES + 1)).tolist()
        classes = [(k, a, b) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
        h, shift = h[order], wb + self.mask
        q = self._room("q", len(back), HEAD_WIDTH)[: len(order)]
        for k, a, b in classes:
            np.matmul(h[a:b], w[k], out=q[a:b])
            q[a:b] += shift[k]
        _misses(q, target[order] % HEAD_WIDTH, scale[order], calm)
        own = self._room("own", *back.shape)[: len(order)]
        for k, a, b in classes:
            grads["w"][k] = h[a:b].T @ q[a:b]
            grads["wb"][k] = np.ones(b - a, q.dtype) @ q[a:b]
            np.matmul(q[a:b], w[k].T, out=own[a:b])
        back[order] += own
        return grads, back

    def prepare(self) -> None:
        """Weights in the layout of scoring."""
        self.fast_x, self.fast_u = self.by_gate("x"), self.by_gate("u")
        self.shifts = self.p["wb"] + self.mask
        self.calm = self.is_calm()

    @np.errstate(over="ignore")
    def score(self, number: np.ndarray, tail: np.ndarray, bounds: np.ndarray, head: int) -> np.ndarray:
        """Natural log-probability of the classes and frequent words of each text, state carried from its first token to its last.

        All texts advance together, the longest first in the batch, so that those that go on are always its head.
        """
        lengths = np.diff(bounds)
        order = np.argsort(-lengths, kind="stable")
        begin, lengths = bounds[:-1][order], lengths[order]
        out = np.zeros(len(order))
        rows = np.roll(self.inputs(number, tail, head), 1)
        rows[begin] = self.START
        h = np.zeros((len(order), UNITS), np.float32)
        active = len(order) - np.searchsorted(lengths[::-1], np.arange(int(lengths[0]) if len(lengths) else 0), side="right")
        states, places, who = [], [], []
        held = 0
        everyone = np.arange(len(order))

        def flush() -> None:
            nonlocal held
            at, owner = np.concatenate(places), np.concatenate(who)
            out[:] += np.bincount(owner, weights=self.log_probability(np.concatenate(states), number[at], tail[at], head), minlength=len(out))
            states.clear()
            places.clear()
            who.clear()
            held = 0

        for t, n in enumerate(active.tolist()):
            at = begin[:n] + t
            g = np.take(self.fast_x, rows[at], axis=1, mode="clip")
            u = np.matmul(h[:n], self.fast_u)
            zr = g[:2]
            zr += u[:2]
            _sigmoid(zr, zr)
            c = u[2]
            c *= zr[1]
            c += g[2]
            _tanh(c)
            h = h[:n] - c
            h *= zr[0]
            h += c
            states.append(h)
            places.append(at)
            who.append(everyone[:n])
            held += n
            if held >= FLUSH:
                flush()
        if held:
            flush()
        result = np.zeros(len(order))
        result[order] = out
        return result


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """word (bytes), c: how often each word occurs in all of docs. Blocks are counted before Spark sums them."""

    def counted(batches):
        for batch in blocks(batches, "text", BLOCK_BYTES):
            data, offsets = raw_bytes(batch.column(0))
            codes, distinct, _, _ = word_codes(FOLD[data], offsets)
            yield pa.RecordBatch.from_arrays([distinct.cast(pa.binary()), pa.array(np.bincount(codes, minlength=len(distinct)).astype(np.int64))], names=["word", "c"])

    return docs.select(F.col(text).alias("text")).mapInArrow(counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def learn_vocabulary(counts: DataFrame, n_docs: int) -> tuple[Vocabulary, int]:
    """Totals, dictionary and classes from the stored word counts; the least count that the dictionary holds.

    Words of the dictionary are those whose count is high enough that DICTIONARY of them exist at most: read off a
    histogram of counts by powers of 2**(1/8). Classes of other words go by their first two bytes: the heaviest heads
    have a class each, the rest share SPARE classes by hash.
    """
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    bins = counts.groupBy(F.floor(F.log2("c") * 8).alias("bin")).count().collect()
    room, least_bin = DICTIONARY, None
    for r in sorted(bins, key=lambda r: -r["bin"]):
        room -= r["count"]
        if room < 0:
            break
        least_bin = r["bin"]
    frequent = counts.where(F.floor(F.log2("c") * 8) >= least_bin).collect() if least_bin is not None else []
    rows = sorted(((bytes(r["word"]), r["c"]) for r in frequent), key=lambda r: (-r[1], r[0]))
    least = min((c for _, c in rows), default=1 << 62)
    head = min(len(rows) + 1, HEAD_CLASSES * HEAD_WIDTH)
    words = {w: i + 1 for i, (w, _) in enumerate(rows)}
    numbers = np.array([n_docs] + [c for _, c in rows], dtype=np.int64)
    code = F.conv(F.rpad(F.hex(F.substring("word", 1, 2)), 4, "0"), 16, 10).cast("int")
    by_head = {r["head"]: (r["c"], r["n"]) for r in counts.groupBy(code.alias("head")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()}  # 65,536 rows at most
    # the words of the network's own classes leave theirs
    for w, c in rows[: head - 1]:
        k = w[0] * 256 + (w[1] if len(w) > 1 else 0)
        by_head[k] = (by_head[k][0] - c, by_head[k][1] - 1)
    heaviest = sorted(by_head, key=lambda k: (-by_head[k][0], k))[: TAIL_CLASSES - SPARE]
    class_of = TAIL_CLASSES - SPARE + (np.arange(65_536) * 2_654_435_761 % 2**32 >> 16) % SPARE
    class_of[heaviest] = np.arange(len(heaviest))
    tail_total, tail_types = np.zeros(TAIL_CLASSES, np.int64), np.zeros(TAIL_CLASSES, np.int64)
    for k, (c, n) in by_head.items():
        tail_total[class_of[k]] += c
        tail_types[class_of[k]] += n
    types_with_end = types + (1 if n_docs else 0)
    return Vocabulary(total + n_docs, types_with_end, n_docs, words, numbers, head, class_of, tail_total, tail_types), least


def first_texts(docs: DataFrame, text: str, sample: int) -> list[str]:
    """About `sample` distinct texts of LONGEST bytes at most: of each of as many hash buckets, the text of least hash; sorted.

    Equal texts are one, however many rows they are; the choice hangs on the texts alone.
    """
    if sample < 1:
        return []
    short = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.octet_length("text") <= LONGEST).withColumn("h", F.xxhash64("text"))
    least = short.select("h").groupBy(F.pmod("h", F.lit(sample))).agg(F.min("h").alias("h")).select("h")  # a number for each bucket
    found = short.join(F.broadcast(least), "h", "left_semi").groupBy("h").agg(F.min("text").alias("text"))
    return sorted(r["text"] for r in found.select("text").collect())


def train_network(docs: DataFrame, vocabulary: Vocabulary, n_docs: int, text: str, key: str, sample: int = SAMPLE, rounds: int = ROUNDS) -> GatedNetwork:
    """A network fitted to all texts.

    First weights come from about `sample` distinct texts (see first_texts). Then, in each round, every part of the
    texts (about PART tokens, dealt by a hash of text and id) trains these weights on all its tokens, and the next
    weights are their mean by tokens. A part is trained by itself, in a task of its own, in the order of its hashes, so
    neither cores nor files decide the result. Only weights travel; sums of about the square root of the number of parts reach the driver.
    """
    network = GatedNetwork(vocabulary.head)
    texts = first_texts(docs, text, sample)
    if texts:
        number, tail, bounds, _, _ = tokens_of(pa.array(texts, pa.string()), vocabulary)
        network.fit(network.inputs(number, tail, vocabulary.head), bounds)
    if n_docs and rounds:
        spark = docs.sparkSession
        parts = -(-vocabulary.total // PART)
        dealt = docs.select(F.col(text).alias("text"), F.xxhash64(text, key).alias("hash")).withColumn("part", F.pmod("hash", F.lit(parts)).cast("int")).join(F.broadcast(seats(spark, parts)), "part")
        table = f"lm_codes_{uuid.uuid4().hex}"
        # written once in buckets of the parts, which each round then reads without a shuffle
        encode(dealt.repartition(parts, "seat"), vocabulary).write.bucketBy(parts, "seat").saveAsTable(table)
        try:
            for k in range(rounds):
                _train_round(spark.table(table), network, parts, 0.003 * (1 - k / rounds * 0.8), k)
        finally:
            spark.sql(f"DROP TABLE {table}")
    network.prepare()
    return network


def seats(spark: SparkSession, parts: int) -> DataFrame:
    """part and seat: for each part a number whose hash names a bucket that no other part has.

    Dealt by the hashes of their own numbers, over a third of the buckets stay empty and some hold five parts, which one
    task then trains in a row.
    """
    wide = math.ceil(parts * (math.log(parts) + 3))
    while True:
        dealt = spark.range(wide).select(F.col("id").cast("int").alias("seat"))
        found = sorted(r["seat"] for r in dealt.groupBy(F.pmod(F.hash("seat"), F.lit(parts))).agg(F.min("seat").alias("seat")).collect())  # a number for each part
        if len(found) == parts:
            return spark.createDataFrame(list(enumerate(found)), "part int, seat int")
        wide *= 2


def encode(dealt: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """part, seat, hash and codes of dealt's rows of text, part, seat and hash: each token's row of the input table, in two bytes, end to end for each text."""
    heads = {w: k for w, k in vocabulary.words.items() if k < vocabulary.head}
    shared = dealt.sparkSession.sparkContext.broadcast(replace(vocabulary, words=heads, counts=vocabulary.counts[: vocabulary.head]))

    def run(batches):
        known = shared.value
        for batch in blocks(batches, "text", BLOCK_BYTES):
            number, tail, bounds, _, _ = tokens_of(batch.column(0), known)
            codes = GatedNetwork.inputs(number, tail, known.head).astype(np.uint16)
            lists = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((2 * bounds).astype(np.int32)), pa.py_buffer(codes)])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists], names=["part", "seat", "hash", "codes"])

    return dealt.select("text", "part", "seat", "hash").mapInArrow(run, "part int, seat int, hash long, codes binary")


def _train_round(encoded: DataFrame, network: GatedNetwork, parts: int, rate: float, seed: int) -> None:
    """Replace the network's weights by the mean, by tokens, of those that each part of the texts has trained."""
    shared = encoded.sparkSession.sparkContext.broadcast(network)
    shapes = {k: a.shape for k, a in network.p.items()}
    cuts = np.cumsum([a.size for a in network.p.values()])[:-1]

    def packed(part, total, n):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["part", "total", "n"])

    def weights(net, n):
        return n * np.concatenate([a.ravel() for a in net.p.values()]).astype(float)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the rows of one part
        net, n = copy.deepcopy(shared.value), 0
        adam = Adam(net.p)
        for batch in blocks(batches, "codes", 4_000_000):
            part = batch.column("part")[0].as_py()
            data, offsets = raw_bytes(batch.column("codes"))
            codes = np.frombuffer(data.tobytes(), np.uint16).astype(np.int64)
            net.fit(codes, offsets // 2, 1, rate, seed, min(WIDE, max(STREAMS, len(codes) // (100 * STEPS))), adam)
            n += len(codes)
        yield packed(part, weights(net, n), n)

    def summed(batches):
        first, total, n = None, 0.0, 0
        for batch in batches:
            for part, own, m in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                first = part if first is None else first
                total, n = total + np.frombuffer(own.as_buffer(), float), n + m
        if n:
            yield packed(first, total, n)

    schema, fan = "part int, total binary, n long", math.ceil(math.sqrt(parts))
    # sums are taken in the order of the parts, so that no rounding hangs on the tasks
    meet = encoded.sortWithinPartitions("seat", "hash", "codes").groupBy("seat").applyInArrow(fitted, schema).repartition(fan, F.floor(F.col("part") / fan)).sortWithinPartitions("part")
    sums = sorted(meet.mapInArrow(summed, schema).collect(), key=lambda r: r["part"])
    mean = sum(np.frombuffer(r["total"], float) for r in sums) / sum(r["n"] for r in sums)
    network.p = {k: a.reshape(shapes[k]).astype(np.float32) for k, a in zip(shapes, np.split(mean, cuts), strict=True)}
    shared.destroy()


def score_documents(docs: DataFrame, learn_from: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score.

    Counts cover all of learn_from; so does the training of the network. The probability of a token is that
    of its class given the text so far, times that of the word in its class: given the text so far for the frequent
    words, (c + 1) / (N + V + 1) over the class's other words for all others, where one place is kept for unknown
    words. Frequent words' counts go to every task (DICTIONARY entries); those of the others meet the
    rare words of each text in a join, and only sums come back.

    Matrix products may round a row by its place in a block, so equal texts come out of the network with differences of
    some 1e-7 of the score. All rows of a text get the least of these values; logarithms of rare words are summed as whole
    billionths, whose sum has no order. So scores of equal texts are equal to the last bit.

    A null text is empty: its only token is the end. Without any text to learn from, score equals base_score (0). Repeated
    rows are scored alike; an empty table gives no rows; columns of the added names are replaced.
    """
    docs = docs.drop("n_tokens", "n_known", "train_tokens", "base_score", "score")
    columns = list(docs.columns if keep is None else keep)
    counts = stored(count_words(learn_from, text), "lm-words")
    n_docs = learn_from.count()
    vocabulary, least = learn_vocabulary(counts, n_docs)
    network = train_network(learn_from, vocabulary, n_docs, text, key)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, network))

    def make():
        known, net = shared.value
        logs = np.log10(known.counts + 1.0)
        room = np.log10(known.tail_total + known.tail_types + 1.0)

        def score(column: pa.Array) -> list[pa.Array]:
            number, tail, bounds, codes, distinct = tokens_of(column, known)
            doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            sums = lambda w: np.bincount(doc, weights=w, minlength=len(bounds) - 1)
            listed = number >= 0
            own = np.where(listed, logs[number], 0.0)
            model = net.score(number, tail, bounds, known.head) / np.log(10) + sums(np.where(number >= known.head, own, 0.0) - np.where((number < 0) | (number >= known.head), room[tail], 0.0))
            rare = np.flatnonzero(~listed)
            pairs, n = np.unique(doc[rare] * max(len(distinct), 1) + codes[rare], return_counts=True)
            ends = np.searchsorted(pairs, np.arange(len(bounds)) * max(len(distinct), 1))
            rows = pa.StructArray.from_arrays([distinct.take(pa.array(pairs % max(len(distinct), 1))).cast(pa.binary()), pa.array(n.astype(np.int32))], names=["word", "n"])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), rows)
            seen = sums((listed & (known.counts[number] > 0)).astype(float)).astype(np.int64)
            return [pa.array(np.diff(bounds).astype(np.int64)), pa.array(seen), pa.array(sums(own)), pa.array(model), lists]

        return score

    # texts are dealt anew, as a file may have all of them in one row group; near lengths meet in a block, where texts advance together
    marked = docs.withColumn("__tid", text_id(F.coalesce(text, F.lit("")))).withColumn("__hash", F.xxhash64(text, key))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    marked = marked.repartition(1 + size // (2 * BLOCK_BYTES), "__hash").sortWithinPartitions(F.octet_length(text), "__hash", "__tid")
    parts = per_text(marked, text, make, "n_tokens long, __known long, __logs double, __model double, __rare array<struct<word: binary, n: int>>", [*columns, "__tid"], BLOCK_BYTES)
    parts = stored(parts.withColumn("__row", F.monotonically_increasing_id()), "lm-parts")
    rare = parts.select("__row", F.explode("__rare").alias("r")).select("__row", "r.word", "r.n")
    joined = rare.join(counts.where(F.col("c") < least), "word")
    found = joined.groupBy("__row").agg(F.sum(F.col("n") * F.round(F.log10(F.col("c") + 1) * BILLION).cast("long")).alias("__rare_logs"), F.sum("n").alias("__rare_known"))
    alike = stored(parts.groupBy("__tid").agg(F.min("__model").alias("__model"), F.count("*").alias("__times")), "lm-texts")
    model = with_facts(parts.select("__row", "__tid"), alike, "__tid", "__times").select("__row", "__model")
    rows = parts.drop("__rare", "__tid", "__model").join(model, "__row").join(found, "__row", "left")
    logs = F.coalesce("__rare_logs", F.lit(0)) / BILLION
    base = F.col("__logs") + logs - F.col("n_tokens") * F.lit(float(np.log10(vocabulary.total + vocabulary.types + 1)))
    score = F.col("__model") + logs if vocabulary.total else base
    known = F.col("__known") + F.coalesce("__rare_known", F.lit(0)).cast("long")
    return rows.select(*columns, "n_tokens", known.alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
