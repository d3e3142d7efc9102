"""Scores of the learned operators by plain versions, slots of many equal rows, mixes with ties, and texts of megabytes."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cardiolake.llm import language, mixing, sharding, toxicity

from test_edges import NAMES, run

ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def test_slots_of_many_equal_rows(spark, monkeypatch):
    """A pair of id and text with most of all rows is numbered in parts; all other rows keep their slots' order."""
    monkeypatch.setattr(sharding, "CHUNK", 50)
    windows = []
    real = sharding._split_crowds

    def spied(*args):
        placed, counts = real(*args)
        windows.append((counts.agg(F.max("count")).first()[0], counts.where("__part > 0").count()))
        return placed, counts

    monkeypatch.setattr(sharding, "_split_crowds", spied)
    rows = [(None, "the same text")] * 3_000 + [(i, f"text {i}") for i in range(500)] + [(7, None)] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for parts in (3, 8):
        got = sharding.shard_documents(docs.repartition(parts), 4).collect()
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
        for k in range(4):
            own = sorted(r["slot"] for r in got if r["shard"] == k)
            assert own == list(range(len(own)))
        found[parts] = {(r["doc_id"], r["text"]): (r["shard"], r["slot"]) for r in got if r["text"] not in (None, "the same text")}
    assert found[3] == found[8] and len(found[3]) == 500
    # 3,000 and 400 rows in parts of about 50
    assert all(most <= 4 * 50 and parts == 60 + 8 for most, parts in windows) and len(windows) == 2


def test_shards_without_crowds_are_not_split(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_split_crowds", None)
    docs = spark.createDataFrame([(i, f"text {i % 50}") for i in range(300)], "doc_id long, text string")
    assert sharding.shard_documents(docs).count() == 300


def test_mix_with_ties(spark):
    """Equal ids tie at the threshold and go together; targets of many sources equal a plain dealing-out."""
    docs = spark.createDataFrame([(i % 7, "w " * 10, f"s{i % 11:02d}" if i % 13 else None) for i in range(2_000)], "doc_id long, text string, source string")
    rows = mixing.mix_sources(docs).collect()
    copies = {}
    for r in rows:
        assert copies.setdefault((r["source"], r["doc_id"]), r["copies"]) == r["copies"] and r["copies"] <= 2
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    target |= {s: level * weight[s] for s in free}
    assert {r["source"] for r in rows} == set(target) and all(math.isclose(r["target"], target[r["source"]]) for r in rows)


def plain_window(net, x):
    """Log-probabilities of one window by one-hot convolution, loops over places and filters."""
    hidden = []
    for w, table in zip(language.WIDTHS, net.filters, strict=True):
        for f in range(language.FILTERS):
            hidden.append(max(sum(float(table[k][x[i + k]][f]) for k in range(w)) for i in range(language.WINDOW - w + 1)))
    hidden = [max(h + float(b), 0.0) for h, b in zip(hidden, net.bias, strict=True)]
    z = [sum(h * float(net.out[i][j]) for i, h in enumerate(hidden)) + float(net.out_bias[j]) for j in range(len(net.labels))]
    total = math.log(sum(math.exp(v) for v in z))
    return [v - total for v in z]


def test_language_scores_by_a_plain_convolution(spark):
    net = language.ByteNetwork(["aa", "bb", "cc"], seed=3)
    rng = np.random.default_rng(4)
    net.bias, net.out_bias = (rng.normal(0, 0.2, len(p)).astype(np.float32) for p in (net.bias, net.out_bias))
    net.prepare()
    texts = ["Ein kurzer Satz, 12 Wörter?", "x" * 300, "".join(ALPHABET[i] for i in rng.integers(0, 26, 333)), "été 7 " * 30]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()}
    for i, t in enumerate(texts):
        data = np.frombuffer(t.encode(), np.uint8)
        begin, end, _ = language.windows(np.array([0, len(data)]))
        each = [plain_window(net, x) for x in language.byte_classes(data, begin, end)]
        mean = np.mean(each, 0)
        p = np.exp(mean) / np.exp(mean).sum()
        assert got[i]["lang_pred"] == net.labels[int(p.argmax())] and math.isclose(got[i]["score"], p.max(), rel_tol=1e-4)


def test_ties_of_languages_go_to_the_first(spark):
    net = language.ByteNetwork(["aa", "bb"])
    net.out[:] = 0
    net.prepare()
    got = language.identify(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), net).first()
    assert (got["lang_pred"], got["score"]) == ("aa", 0.5)


def test_language_gradients_against_finite_differences():
    """The first step of Adam moves each weight against the sign of its gradient: that of finite differences."""
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, language.N_CLASSES, (3, language.WINDOW)), np.array([0, 1, 2])

    def fresh():
        net = language.ByteNetwork(["a", "b", "c"], seed=9)
        net.filters = [f.astype(float) for f in net.filters]
        net.bias, net.out, net.out_bias = net.bias.astype(float) + 0.01, net.out.astype(float), net.out_bias.astype(float)
        return net

    def loss(net):
        top, _ = net._pooled(x)
        z = np.maximum(top + net.bias, 0) @ net.out + net.out_bias
        return -np.mean(z[np.arange(3), y] - np.log(np.exp(z).sum(1)))

    params = lambda net: [*net.filters, net.bias, net.out, net.out_bias]
    moved, start = fresh(), fresh()
    moved.fit(x, y, epochs=1)
    checked = 0
    for k, (after, before) in enumerate(zip(params(moved), params(start), strict=True)):
        change = (after - before).ravel()
        for i in rng.permutation(np.flatnonzero(np.abs(change) > 1e-6))[:25].tolist():
            net, sides = fresh(), []
            for shift in (1e-5, -1e-5):
                flat = params(net)[k].ravel()
                kept = flat[i]
                flat[i] = kept + shift
                sides.append(loss(net))
                flat[i] = kept
            slope = (sides[0] - sides[1]) / 2e-5
            if abs(slope) > 1e-6:
                assert np.sign(slope) == -np.sign(change[i])
                checked += 1
        untouched = np.flatnonzero(change == 0)
        if len(untouched):  # weights of bytes that win no place have no gradient
            net = fresh()
            params(net)[k].ravel()[untouched[0]] += 1e-7
            assert math.isclose(loss(net), loss(start), abs_tol=1e-12)
    assert checked > 60


def plain_segments(scores, low=0):
    """By the definition: the best stretch, then those left and right of it."""
    sums = np.concatenate([[0], np.cumsum(scores)])
    pairs = [(sums[b] - sums[a], -(b - a), -a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
    if not pairs or max(pairs)[0] <= 0:
        return []
    s, _, a, b = max(pairs)
    return plain_segments(scores[:-a], low) + [(low - a, low + b, s)] + plain_segments(scores[b:], low + b)


def test_toxicity_scores_by_a_plain_version(spark):
    """Token scores, segments, E-values, evidence and the logistic curve, one text at a time."""
    model = toxicity.ToxicModel(words={b"vile": 3.7, b"foulmouth": 2.9, b"wordy": -0.15}, stems={b"nast": 3.1, b"word": 3.3}, rate=0.8, k=0.05, slope=2.5, base=-3.0)
    rng = np.random.default_rng(6)
    words = ["vile", "foulmouth", "nasty", "Nastier", "wordy", "wordless", "calm", "quiet", "plain", "sea"]
    texts = [" ".join(words[i] for i in rng.integers(0, 10, int(n))) for n in rng.integers(0, 40, 40)] + ["", "calm " * 30, "nasty"]
    docs = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    for i, t in enumerate([*texts, ""]):
        own = [w.lower().encode() for w in t.split()]
        scores = [model.words[w] if w in model.words else model.stems.get(w[:4], model.drift) for w in own]
        best, total, passages = 0.0, 0.0, []
        for a, b, s in plain_segments(scores):
            e = 0.05 * len(own) * math.exp(-0.8 * s)
            p = -math.expm1(-e)
            best = max(best, -math.log(p))
            if e < 0.05:
                total += -math.log(p)
                passages.append((a, b))
        score = 1 / (1 + math.exp(3.0 - 2.5 * math.log(1 + max(total, best))))
        assert math.isclose(got[i]["score"], score, rel_tol=1e-9) and got[i]["predicted"] == int(score >= 0.5)
        assert [(p["first"], p["behind"]) for p in got[i]["passages"]] == passages


def test_log_odds_and_calibration_by_a_plain_version(spark):
    """Stems and words that training keeps, their log-odds by the formula, the root of the rate and the logistic optimum."""
    rng = np.random.default_rng(8)
    common = [f"{ALPHABET[i % 26]}{ALPHABET[i // 26]}qu{ALPHABET[i % 7]}" for i in range(300)]
    rows, labels = [], []
    for i in range(120):
        own = [common[k] for k in rng.integers(0, 300, 40)]
        if i % 3 == 0:
            own[5:8] = ["zorgly", "zorgish", "brakk"]
        rows.append((i, " ".join(own)))
        labels.append((i, int(i % 3 == 0)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    counts = {0: Counter(), 1: Counter()}
    for (_, t), (_, y) in zip(rows, labels, strict=True):
        counts[y].update(set(t.split()))
    n = {y: sum(c.values()) for y, c in counts.items()}

    def odds(t, c, prior_t, prior_c):
        t, c = t + 50 * prior_t + 0.5, c + 50 * prior_c + 0.5
        value = math.log(t / (n[1] + 51 - t)) - math.log(c / (n[0] + 51 - c))
        return value, value / math.sqrt(1 / t + 1 / c)

    stems, words = {}, {}
    by_stem = {y: Counter() for y in (0, 1)}
    for y in (0, 1):
        for w, k in counts[y].items():
            by_stem[y][w[:4]] += k
    for s in by_stem[0] | by_stem[1]:
        share = (by_stem[1][s] + by_stem[0][s]) / (n[0] + n[1])
        value, z = odds(by_stem[1][s], by_stem[0][s], share, share)
        if z > 3 and value > 3:
            stems[s.encode()] = value
        pt, pc = ((by_stem[y][s] + 50 * share) / (n[y] + 50) for y in (1, 0))
        for w in (w for w in counts[0] | counts[1] if w[:4] == s):
            value, z = odds(counts[1][w], counts[0][w], pt, pc)
            if z > 3 and value > 3:
                words[w.encode()] = value
    assert set(model.stems) == set(stems) == {b"zorg", b"brak"} and all(math.isclose(model.stems[s], v, rel_tol=1e-9) for s, v in stems.items())
    assert {w for w, v in model.words.items() if v > 0} == set(words) and all(math.isclose(model.words[w], v, rel_tol=1e-9) for w, v in words.items())
    # the rate solves its equation, the logistic weights have no slope left
    values, others = np.array([3.0, 2.0, 4.5]), 500.0
    x = toxicity._rate(values, others, -0.15)
    assert x > 0.1 and abs((np.exp(x * values).sum() + others * math.exp(-0.15 * x)) / 503 - 1) < 1e-9
    t, y, w = rng.normal(0, 1, 60), rng.integers(0, 2, 60), rng.uniform(0.5, 2, 60)
    slope, base = toxicity._logistic(t, y, w)
    loss = lambda a, b: float(np.sum(w * (np.log1p(np.exp(a * t + b)) - y * (a * t + b)))) + 0.5 * a * a + 0.0005 * b * b
    assert all(loss(slope, base) <= loss(slope + d, base + e) for d in (-1e-3, 0, 1e-3) for e in (-1e-3, 0, 1e-3))
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert found == dict(labels)


def test_equal_toxicity_for_equal_rows(spark):
    model = toxicity.ToxicModel(words={b"vile": 5.0}, slope=3.0)
    docs = spark.createDataFrame([(i % 3, "a vile vile text" if i % 2 else None) for i in range(40)], "doc_id long, text string").repartition(5)
    assert docs.count() == 40 and len({r["score"] for r in toxicity.score_toxicity(docs, model).collect()}) == 2


@pytest.fixture(scope="module")
def long_rows():
    """A text of 3 MB of distinct words, one of 2 MB in one word, and short ones."""
    words = " ".join(hashlib.md5(str(i).encode()).hexdigest()[: 3 + i % 9] for i in range(400_000))
    rng = np.random.default_rng(10)
    word = "".join(ALPHABET[i] for i in rng.integers(0, 26, 2_000_000))
    rows = [(1, words, "en", "a"), (2, word, "fr", "b"), (3, words[: len(words) // 2] + " behind", "en", "a")]
    return rows + [(10 + i, f"the quick brown fox number {i} jumps over a lazy dog near the river bank", "en", "a") for i in range(20)]


@pytest.mark.parametrize("name", NAMES)
def test_texts_of_megabytes(spark, name, long_rows):
    """Whole texts count: nothing is cut, and no block is too small for one."""
    docs = spark.createDataFrame(long_rows, "doc_id long, text string, lang string, source string").repartition(3, "doc_id")
    rows = run(spark, name, docs).drop("text").collect()
    by, text = {r["doc_id"]: r for r in rows}, {r[0]: r[1] for r in long_rows}
    assert len(rows) == len(long_rows) and set(by) == set(text)
    n = {i: len(t.split()) for i, t in text.items()}
    if name == "shard":
        assert all(by[i]["size"] == len(t) + 1 and by[i]["text_crc32"] == zlib.crc32(t.encode()) for i, t in text.items())
    if name == "near":
        assert by[1]["class_id"] == 1 and by[1]["n_links"] == by[2]["n_links"] == by[3]["n_links"] == 0
    if name.startswith("leaks"):
        assert all(by[i]["n_words"] >= n[i] for i in text) and not by[2]["contaminated"] and by[10]["contaminated"] == ("the quick" in text[10])
    if name == "lm":
        assert all(by[i]["n_tokens"] == n[i] + 1 for i in text) and by[1]["score"] < by[3]["score"] < by[10]["score"] < 0
    if name == "repeats":
        half = len(text[3]) - len(" behind")
        assert by[1]["n_removed"] in (half, half + 1) and by[1]["n_spans"] == by[3]["n_spans"] == 1 and by[2]["n_removed"] == 0
    if name == "mix":
        assert all(by[i]["size"] == n[i] for i in text)
    if name == "quality":
        assert all(by[i]["n_words"] == n[i] for i in text) and by[2]["base_failed"]
    if name == "toxic":
        assert all(0 <= r["score"] <= 1 for r in rows)
    if name == "lang":
        assert all(by[i]["lang_pred"] == "en" for i in text if i >= 10)
