"""What the operators learn from: all of their texts, however small a share of them the first sample is."""

import tracemalloc
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cardiolake.llm import recurrent_lm, toxicity


def test_the_network_learns_from_texts_outside_the_first_sample(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{(k + s) % 12}" for k in range(60)) for s in rng.integers(0, 12, 400)] + [""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    vocabulary, _ = recurrent_lm.learn_vocabulary(recurrent_lm.count_words(docs, "text"), len(texts))
    number, tail, bounds, _, _ = recurrent_lm.tokens_of(pa.array(texts), vocabulary)
    untrained = recurrent_lm.GatedNetwork(vocabulary.head)
    untrained.prepare()
    network = recurrent_lm.train_network(docs, vocabulary, len(texts), "text", "doc_id", sample=0)
    per_token = [net.score(number, tail, bounds, vocabulary.head).sum() / len(number) for net in (untrained, network)]
    assert per_token[1] > per_token[0] + 1


def test_no_token_is_too_few_to_train_on():
    for n in (1, 2, 97):
        network = recurrent_lm.GatedNetwork(10)
        before = network.p["cb"].copy()
        network.fit(np.arange(n) % 10, np.array([0, n]), epochs=1)
        assert (network.p["cb"] != before).any() and all(np.isfinite(a).all() for a in network.p.values())


def test_toxic_texts_made_of_clean_ones_stay_in_training(spark):
    rng = np.random.default_rng(6)
    words = lambda n: [f"w{k}" for k in rng.integers(0, 5_000, n)]
    clean = [words(60) for _ in range(20)]
    toxic = [c + words(60) for c in clean]
    copy = words(60)
    rows = [(" ".join(c), 0) for c in clean] + [(" ".join(t), 1) for t in toxic] + [(" ".join(copy), y) for y in (0, 0, 0, 1, 1)]
    got = sorted(map(tuple, toxicity._unlike(spark.createDataFrame(rows, "text string, __y int")).collect()))
    assert got == sorted(set(rows))


def test_the_first_sample_is_of_distinct_texts(spark):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("one text for all rows").alias("text")).unionByName(spark.createDataFrame([(1, "x" * 200_000), (2, "other"), (3, None)], "doc_id long, text string"))
    assert set(recurrent_lm.first_texts(docs, "text", 400)) <= {"one text for all rows", "other", ""} and "one text for all rows" in recurrent_lm.first_texts(docs, "text", 400)
    assert len(recurrent_lm.first_texts(docs.where("doc_id > 3"), "text", 400)) == 1 and recurrent_lm.first_texts(docs, "text", 0) == []


def test_weights_do_not_hang_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(recurrent_lm, "PART", 3_000)
    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in rng.zipf(1.5, 40) % 50)) for i in range(300)], "doc_id long, text string")
    found = []
    for parts in (2, 7):
        dealt = docs.repartition(parts)
        vocabulary, _ = recurrent_lm.learn_vocabulary(recurrent_lm.count_words(dealt, "text"), 300)
        assert vocabulary.total // 3_000 > 2
        found.append(recurrent_lm.train_network(dealt, vocabulary, 300, "text", "doc_id", sample=20, rounds=2))
    assert all((found[0].p[k] == found[1].p[k]).all() for k in found[0].p)


def test_every_part_has_a_task_of_its_own(spark, monkeypatch):
    """Dealt by the hashes of their own numbers, parts met in a bucket, and a bucket's file, or several, in one task."""
    for parts in (1, 2, 12, 58):
        seats = recurrent_lm.seats(spark, parts).select("part", "seat", F.pmod(F.hash("seat"), F.lit(parts)).alias("bucket")).collect()
        assert {r["part"] for r in seats} == {r["bucket"] for r in seats} == set(range(parts)) and len(seats) == parts
    monkeypatch.setattr(recurrent_lm, "PART", 1_000)
    docs = spark.createDataFrame([(i, " ".join(f"w{k % 50}" for k in range(i, i + 40))) for i in range(300)], "doc_id long, text string")
    vocabulary, _ = recurrent_lm.learn_vocabulary(recurrent_lm.count_words(docs, "text"), 300)
    tasks = []

    def count(encoded, network, parts, rate, seed):
        from pyspark import TaskContext

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array([TaskContext.get().partitionId()] * batch.num_rows, pa.int32())], names=["part", "task"])

        plan = encoded.groupBy("seat").applyInArrow(own, "part int, task int")
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
        tasks.append(({tuple(r) for r in plan.collect()}, parts))

    monkeypatch.setattr(recurrent_lm, "_train_round", count)
    recurrent_lm.train_network(docs, vocabulary, 300, "text", "doc_id", sample=0, rounds=1)
    ((found, parts),) = tasks
    assert parts == 13 and len(found) == len({part for part, _ in found}) == len({task for _, task in found}) == 13


def test_scores_do_not_hang_on_partitions(spark):
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in rng.zipf(1.5, 5 + i % 90) % 50)) for i in range(300)], "doc_id long, text string")
    found = [recurrent_lm.score_documents(dealt, dealt).select("doc_id", "score").orderBy("doc_id").collect() for dealt in (docs.coalesce(1), docs.repartition(7))]
    assert found[0] == found[1]


def test_gradients_against_finite_differences():
    rng = np.random.default_rng(7)
    network = recurrent_lm.GatedNetwork(recurrent_lm.HEAD_CLASSES * recurrent_lm.HEAD_WIDTH)
    network.p = {k: (a + rng.normal(0, 0.2, a.shape)).astype(np.float64) for k, a in network.p.items()}
    rows = rng.integers(0, recurrent_lm.HEAD_CLASSES * recurrent_lm.HEAD_WIDTH + recurrent_lm.TAIL_CLASSES, (5, 3))
    new, live = np.zeros((5, 3), bool), np.ones((5, 3), bool)
    new[0] = new[2, 1] = True
    live[4, 2] = False
    x = np.where(new, network.START, np.roll(rows, 1, 0))
    heads = recurrent_lm.HEAD_CLASSES * recurrent_lm.HEAD_WIDTH

    def loss():
        h, total = np.zeros((3, recurrent_lm.UNITS)), 0.0
        for t in range(5):
            h, _ = network.step(h * (~new[t])[:, None], x[t])
            classes = network.log_class(h)
            for s in np.flatnonzero(live[t]):
                r = rows[t, s]
                group = r // recurrent_lm.HEAD_WIDTH if r < heads else recurrent_lm.HEAD_CLASSES + r - heads
                total -= classes[s, group] + (network.log_word(h[s : s + 1], group)[0, r % recurrent_lm.HEAD_WIDTH] if r < heads else 0)
        return total / live.sum()

    grads, _ = network._gradients(x, rows, new, live, np.zeros((3, recurrent_lm.UNITS), np.float32))
    for k, g in grads.items():
        for place in np.argsort(-np.abs(g.ravel()))[:4].tolist() + rng.integers(0, g.size, 2).tolist():
            at = np.unravel_index(place, g.shape)
            kept, network.p[k][at] = network.p[k][at], network.p[k][at] + 1e-4
            up = loss()
            network.p[k][at] = kept - 1e-4
            down = loss()
            network.p[k][at] = kept
            assert abs((up - down) / 2e-4 - g[at]) < 2e-4 + 0.02 * abs(g[at]), (k, at)


def test_a_window_of_training_takes_over_the_arrays_of_the_one_before():
    rng = np.random.default_rng(8)
    network = recurrent_lm.GatedNetwork(recurrent_lm.HEAD_CLASSES * recurrent_lm.HEAD_WIDTH)
    shape = (recurrent_lm.STEPS, recurrent_lm.WIDE)
    x, target = (rng.integers(0, network.START, shape) for _ in range(2))
    new, live, h = rng.random(shape) < 0.01, np.ones(shape, bool), np.zeros((recurrent_lm.WIDE, recurrent_lm.UNITS), np.float32)
    first, last = network._gradients(x, target, new, live, h)
    kept = {k: g.copy() for k, g in first.items()}, last.copy()
    tracemalloc.start()
    again, _ = network._gradients(x, target, new, live, h)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    one = 4 * recurrent_lm.UNITS * x.size  # bytes of the states
    assert most < 8 * one
    # what a window returns stays as it is when the next one is taken
    network._gradients(target, x, ~new, live, last)
    assert all((again[k] == kept[0][k]).all() and (first[k] == kept[0][k]).all() for k in again) and (last == kept[1]).all()


def test_gates_out_of_the_range_of_exp():
    rng = np.random.default_rng(9)
    network = recurrent_lm.GatedNetwork(recurrent_lm.HEAD_CLASSES * recurrent_lm.HEAD_WIDTH)
    network.p["x"] *= 2_000
    rows = rng.integers(0, network.START, 40)
    network.prepare()
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        got = network.score(rows, np.zeros(40, np.int64), np.array([0, 40]), network.START)[0]
        network._gradients(np.full((1, 40), network.START), rows[None], np.ones((1, 40), bool), np.ones((1, 40), bool), np.zeros((40, recurrent_lm.UNITS), np.float32))
    h, total = np.zeros((1, recurrent_lm.UNITS), np.float32), 0.0
    for t in range(40):
        h, _ = network.step(h, np.array([network.START if t == 0 else rows[t - 1]]))
        total += network.log_probability(h, rows[t : t + 1], np.array([0]), network.START)[0]
    assert got == pytest.approx(total, rel=1e-4)
