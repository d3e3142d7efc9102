"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from cardiolake.llm import decontamination, language, mixing, near_duplicates, queries, quality, recurrent_lm, sharding, substrings, token_files, toxicity

LONG = "the quick brown fox jumps over a lazy dog near river bank number seven " * 400
ROWS = [
    (1, "the quick brown fox jumps over a lazy dog near the river bank", "en", "a"),
    (2, "the quick brown fox jumps over a lazy dog near the river bank", "en", "a"),
    (3, None, "en", None),
    (4, "", None, "b"),
    (5, " \n\t", "fr", "b"),
    (None, "un renard brun saute par dessus le chien paresseux près de la rivière", "fr", None),
    (6, LONG, "en", "a"),
    (7, "Éa!", "fr", "c"),
    (7, "Éa!", "fr", "c"),
    (8, "0123 4567", None, "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = ["size", "score", "n_words", "spans", "items", "slot", "shard", "class_id", "kept", "predicted", "lang_pred", "n_bytes", "taken", "target", "bucket", "tid", "key", "row", "word", "rid", "n"]


def run(spark, name, docs):
    if name == "shard":
        return sharding.shard_documents(docs)
    if name == "near":
        return near_duplicates.near_duplicates(docs)
    if name == "leaks":
        items = spark.createDataFrame([("i1", "brown fox jumps over a lazy dog near the river"), ("i2", "Éa"), ("i3", None), ("i4", ""), (None, "the quick")], "item_id string, text string")
        return decontamination.decontaminate(docs, items)
    if name == "leaks_joined":
        items = spark.createDataFrame([("i1", "brown fox jumps over a lazy dog near the river"), ("i2", "Éa"), ("i3", None), ("i4", ""), (None, "the quick")], "item_id string, text string")
        return decontamination.decontaminate(docs, items, block_windows=0)
    if name == "lm":
        return recurrent_lm.score_documents(docs, docs.where("doc_id is null or doc_id <> 2"))
    if name == "repeats":
        return substrings.remove_repeats(docs)
    if name == "mix":
        return mixing.mix_sources(docs)
    if name == "quality":
        return quality.judge(docs, queries.VOCABULARIES)
    if name == "toxic":
        labels = spark.createDataFrame([(1, 0), (2, 1), (6, 0), (7, 1), (None, 1), (8, None)], "doc_id long, toxic int")
        return toxicity.score_toxicity(docs, toxicity.train(docs, labels))
    if name == "lang":
        return language.identify(docs, language.train(docs))
    raise KeyError(name)


NAMES = ["shard", "near", "leaks", "leaks_joined", "lm", "repeats", "mix", "quality", "toxic", "lang"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_and_clashing_columns(spark, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASH:
        docs = docs.withColumn(c, F.lit("x"))
    out = run(spark, name, docs)
    rows = out.collect()
    assert len(rows) == len(ROWS)
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    by = {(r["doc_id"]): r for r in rows}
    if name == "shard":
        assert by[3]["size"] == 1 and by[3]["text_crc32"] == 0 and by[1]["shard"] == by[2]["shard"]
        for s in range(8):
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    if name == "near":
        assert by[1]["class_id"] == by[2]["class_id"] == 1 and by[1]["n_links"] == 1 and by[3]["class_id"] == 3 and by[4]["n_links"] == 0 and by[7]["n_links"] == 1
    if name.startswith("leaks"):
        assert by[1]["n_hit"] == 12 and by[1]["contaminated"] and by[7]["items"] == ["i2"] and not by[3]["contaminated"] and by[3]["n_words"] == 0
    if name == "lm":
        assert by[3]["n_tokens"] == by[4]["n_tokens"] == 1 and by[3]["score"] == by[4]["score"] and by[1]["base_score"] == by[2]["base_score"]
    if name == "repeats":
        n = len(LONG.encode())
        assert by[6]["n_bytes"] == n and by[6]["n_removed"] > 0 and by[1]["n_removed"] == 0 and by[3]["n_bytes"] == 0
    if name == "mix":
        assert all(r["taken"] <= 2 * r["size"] for r in rows) and by[3]["taken"] == 0
    if name == "quality":
        assert by[3]["base_failed"] and not by[3]["kept"] and by[1]["kept"]
    if name == "toxic":
        assert all(0 <= r["score"] <= 1 for r in rows) and by[3]["score"] == by[4]["score"]
    if name == "lang":
        assert by[3]["lang_pred"] == by[4]["lang_pred"] == by[8]["lang_pred"] == "und" and by[1]["lang_pred"] in ("en", "fr")


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert run(spark, name, spark.createDataFrame([], SCHEMA)).count() == 0


def test_tokens_of_odd_rows(spark, tmp_path):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    token_files.write_tokens(spark.createDataFrame(ROWS, SCHEMA), f"{tmp_path}/t", path)
    rows = token_files.read_tokens(spark, f"{tmp_path}/t").orderBy("start").collect()
    assert len(rows) == len(ROWS) and rows[0]["doc_id"] is None and rows[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (3, 4)] == [1, 1]
    token_files.write_tokens(spark.createDataFrame([], SCHEMA), f"{tmp_path}/e", path)
    assert token_files.read_tokens(spark, f"{tmp_path}/e").count() == 0


def test_rows_that_are_all_equal(spark):
    """Thousands of equal rows of few texts: nothing that is learned or dealt may hang on which of them a hash picks."""
    texts = ["the quick brown fox jumps over the lazy dog near the river bank", "un renard brun saute par dessus le chien paresseux près de la rivière", "nur ein kurzer satz"]
    docs = spark.range(6_000).select(F.lit(5).cast("long").alias("doc_id"), F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 3 + 1).cast("int")).alias("text"), F.element_at(F.array(*map(F.lit, ("en", "fr", "de"))), (F.col("id") % 3 + 1).cast("int")).alias("lang"))
    found = language.identify(docs, language.train(docs)).groupBy("lang", "lang_pred").count().collect()
    assert sorted((r["lang"], r["lang_pred"], r["count"]) for r in found) == [("de", "de", 2_000), ("en", "en", 2_000), ("fr", "fr", 2_000)]
    links = near_duplicates.near_duplicates(docs).groupBy("class_id", "n_links", "is_first").count().collect()
    assert {(r["class_id"], r["n_links"]) for r in links} == {(5, 1_999)}
    shards = sharding.shard_documents(docs, 2).collect()
    assert len(shards) == 6_000 and all(sorted(r["slot"] for r in shards if r["shard"] == k) == list(range(sum(r["shard"] == k for r in shards))) for k in (0, 1))
    scores = recurrent_lm.score_documents(docs, docs).groupBy("text").agg(F.countDistinct("score").alias("n"), F.min("score").alias("s"), F.min("base_score").alias("b")).collect()
    assert all(r["n"] == 1 and r["s"] > r["b"] for r in scores)


def test_tokens_of_equal_ids_and_special_strings(spark, tmp_path, monkeypatch):
    """Ids are those of the plain library, special strings included, and `start` is the place in the files."""
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y z", "<|endof", "text|> tail", "it's <|endoftext |> not", "word. <|endoftext|>"] + [f"text number {i} of one id" for i in range(30)] + ["same"] * 40
    monkeypatch.setattr(token_files, "ROWS_A_FILE", 10)
    token_files.write_tokens(spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string").repartition(3), f"{tmp_path}/t", path)
    rows = sorted(token_files.read_tokens(spark, f"{tmp_path}/t").collect(), key=lambda r: r["start"])
    stored = [r for f in sorted((tmp_path / "t").glob("part-*.orc")) for r in spark.read.orc(str(f)).orderBy("first").collect()]
    assert len({f.name for f in (tmp_path / "t").glob("part-*.orc")}) > 4
    start = 0
    for row, kept in zip(rows, stored, strict=True):
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(kept["ids"]), zlib.crc32(np.array(kept["ids"], "<u4").tobytes()))
        start += row["n_tokens"]
    want = sorted([*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts)
    assert sorted(r["ids"] for r in stored) == want


def test_whole_rounds_leave_documents_without_words_alone(spark):
    docs = spark.createDataFrame([(i, "w " * 5 if i % 2 else "", "small" if i < 40 else "large") for i in range(400)], "doc_id long, text string, source string")
    rows = mixing.mix_sources(docs, share=1.9, most=2.0, weights=(1, 500)).collect()
    assert max(r["copies"] for r in rows) == 2 and any(r["target"] == 2 * r["source_size"] for r in rows)


def _scanned(frame):
    """Rows that the scan of the frame's files gives out."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
    return plan.metrics().apply("numOutputRows").value()


def test_token_files_skip_what_cannot_hold_an_id(spark, tmp_path):
    """A folder named like a part changes no place; row indexes and Bloom filters leave rows out before they are read."""
    path = f"{tmp_path}/part-7/t"
    token_files.write_tokens(spark.range(6_000).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")), path, queries.tokenizer_path("byte_bpe_50k.json"), files=3)
    rows = token_files.read_tokens(spark, path).orderBy("doc_id").collect()
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:])) and rows[0]["start"] == 0
    files = spark.read.orc(path)
    assert _scanned(files) == 6_000
    assert 0 < _scanned(files.where("doc_id = 5000")) <= 1_000
    # odd ids lie between the least and the largest of a stripe: the Bloom filter alone knows that they are not there
    assert sum(_scanned(files.where(f"doc_id = {i}")) for i in range(5_001, 5_041, 2)) <= 2_000


def test_words_are_encoded_without_a_pool(monkeypatch):
    """A batch of tiktoken hands every word to a thread; words one by one give the same ids."""
    import tiktoken

    from cardiolake.llm.queries import VOCABULARIES

    words = ["", "a", "Straße", "日本語", "naïve", "🙂🙂", "x" * 300, "#$%"]
    path, pattern = VOCABULARIES["byte"]()
    coder = quality.Fertility(path, pattern)
    encode_batch, ranks = tiktoken.Encoding.encode_ordinary_batch, []
    monkeypatch.setattr(tiktoken.Encoding, "__init__", lambda self, *a, _old=tiktoken.Encoding.__init__, **k: (_old(self, *a, **k), ranks.append(self))[0])
    found = quality.Fertility(path, pattern)
    want = encode_batch(ranks[0], [f" {w}" for w in words], num_threads=1)
    monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary_batch", lambda *a, **k: 1 / 0)
    assert coder.encode(words) == found.encode(words) == want
