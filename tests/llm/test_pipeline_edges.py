"""Each stage of the pipeline on nulls, empty texts, repeated rows, clashing columns and empty tables, and the mix of large groups."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CLASH = ["size", "score", "predicted", "passages", "n_words", "n_hit", "spans", "items", "contaminated", "copies", "taken", "target", "source_size", "class_id", "key", "tid", "word", "row", "n"]
TEXT = "many words of one plain text that nobody has to hold against anybody at all"
ROWS = [(None, TEXT, "en", "a"), (1, TEXT, "en", "a"), (1, TEXT, "en", "a"), (2, None, None, None), (3, "", "en", "b"), (4, " \n ", "fr", "b"), (5, TEXT + " and some more words behind it to make another text of it", "en", None), (6, "short", None, "c")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    for c in CLASH:
        rows = rows.withColumn(c, F.lit(f"own {c}"))
    return rows


def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", ["toxicity", "near_copies", "leaks", "mix"])
def test_columns_and_odd_rows_pass(spark, docs, name):
    out = stages()[name](spark, docs, SF)
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in CLASH)
    got, given = Counter((r["doc_id"], r["text"]) for r in rows), Counter((i, t) for i, t, _, _ in ROWS)
    if name in ("toxicity", "leaks"):
        assert got == given
    if name == "near_copies":
        assert got == Counter({(1, TEXT): 1} | {(i, t): 1 for i, t, _, _ in ROWS if i not in (None, 1)})
    if name == "mix":
        assert set(got) <= set(given) and all(n <= 2 * given[k] for k, n in got.items())


def test_shards_of_odd_rows(spark, docs):
    rows = stages()["shard"](spark, docs, SF).collect()
    assert len(rows) == len(ROWS) and len({r["shard"] for r in rows if r["text"] == TEXT}) == 1


@pytest.mark.parametrize("name", ["toxicity", "near_copies", "leaks", "mix", "shard"])
def test_empty_tables(spark, docs, name):
    assert stages()[name](spark, docs.limit(0), SF).count() == 0


def test_toxic_documents_go_and_others_stay(spark):
    """The stage rejects what the operator predicts, and nothing else."""
    from cardiolake.llm import queries

    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    toxic = {r["doc_id"] for r in queries.QUERIES["op9_toxic_segments"](spark, "/root/testdata/sf0.01").where("predicted = 1").collect()}
    left = {r["doc_id"] for r in stages()["toxicity"](spark, documents, "/root/testdata/sf0.01").select("doc_id").collect()}
    assert toxic and left == {r["doc_id"] for r in documents.select("doc_id").collect()} - toxic


def test_a_third_of_all_rows_in_one_group(spark):
    """Two thousand equal rows, near copies of another text and single texts: one of each group is kept, all are sharded."""
    near = [" ".join(f"w{k}" if k != i else f"x{i}" for k in range(150)) for i in range(20)]
    single = [" ".join(f"s{i}v{k}" for k in range(30)) for i in range(100)]
    rows = [(i, TEXT) for i in range(2_000)] + [(5_000 + i, t) for i, t in enumerate(near + single)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in stages()["near_copies"](spark, docs, SF).collect()}
    assert kept == {0, 5_000} | set(range(5_020, 5_120))
    sharded = stages()["shard"](spark, docs, SF).collect()
    for k in range(8):
        own = sorted(r["slot"] for r in sharded if r["shard"] == k)
        assert own == list(range(len(own)))
    assert len(sharded) == len(rows)
