"""The corpus pipeline: documents through five operators, each stage on all that the one before has kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardiolake.llm import decontamination, mixing, near_duplicates, queries, sharding, toxicity
from cardiolake.llm.common import stored, text_id


def keeps_columns(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage on columns of other names, so that no column of documents meets one that an operator adds; those it reads keep theirs."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "source")}
        out = stage(spark, docs.withColumnsRenamed(names), sf_dir)
        return out.withColumnsRenamed({own: c for c, own in names.items()}).select(*docs.columns)

    return run


@keeps_columns
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels of these documents, doesn't reject.

    Null and empty texts have no passage and the same low score; repeated rows are judged alike; without labels of
    both kinds nothing is rejected. An empty table gives an empty one.
    """
    model = queries.toxic_model(spark, docs, sf_dir)
    scored = toxicity.score_toxicity(docs, model)
    return scored.where(F.col("predicted") == 0).select(*docs.columns)


@keeps_columns
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word n-grams, Jaccard 0.8): that of least id.

    Rows of the same id and text are one document; documents without words stay.
    """
    found = near_duplicates.near_duplicates(docs, width=5, similarity=0.8)
    first = found.where("is_first").select(F.col("doc_id").alias("__id"), F.col("text_id").alias("__tid")).distinct()
    marked = docs.withColumn("__text", text_id(F.col("text")))
    return marked.join(first, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__tid")), "left_semi").dropDuplicates(["doc_id", "__text"]).select(*docs.columns)


@keeps_columns
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of 10 words of a benchmark item.

    Null and empty texts have no words and stay, as do all where the benchmark is empty; repeated rows are judged alike.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.decontaminate(docs, benchmark, window=10)
    return found.where("not contaminated").select(*docs.columns)


@keeps_columns
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: 150 % of all words, weights 5, 2, 1, twice at most.

    A null source is one of its own, the last. Rows of equal id have as many copies each. Texts without words have
    copies by their ids' hashes; a source of which no text has a word has none.
    """
    mixed = mixing.mix_sources(docs, share=1.5, most=2.0, weights=(5, 2, 1))
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard (0 to 7) and slot.

    Equal texts, null ones among them, share a shard; every row has a slot of its own, repeated rows too. An empty table gives no rows.
    """
    return sharding.shard_documents(docs, shards=8)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("leaks", drop_leaks), ("mix", mix), ("shard", shard)]
#: The stages learn, hash and difference in ways that SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages; what each one keeps is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
