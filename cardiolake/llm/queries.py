"""The queries of the operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardiolake.llm import byte_bpe, centroids, decontamination, filter_audit, language, mixing, near_duplicates, quality, recurrent_lm, sharding, substrings, token_files, toxicity
from cardiolake.llm.common import gone_at_exit, remainder, scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file on whatever machine runs this."""
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary(name: str) -> tuple[str, str | None]:
    """A public vocabulary's file, and the pattern that byte-level ranks need."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN if name.endswith(".tiktoken") else None


#: The vocabularies that measure fertility: pieces with byte fallback, and byte-level ranks for many languages.
VOCABULARIES = {"piece": lambda: vocabulary("piece_bpe_32k.model"), "byte": lambda: vocabulary("byte_bpe_multi_50k.tiktoken")}


def op1_kk_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_documents(docs, shards=8).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates.near_duplicates(docs, width=5, similarity=0.8).select("doc_id", "class_id", "n_links")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.decontaminate(docs, _table(spark, sf_dir, "benchmark"), window=10, keep=["doc_id"])
    return decontamination.digest(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = remainder(F.col("doc_id"), 7) == 2
    scored = recurrent_lm.score_documents(docs, docs.where(~held), keep=["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs, length=200, keep=["doc_id"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs, share=1.5, most=2.0, weights=(5, 2, 1)).select("doc_id", "size", "source_size", "target", "taken")


def op7_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = quality.judge(docs, VOCABULARIES, keep=["doc_id"])
    ratios = [f"{r}_{v}" for v in VOCABULARIES for r in ("chars_per_token", "byte_share", "evenness")]
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *ratios)


def op8_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    gone_at_exit(spark, path)
    return token_files.read_tokens(spark, path)


def toxic_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicModel:
    """The model of docs, from labels of ids whose remainder modulo 5 is not 0."""
    labels = _table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 5) != 0)
    return toxicity.train(docs.select("doc_id", "text"), labels)


def op9_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, toxic_model(spark, docs, sf_dir), keep=["doc_id"])
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op10_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = remainder(F.col("doc_id"), 4) == 2
    network = language.train(docs.where(~held))
    found = language.identify(docs, network, keep=["doc_id"])
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op11_filter_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_audit.audit(docs, _table(spark, sf_dir, "labels")).where("part is not null")


def op12_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    find = functools.partial(vocabulary, "byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_digests(_table(spark, sf_dir, "documents").select("doc_id", "text"), find, keep=["doc_id"])


def op13_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=8, dims=64, rounds=10)


QUERIES = {f.__name__: f for f in (op1_kk_shards, op2_ngram_jaccard, op3_decontaminate, op4_recurrent_lm, op5_suffix_dedup, op6_source_mix, op7_tokenizer_fertility, op8_orc_tokens, op9_toxic_segments, op10_byte_network, op11_filter_cube, op12_prefix_bpe, op13_hamerly)}
ORACLE_SQL = {"op2_ngram_jaccard": near_duplicates.ORACLE_SQL, "op3_decontaminate": decontamination.ORACLE_SQL, "op5_suffix_dedup": substrings.ORACLE_SQL, "op6_source_mix": mixing.ORACLE_SQL, "op11_filter_cube": filter_audit.ORACLE_SQL, "op13_hamerly": centroids.ORACLE_SQL}
