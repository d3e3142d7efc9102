"""Helpers that several operators share: shared scratch tables and text blocks as NumPy arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: blank and the bytes 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, in a local session without it, one beside the warehouse."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir is None and spark.sparkContext.getCheckpointDir() is not None:
        set_dir = spark.sparkContext.getCheckpointDir()
    if set_dir is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if set_dir is None:
        set_dir = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/../cardiolake-scratch"
    return set_dir.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Let a folder that is there by now go when the driver's JVM ends."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends, sizes are known to the planner."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    gone_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def with_facts(rows: DataFrame, facts: DataFrame, on: str, count: str, parts: int = 1_000) -> DataFrame:
    """Inner join of rows with stored facts, one row a key, whose column `count` says how often rows have the key.

    Keys with more than 1/parts of all rows, `parts` of them at most, are broadcast, so that no task gets all rows of
    one; the others meet by a shuffle. The count is not handed on.
    """
    total = facts.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = F.col(count) * parts > F.lit(total)
    few = facts.where(hot).drop(count)
    if not few.limit(1).count():
        return rows.join(facts.drop(count), on)
    often = F.broadcast(few.select(on))
    return rows.join(F.broadcast(few), on).unionByName(rows.join(often, on, "left_anti").join(facts.where(~hot).drop(count), on))


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as decimal text, modulo divisor; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def words(text: Column) -> Column:
    """Number of words; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_id(text: Column) -> Column:
    """128 bits that stand for a text (null has those of no text at all)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("\x00null")).cast("binary")))


def folded(text: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(text, UPPER, LOWER)


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column end to end, and the n+1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the column holds about most_bytes in each; a longer text has a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = raw_bytes(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most_bytes, side="right")) - 1)
            stop = min(stop, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def word_codes(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Words of each text: their codes, the distinct words by code, n+1 offsets into the codes, first byte of each word.

    outside marks the bytes that belong to no word.
    """
    n = len(offsets) - 1
    inside = ~outside[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    at = np.flatnonzero(first)
    packed = data[inside]
    ends = np.cumsum(inside)[at] - 1 if len(at) else np.zeros(0, np.int64)
    bounds = np.append(ends, len(packed)).astype(np.int64)
    array = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(packed))])
    encoded = array.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes, encoded.dictionary, np.searchsorted(at, offsets) if n else np.zeros(1, np.int64), at


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result hangs on every bit of x."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def hashed(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each value of a binary array."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in distinct.to_pylist()), dtype=np.uint64, count=len(distinct))


def strided_counts(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. n-1 for each length n, end to end."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def per_text(docs: DataFrame, text: str, make, added: str, keep: list[str] | None = None, most_bytes: int = 4_000_000) -> DataFrame:
    """docs with columns computed from whole texts in Arrow batches.

    make() runs once in each task and returns a function from a text column to a list of arrays, one for each column
    of the DDL string `added`. keep names the columns of docs to hand on (all, if None); those that `added` names
    are replaced.
    """
    spark = docs.sparkSession
    new = spark.createDataFrame([], added).schema
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new.names]
    sent = docs.select(*kept, *([] if text in kept else [F.col(text).alias("__text")]))
    at = kept.index(text) if text in kept else len(kept)
    names = [*kept, *new.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in blocks(batches, sent_name, most_bytes):
            out = f(batch.column(at))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + out, names=names)

    sent_name = sent.columns[at]
    schema = type(new)([f for f in sent.schema if f.name in kept] + list(new))
    return sent.mapInArrow(run, schema)


def sums_by_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring offsets."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def shingle_hashes(words: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every run of `width` words of each text, and their offsets; a shorter text, but not an empty one, is one shingle.

    words: hashes of the words; at: n+1 offsets of the texts.
    """
    n = np.diff(at)
    counts = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    ends = np.concatenate([[0], np.cumsum(counts)])
    first = np.repeat(at[:-1] - ends[:-1], counts) + np.arange(int(ends[-1]))
    length = np.repeat(np.minimum(n, width), counts)
    h = length.astype(np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for k in range(width):
        step = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + padded[first + k]
        h = np.where(k < length, step, h)
    return mixed(h), ends
