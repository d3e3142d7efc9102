"""Token ids in ORC files: run-length integers, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import functools
import itertools
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardiolake.llm.common import blocks, raw_bytes

BLOCK_BYTES = 8_000_000
#: ASCII letters; ASCII signs, digits included in neither.
LETTER, VISIBLE = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
VISIBLE[0x21:0x7F] = True
VISIBLE[0x30:0x3A] = VISIBLE[LETTER] = False
#: Rows of a file at most, about.
ROWS_A_FILE = 100_000
#: Distinct pieces whose ids a worker keeps; beyond that it starts anew.
MEMO = 1_000_000


def pieces(data: np.ndarray, offsets: np.ndarray, added: re.Pattern | None = None) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Texts cut where a blank or ASCII sign follows an ASCII or Latin-1 letter, or a blank an ASCII sign: codes, distinct pieces, n+1 offsets.

    A byte-level BPE pattern never matches across such a place, and what it sees behind a blank run lies in the same
    piece, so the ids of a text are those of its pieces end to end. (Behind other bytes, which may end a wider
    space, no cut is made.) What `added` matches inside one text, the strings of a vocabulary's added tokens, is a
    piece of its own: an encoder looks for those before anything else.
    """
    starts = np.zeros(len(data), dtype=bool)
    letter = LETTER[data]
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    starts[1:] = (data[1:] == 0x20) & (letter | VISIBLE[data])[:-1] | VISIBLE[data[1:]] & letter[:-1]
    for match in added.finditer(data) if added else ():
        a, b = match.span()
        if np.searchsorted(offsets, a, side="right") == np.searchsorted(offsets, b - 1, side="right"):
            starts[a:b] = False
            starts[a] = True
            starts[b : b + 1] = True
    starts[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    at = np.flatnonzero(starts)
    bounds = np.append(at, len(data)).astype(np.int64)
    array = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    encoded = array.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary, np.searchsorted(at, offsets)


class Encoder:
    """Ids of whole texts by a tokenizers file; each distinct piece is encoded once while the memo holds it.

    Added tokens that take blanks around them along, or only stand alone, rule out pieces: texts are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        known = self.tokenizer.get_added_tokens_decoder().values()
        self.whole = any(t.lstrip or t.rstrip or t.single_word for t in known)
        strings = sorted((t.content.encode() for t in known), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, strings))) if strings else None
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.begins, self.lengths, self.ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]

    def _known(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and length of each piece's ids, and all ids that the memo holds."""
        memo = self.memo
        if len(memo) > MEMO:
            self._forget()
            memo = self.memo
        new = [t for t in texts if t not in memo]
        if new:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode("utf-8") for t in new], add_special_tokens=False)]
            lengths = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
            behind = sum(map(len, self.ids))
            self.begins.append(np.cumsum(lengths) - lengths + behind)
            self.lengths.append(lengths)
            self.ids.append(np.fromiter(itertools.chain.from_iterable(lists), dtype=np.int32, count=int(lengths.sum())))
            memo.update(zip(new, range(len(memo), len(memo) + len(new)), strict=True))
            self.begins, self.lengths, self.ids = ([np.concatenate(x)] for x in (self.begins, self.lengths, self.ids))
        at = np.fromiter(map(memo.__getitem__, texts), dtype=np.int64, count=len(texts))
        return self.begins[0][at], self.lengths[0][at], self.ids[0]

    def _cut(self, column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        if not self.whole:
            return pieces(data, offsets, self.added)
        encoded = column.fill_null("").cast(pa.large_binary()).dictionary_encode()
        return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary, np.arange(len(offsets))

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end with end_id behind each text, and n+1 offsets."""
        data, offsets = raw_bytes(column)
        codes, distinct, at = self._cut(column, data, offsets)
        begin, lengths, flat = self._known(distinct.to_pylist())
        # every occurrence takes its piece's run of ids; one place behind each text is left for the end
        run = lengths[codes]
        total = np.concatenate([[0], np.cumsum(run)])
        doc_ends = total[at] + np.arange(len(at))
        source = np.repeat(begin[codes] - total[:-1], run) + np.arange(int(total[-1]))
        out = np.full(int(total[-1]) + len(at) - 1, end_id, dtype=np.int32)
        keep = np.ones(len(out), dtype=bool)
        keep[doc_ends[1:] - 1] = False
        out[keep] = flat[source]
        return out, doc_ends


@functools.lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """A worker's encoder: its memo outlives a task, as workers are used again."""
    return Encoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, files: int | None = None, text: str = "text", key: str = "doc_id") -> None:
    """Encode every whole text (null: empty), append end_id and write ORC files in ascending order of `key`.

    Files are ranges of `key`, each sorted; integers are run-length encoded by ORC itself, every 1000 rows have an
    index entry and every stripe a Bloom filter on `key`, so that a reader takes whole stripes in parallel and skips
    those that can't hold an id. Rows: key, first (ids of its part before it), n_tokens, ids. Rows of equal or null
    keys (null first) are kept, follow each other by the crc32 of their texts, and may span files; there are as many
    files as shuffle partitions, or more, so that none has over about ROWS_A_FILE rows.
    The shuffle carries texts, which are smaller than their ids, and its sampling pass reads no token. Other columns
    of docs play no part; an empty table gives files without rows.
    """
    spark = docs.sparkSession
    files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(docs.count() / ROWS_A_FILE))
    # the row's number parts rows that are wholly equal, so that no range is too large for its file
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).withColumns({"crc": F.crc32(F.col("text").cast("binary")), "row": F.monotonically_increasing_id()})

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = encoder_of(tokenizer), 0
        for batch in blocks(batches, "text", BLOCK_BYTES):
            ids, at = encoder.encode(batch.column(1), end_id)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(before + at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), lists], names=["doc_id", "first", "n_tokens", "ids"])
            before += int(at[-1])

    kind = dict(slim.dtypes)["doc_id"]
    order = [F.col("doc_id").asc_nulls_first(), F.col("crc").asc_nulls_first(), F.col("row")]
    ordered = slim.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")
    rows = ordered.mapInArrow(encoded, f"doc_id {kind}, first long, n_tokens long, ids array<int>")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.stripe.size": str(64 << 20), "orc.create.index": "true"}
    rows.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """The rows of token files with `start`, the ids of all documents before: doc_id, start, n_tokens, ids_crc32.

    kind: the type of doc_id. A row knows how many ids its part has before it; parts follow each other by their
    ranges, so only their sums are added up. ids_crc32 is the unsigned crc32 of a document's ids as little-endian
    32-bit integers. No files give no rows.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            at = lists.offsets.to_numpy(zero_copy_only=False)
            view = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4")))
            crc = [zlib.crc32(view[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], names=["part", "doc_id", "first", "n_tokens", "ids_crc32"])

    files = spark.read.schema(f"doc_id {kind}, first long, n_tokens long, ids array<int>").orc(path)
    part = F.regexp_extract(F.input_file_name(), r"part-(\d+)[^/]*$", 1).cast("int").alias("part")
    rows = files.select(part, "doc_id", "first", "n_tokens", "ids").mapInArrow(summed, f"part int, doc_id {kind}, first long, n_tokens long, ids_crc32 long")
    # the sums of the parts, few rows, come from the column of lengths alone
    sums = files.select(part, "n_tokens").groupBy("part").agg(F.sum("n_tokens").alias("sum"))
    before = sums.select("part", (F.sum("sum").over(Window.orderBy("part")) - F.col("sum")).alias("before"))
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
