"""Binary annotation files: a table of annotations from bytes, and an encoder for round trips."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

# The codes with a meaning of their own in the stream.
SKIP, NUM, SUB, CHN, AUX = 59, 60, 61, 62, 63
LONGEST_DELTA = 1023
#: Annotations that leave a worker at once.
ROWS = 20_000
#: Bytes of files that are walked at once (a longer file by itself).
BYTES = 1_000_000
#: Bytes of a file up to which the table function walks it word by word.
SHORT = 2_000


def walk_files(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, str]], np.ndarray]:
    """Of several files one after the other: samples and codes of all annotations, how many each file has, (annotation, note) of each note in order, and each file's clock at its end.

    Little-endian 16-bit words: a code in the upper 6 bits, a distance in the lower 10. SKIP is followed by a 32-bit
    distance, high half first, and then by a word with a distance of its own; a SKIP cut short ends the file. AUX
    brings text for the annotation before it, padded to a whole word. Words that begin something are found by jumps
    that double: from each file's first word, every word that 1, 2, 4, ... jumps reach.
    """
    sizes = np.array([len(p) // 2 for p in payloads], dtype=np.int64)
    words = np.frombuffer(b"".join(p[: len(p) // 2 * 2] for p in payloads), "<u2").astype(np.int64)
    n, starts = len(words), np.cumsum(sizes) - sizes
    file = np.repeat(np.arange(len(sizes)), sizes)
    end = (starts + sizes)[file]
    code, distance = words >> 10, words & LONGEST_DELTA
    after = np.arange(n + 1)
    after[:n] += np.where(code == SKIP, 3, np.where(code == AUX, 1 + (distance + 1) // 2, 1))
    short = (code == SKIP) & (after[:n] > end)
    # the end is a word of its own that leads to itself
    after[:n][(words == 0) | (after[:n] >= end)] = n
    jump, reached = after, np.zeros(n + 1, dtype=bool)
    reached[starts] = True
    while not (jump == n).all():
        reached[jump[reached]] = True
        jump = jump[jump]
    at = np.flatnonzero(reached[:n])
    at = at[(words[at] != 0) & ~short[at]]
    kind, of = code[at], file[at]
    skip, aux = kind == SKIP, kind == AUX
    own = ~(skip | aux | np.isin(kind, (NUM, SUB, CHN)))
    moves = np.where(own, distance[at], 0)
    far = words[at[skip] + 1] << 16 | words[at[skip] + 2]
    moves[skip] = np.where(far >= 1 << 31, far - (1 << 32), far)
    clock = np.concatenate([[0], np.cumsum(moves)])
    first, last = np.searchsorted(of, np.arange(len(sizes))), np.searchsorted(of, np.arange(len(sizes)), side="right")
    counts = np.bincount(of[own], minlength=len(sizes))
    owner, opens = np.cumsum(own) - 1, (np.cumsum(counts) - counts)[of]
    notes = []
    for i in np.flatnonzero(aux & (owner >= opens)).tolist():
        begin = 2 * int(at[i] - starts[of[i]]) + 2
        notes.append((int(owner[i]), payloads[of[i]][begin : begin + int(distance[at[i]])].rstrip(b"\0 ").strip().decode("latin-1")))
    return (clock[1:] - clock[first][of])[own], kind[own], counts, notes, clock[last] - clock[first]


def walk(payload: bytes) -> tuple[np.ndarray, np.ndarray, list[tuple[int, str]], int]:
    """Samples and codes of all annotations of a file, (annotation, note) of each note in order, and the clock at the end."""
    samples, codes, _, notes, clock = walk_files([payload])
    return samples, codes, notes, int(clock[0])


def walk_short(payload: bytes) -> tuple[list[int], list[int], list[tuple[int, str]], int]:
    """The same word by word: for a file of few words arrays cost more than they save."""
    words = struct.unpack_from(f"<{len(payload) // 2}H", payload)
    samples, codes, notes, clock, i = [], [], [], 0, 0
    while i < len(words) and words[i]:
        code, distance = words[i] >> 10, words[i] & LONGEST_DELTA
        if code == SKIP:
            if i + 3 > len(words):
                break
            far = words[i + 1] << 16 | words[i + 2]
            clock += far - (1 << 32) if far >= 1 << 31 else far
            i += 3
            continue
        if code == AUX:
            if samples:
                notes.append((len(samples) - 1, payload[2 * i + 2 : 2 * i + 2 + distance].rstrip(b"\0 ").strip().decode("latin-1")))
            i += 1 + (distance + 1) // 2
            continue
        if code not in (NUM, SUB, CHN):
            clock += distance
            samples.append(clock)
            codes.append(code)
        i += 1
    return samples, codes, notes, clock


def decode(payload: bytes) -> tuple[list[tuple[int, int, list[str]]], int]:
    """(sample, code, notes) of each annotation, and the clock at the end."""
    samples, codes, notes, clock = walk(payload)
    out = [(s, c, []) for s, c in zip(samples.tolist(), codes.tolist(), strict=True)]
    for owner, note in notes:
        out[owner][2].append(note)
    return out, clock


def encode_files(samples: np.ndarray, codes: np.ndarray, notes: list[tuple[int, str]], heads: np.ndarray) -> list[bytes]:
    """The bytes of each file. Annotations lie in order, one file's behind the other's, from `heads` (each file's first); with (annotation, note) of each note in order. Distances that don't fit a word go through SKIP."""
    distance = np.diff(samples, prepend=0)
    distance[heads] = samples[heads]
    long = (distance < 0) | (distance > LONGEST_DELTA)
    owner = np.array([o for o, _ in notes], dtype=np.int64)
    raw = [t.encode("latin-1") for _, t in notes]
    sizes = np.array([1 + (len(r) + 1) // 2 for r in raw], dtype=np.int64)
    before = np.concatenate([[0], np.cumsum(sizes)])
    lasts = np.append(heads[1:], len(samples)) - 1
    ends = 1 + 3 * long + np.bincount(owner, weights=sizes, minlength=len(samples)).astype(np.int64)
    ends[lasts] += 1  # a word of zero ends each file
    ends = np.cumsum(ends)
    begins = np.concatenate([[0], ends[:-1]])
    place = begins + 3 * long
    out = np.zeros(int(ends[-1]), dtype="<u2")
    far = distance[long] & 0xFFFFFFFF
    for k, words in enumerate((SKIP << 10, far >> 16, far & 0xFFFF)):
        out[place[long] - 3 + k] = words
    out[place] = codes << 10 | np.where(long, 0, distance)
    # a note lies behind its annotation and that one's earlier notes
    at = place[owner] + 1 + before[:-1] - before[np.searchsorted(owner, owner)]
    same: dict[bytes, list[int]] = {}
    for i, text in enumerate(raw):
        same.setdefault(text, []).append(i)
    for text, those in same.items():
        words = np.frombuffer(text + b"\0" * (len(text) % 2), "<u2")
        mine = at[those]
        out[mine] = AUX << 10 | len(text)
        out[mine[:, None] + 1 + np.arange(len(words))] = words
    data = out.tobytes()
    return [data[2 * a : 2 * b] for a, b in zip(begins[heads].tolist(), ends[lasts].tolist(), strict=True)]


def encode_arrays(samples: np.ndarray, codes: np.ndarray, notes: list[tuple[int, str]]) -> bytes:
    """The bytes of one file's annotations in order, with (annotation, note) of each note in order."""
    return encode_files(samples, codes, notes, np.zeros(1, np.int64))[0] if len(samples) else b"\0\0"


def encode(annotations: Iterable[tuple[int, int, list[str]]]) -> bytes:
    """The bytes of (sample, code, notes) in order."""
    rows = list(annotations)
    notes = [(i, note) for i, row in enumerate(rows) for note in row[2]]
    return encode_arrays(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), notes)


def file_heads(columns: list[pa.Array]) -> np.ndarray:
    """The first row of each stretch of rows with equal keys; nulls are equal."""
    differs = np.zeros(max(0, len(columns[0]) - 1), dtype=bool)
    for column in columns:
        same = pc.fill_null(pc.equal(column[1:], column[:-1]), False)
        both = pc.and_(column[1:].is_null(), column[:-1].is_null())
        differs |= ~pc.or_(same, both).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(differs) + 1])


def write_annotations(annotations: DataFrame, *keys: str, order: tuple[str, ...] = ("sample", "ann_idx")) -> DataFrame:
    """annotations (keys, sample, code, note and the columns of `order`) to a row for each file: keys, content.

    A file's rows meet in one task, sorted there by Spark; a task writes all files of a batch at once, and only rows of
    the file that a batch cuts wait for the next one.
    """
    schema = annotations.select(*keys).schema.add("content", BinaryType())

    def files(rows: pa.Table, heads: np.ndarray) -> pa.RecordBatch:
        note = rows["note"].combine_chunks()
        at = np.flatnonzero(note.is_valid().to_numpy(zero_copy_only=False))
        notes = list(zip(at.tolist(), note.drop_null().to_pylist(), strict=True))
        content = encode_files(rows["sample"].to_numpy(), rows["code"].to_numpy().astype(np.int64), notes, heads)
        return pa.RecordBatch.from_arrays([*(rows[k].combine_chunks().take(pa.array(heads)) for k in keys), pa.array(content, pa.binary())], names=[*keys, "content"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            if waiting:
                # does the file that waits end within this batch?
                edge = pa.concat_tables([waiting[-1].slice(waiting[-1].num_rows - 1).select(list(keys)), new.select(list(keys))])
                heads = file_heads([edge[k].combine_chunks() for k in keys])[1:] - 1
            else:
                heads = file_heads([new[k].combine_chunks() for k in keys])[1:]
            if not len(heads):
                waiting.append(new)
                continue
            whole = pa.concat_tables([*waiting, new.slice(0, int(heads[-1]))])
            waiting = [new.slice(int(heads[-1]))]
            yield files(whole, file_heads([whole[k].combine_chunks() for k in keys]))
        if waiting:
            yield files(pa.concat_tables(waiting), np.zeros(1, np.int64))

    rows = annotations.select(*dict.fromkeys([*keys, *order, "sample", "code", "note"])).repartition(*keys).sortWithinPartitions(*keys, *order)
    return rows.mapInArrow(write, schema)


def parse_annotations(files: DataFrame, payload: str = "content", *keys: str) -> DataFrame:
    """files (keys, payload) to a row for each annotation: keys, ann_idx, sample, code, notes, last_sample.

    A recording is walked where it lies, many short ones at once; a file with no annotation gives no rows.
    """
    schema = files.select(*keys).schema
    for name, kind in (("ann_idx", IntegerType()), ("sample", LongType()), ("code", IntegerType()), ("notes", ArrayType(StringType())), ("last_sample", LongType())):
        schema = schema.add(name, kind)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = batch.column(len(keys))
            ends = np.cumsum(pc.fill_null(pc.binary_length(content), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < batch.num_rows:
                # files of BYTES in all, or a longer one by itself
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BYTES, side="right")))
                part = batch.slice(first, last - first)
                yield from table(part, [b or b"" for b in part.column(len(keys)).to_pylist()])
                first = last

    def table(part: pa.RecordBatch, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        samples, codes, counts, notes, clocks = walk_files(payloads)
        file = np.repeat(np.arange(len(counts)), counts)
        index = np.arange(len(file)) - (np.cumsum(counts) - counts)[file]
        owners = np.array([o for o, _ in notes], dtype=np.int64)
        offsets = np.searchsorted(owners, np.arange(len(file) + 1))
        texts = [t for _, t in notes]
        for a in range(0, len(file), ROWS):
            b = min(a + ROWS, len(file))
            lists = pa.ListArray.from_arrays(pa.array(offsets[a : b + 1] - offsets[a], pa.int32()), pa.array(texts[offsets[a] : offsets[b]], pa.string()))
            own = [part.column(k).take(pa.array(file[a:b])) for k in range(len(keys))]
            found = [pa.array(index[a:b], pa.int32()), pa.array(samples[a:b]), pa.array(codes[a:b], pa.int32()), lists, pa.array(clocks[file[a:b]])]
            yield pa.RecordBatch.from_arrays([*own, *found], names=schema.names)

    return files.select(*keys, payload).mapInArrow(rows, schema)


def read_annotation_files(spark: SparkSession, glob: str) -> DataFrame:
    """Files p00001_s01.atr and the like: patient_id, segment, and the columns of parse_annotations. Missing files are skipped."""
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(glob)
    name = F.regexp_extract("path", r"([^/]+)\.atr$", 1)
    keyed = files.select(F.split(name, "_s")[0].alias("patient_id"), F.try_element_at(F.split(name, "_s"), F.lit(2)).cast("int").alias("segment"), "content")
    return parse_annotations(keyed, "content", "patient_id", "segment")


def missing_files(expected: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """The expected keys with status 'read' or 'Missing': a file that is not there is a row, not a silence.

    found: what was read. A file without annotations has no rows of its own: give the listing of files instead where
    that matters.
    """
    there = found.select(*keys).distinct().withColumn("__there", F.lit(True))
    status = F.when(F.col("__there"), "read").otherwise("Missing")
    return expected.select(*keys).distinct().join(there, list(keys), "left").select(*keys, status.alias("status"))


def beats_only(annotations: DataFrame) -> DataFrame:
    """Annotations but padding and the opening note at sample 0; spans are built before this."""
    return annotations.where("code <> 0 and not (code = 22 and sample = 0)")


class WalkAnnotations:
    """Table function: the annotations of one file's bytes, for LATERAL in SQL.

    walk_annotations(content) gives ann_idx, sample, code, note (the first one); walk_annotations(content, fs) also
    seconds, for a constant rate. Null or empty bytes give no rows.
    """

    @staticmethod
    def analyze(content: AnalyzeArgument, fs: AnalyzeArgument | None = None) -> AnalyzeResult:
        if fs is not None and (fs.value is None or not float(fs.value) > 0):
            raise ValueError("fs must be a constant above 0")
        schema = StructType().add("ann_idx", LongType()).add("sample", LongType()).add("code", IntegerType()).add("note", StringType())
        return AnalyzeResult(schema if fs is None else schema.add("seconds", DoubleType()))

    def eval(self, content: bytes, fs: float | None = None) -> Iterator[tuple]:
        content = bytes(content) if content is not None else b""
        if len(content) <= SHORT:
            samples, codes, found, _ = walk_short(content)
        else:
            samples, codes, found, _ = walk(content)
            samples, codes = samples.tolist(), codes.tolist()
        notes: dict[int, str] = {}
        for owner, note in found:
            notes.setdefault(owner, note)
        for i, (sample, code) in enumerate(zip(samples, codes, strict=True)):
            row = (i, sample, code, notes.get(i))
            yield row if fs is None else (*row, sample / float(fs))


def register_walk(spark: SparkSession, name: str = "walk_annotations") -> None:
    """Make the table function known to SQL."""
    spark.udtf.register(name, udtf(WalkAnnotations))
