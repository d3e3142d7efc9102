"""Removal of long repeated byte strings: anchored pruning, then blockwise suffix sorting with a difference cover."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardiolake.llm.common import blocks, mixed, raw_bytes, stored

#: Bytes of the grams among which anchors are chosen, and places that an anchor is chosen from.
GRAM, PLACES = 24, 128
#: Period of the difference cover.
PERIOD = 32
#: Bytes of contexts sorted at once.
BLOCK_BYTES = 400_000
#: Contexts of one suffix bucket that a task sorts; a bucket of more is split by the bytes that its windows go on with.
HOT = 4_000
#: Neighbouring distances that share a bucket after the first and after the second split.
SPLITS = (8, 1)
#: Slots of the filter that spares clean texts a shuffle: the most rows that its broadcast can have.
SLOTS = 1 << 20
BATCH_BYTES = 400_000


@lru_cache(maxsize=1)
def difference_cover(period: int = PERIOD) -> tuple[int, ...]:
    """A small set of residues whose differences give every residue, found greedily."""
    cover, missing = [0, 1], set(range(period)) - {0, 1, period - 1}
    while missing:
        best = max(range(period), key=lambda x: (len(({(x - c) % period for c in cover} | {(c - x) % period for c in cover}) & missing) if x not in cover else -1, -x))
        missing -= {(best - c) % period for c in cover} | {(c - best) % period for c in cover}
        cover.append(best)
    return tuple(sorted(cover))


class _Powers:
    """Powers of an odd multiplier and of its inverse, modulo 2**64, as far as asked for."""

    base = 0x9E3779B97F4A7C15 | 1
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n + 1:
            size = max(n + 1, 2 * BATCH_BYTES)
            with np.errstate(over="ignore"):
                cls.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, cls.base, np.uint64)]))
                cls.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, pow(cls.base, -1, 2**64), np.uint64)]))
        return cls.up, cls.down


BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Hasher:
    """64-bit polynomial hashes of any ranges of a block of bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = _Powers.get(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=self.sums[1:])

    def ranges(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.down[begin])

    def grams(self, width: int) -> np.ndarray:
        n = max(len(self.sums) - width, 0)
        return mixed((self.sums[width : width + n] - self.sums[:n]) * self.down[:n])


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows of `length` bytes with one anchor: text, anchor, first and last start.

    A window's anchor is the place of the least gram hash among its first PLACES grams, the leftmost of equals: it
    hangs on the window's bytes alone, so equal windows have equal anchors at equal distance.
    """
    grams = hasher.grams(GRAM)
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span < PLACES:
        low = np.minimum(low[:-span], low[span:]) if len(low) > span else low[:0]
        span *= 2
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[:-1][doc] if len(doc) else np.zeros(0, np.int64)
    anchor = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(start), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1 if len(first) else first
    return doc[first], anchor[first], start[first], start[last]


def sorted_repeats(text: np.ndarray, starts: np.ndarray, bucket: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which strings at `starts` equal another of the same bucket.

    Strings of a bucket have one length (8 or more) and start at one residue modulo PERIOD. Each bucket's suffixes are
    sorted by their first PERIOD bytes, longer ties by the rank of the cover sample at the bucket's next sample place,
    which reaches to the end of the longest string. Neighbours in that order are compared whole. Memory follows the
    block: ranks exist for sample places alone.
    """
    longest = int(lengths.max(initial=8))
    reach = PERIOD
    while reach < longest:
        reach *= 2
    padded = np.concatenate([text, np.zeros(reach + 2 * PERIOD, np.uint8)])
    n = len(text) + PERIOD
    words = np.zeros(n + reach, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : k + n + reach].astype(np.uint64)
    cover = np.zeros(PERIOD, dtype=bool)
    cover[list(difference_cover())] = True
    sample = np.flatnonzero(cover[np.arange(n) % PERIOD])
    rank = np.zeros(n + reach, dtype=np.int64)

    def dense(order: np.ndarray, *keys: np.ndarray) -> None:
        fresh = np.zeros(len(order), dtype=bool)
        for key in keys:
            fresh[1:] |= key[order[1:]] != key[order[:-1]]
        rank[sample[order]] = np.cumsum(fresh) + 1

    keys = [words[sample + 8 * k] for k in range(PERIOD // 8)]
    dense(np.lexsort(keys[::-1]), *keys)
    span = PERIOD
    while span < reach:
        keys = [rank[sample].copy(), rank[sample + span].copy()]
        dense(np.lexsort(keys[::-1]), *keys)
        span *= 2
    to_sample = np.array([next(d for d in range(PERIOD) if cover[(r + d) % PERIOD]) for r in range(PERIOD)])
    ties = rank[starts + to_sample[starts % PERIOD]]
    keys = [bucket] + [words[starts + 8 * k] for k in range(PERIOD // 8)] + [ties]
    order = np.lexsort(keys[::-1])
    a, b, size = starts[order[:-1]], starts[order[1:]], lengths[order[:-1]]
    equal = bucket[order[:-1]] == bucket[order[1:]]
    for k in range(0, longest, 8):
        at = np.flatnonzero(equal & (size > k))
        # a string's last word ends with it
        step = np.minimum(k, size[at] - 8)
        equal[at] = words[a[at] + step] == words[b[at] + step]
    repeated = np.zeros(len(starts), dtype=bool)
    repeated[order[:-1][equal]] = True
    repeated[order[1:][equal]] = True
    return repeated


def solve_block(rows: list[tuple], length: int) -> pa.RecordBatch:
    """Repeated windows of whole suffix buckets: bucket, kind, and runs of distances low to high.

    rows: bucket, kind, before, behind, bytes, as in repeated_windows; those of a bucket follow each other, as do those
    of a kind, of which there are one or two. Two are sorted as whole contexts; where they are equal, all windows of the kind
    repeat. Where a bucket has several kinds, the windows of one context of each are sorted, too.
    """
    ids: dict[tuple, int] = {}
    parts, whole, windows = [], [], []
    at, i = 0, 0
    while i < len(rows):
        last = i
        while last < len(rows) and rows[last][0] == rows[i][0]:
            last += 1
        several = rows[i][1] != rows[last - 1][1]
        for k in range(i, last):
            bucket, kind, before, behind, data = rows[k]
            gap = -(at + before) % PERIOD  # anchors stand at multiples of the period
            parts += [bytes(gap), data]
            if k > i and rows[k - 1][1] == kind or k + 1 < last and rows[k + 1][1] == kind:
                whole.append((k, at + gap, ids.setdefault((bucket, before, behind), len(ids)), len(data)))
            if several and (k == i or rows[k - 1][1] != kind):
                d = np.arange(behind, before + 1)
                windows.append((np.full(len(d), k), d, at + gap + before - d, ids.setdefault((bucket,), len(ids)) * PLACES + d))
            at += gap + len(data)
        i = last
    owner, far, starts, group = (np.concatenate([np.zeros(0, np.int64), *(w[c] for w in windows)]) for c in range(4))
    first = np.array([w[1] for w in whole], dtype=np.int64)
    named = np.array([-1 - w[2] for w in whole], dtype=np.int64)
    lengths = np.concatenate([np.array([w[3] for w in whole], dtype=np.int64), np.full(len(starts), length)])
    hit = sorted_repeats(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([first, starts]), np.concatenate([named, group]), lengths)
    full = {k for (k, _, _, _), h in zip(whole, hit.tolist()) if h}
    full_kinds = {rows[k][:2] for k in full}
    out = {rows[k][:2]: rows[k] for k in full}
    found = [(b, kind, r[3], r[2]) for (b, kind), r in out.items()]
    # neighbouring distances of one context become one run again
    hit = hit[len(whole) :]
    who, far = owner[hit], far[hit]
    new = np.ones(len(who), dtype=bool)
    new[1:] = (who[1:] != who[:-1]) | (far[1:] != far[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(who)) - 1 if len(begin) else begin
    for k, low, high in zip(who[begin].tolist(), far[begin].tolist(), far[end].tolist(), strict=True):
        if rows[k][:2] not in full_kinds:
            found.append((*rows[k][:2], low, high))
    columns = list(zip(*found, strict=True)) if found else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["bucket", "kind", "low", "high"])


def sort_buckets(contexts: DataFrame, length: int) -> DataFrame:
    """bucket, kind, low, high: the repeated windows of all buckets, sorted blockwise, each bucket in one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > BLOCK_BYTES and held[-1][0] != row[0]:
                    yield solve_block(held, length)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield solve_block(held, length)

    return contexts.select("bucket", "kind", "before", "behind", "bytes").repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, "bucket long, kind long, low int, high int")


def repeated_windows(contexts: DataFrame, length: int, splits: tuple[int, ...] = SPLITS) -> DataFrame:
    """bucket, kind, low, high of stored contexts; hot buckets are split by next bytes until each is small.

    contexts: bucket, kind, nth (0, or 1 for a second place of the kind), before and behind (the windows' distances to
    the anchor, most and least), hot, bytes (those of all the windows).
    Windows of a bucket share the bytes at its anchor. Those of a few neighbouring distances share more: a hot bucket
    becomes one for each such range and each string of shared bytes, in which equal contexts are one kind again. At a
    range of one distance the shared string is the whole window, and a bucket has one kind.
    """
    found = sort_buckets(contexts.where("not hot"), length)
    if not splits or not contexts.where("hot").limit(1).count():
        return found
    width = splits[0]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "bytes", BATCH_BYTES // 4):
            out: list[tuple] = []
            for bucket, kind, nth, before, behind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = xxhash.xxh3_64_intdigest(bucket.to_bytes(8, "big", signed=True) + kind.to_bytes(8, "big", signed=True)) >> 2 << 1 | nth
                for r in range(behind // width, before // width + 1):
                    low, high = max(behind, r * width), min(before, r * width + width - 1)
                    part = data[before - high : before - low + length]
                    common = data[before - r * width : before - (r * width + width - 1) + length]
                    own = xxhash.xxh3_64_intdigest(common + r.to_bytes(2, "big") + bucket.to_bytes(8, "big", signed=True)) - (1 << 63)
                    sub = xxhash.xxh3_64_intdigest(part + bytes((low, high))) - (1 << 63)
                    out.append((bucket, kind, own, sub, high, low, place, part))
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64(), pa.binary()]
            for first in range(0, len(out), 5_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[first : first + 5_000], strict=True), kinds, strict=True)], names=names)

    names = ["of_bucket", "of_kind", "bucket", "kind", "before", "behind", "place", "bytes"]
    hot = contexts.where("hot").select("bucket", "kind", "nth", "before", "behind", "bytes")
    parts = stored(hot.mapInArrow(split, "of_bucket long, of_kind long, bucket long, kind long, before int, behind int, place long, bytes binary"), "hot-parts")
    place = F.struct("place", "before", "behind", "bytes")
    kinds = stored(parts.groupBy("bucket", "kind").agg(F.min(place).alias("one"), F.max(place).alias("two")), "hot-kinds")
    deeper = _with_places(kinds, "place").select("bucket", "kind", "nth", "c.before", "c.behind", "hot", "c.bytes")
    below = repeated_windows(stored(deeper, "hot-contexts"), length, splits[1:])
    members = parts.select("of_bucket", "of_kind", "bucket", "kind").distinct()
    return found.unionByName(below.join(members, ["bucket", "kind"]).select(F.col("of_bucket").alias("bucket"), F.col("of_kind").alias("kind"), "low", "high"))


def _with_places(kinds: DataFrame, by: str) -> DataFrame:
    """kinds (bucket, kind, one, two: its first and last place, told apart by a field) as bucket, kind, hot, nth, c: a row for each place."""
    crowds = kinds.groupBy("bucket").agg((F.count("*") > HOT).alias("hot"))
    places = F.when(F.col(f"one.{by}") == F.col(f"two.{by}"), F.array("one")).otherwise(F.array("one", "two"))
    return kinds.join(crowds, "bucket").select("bucket", "kind", "hot", F.posexplode(places).alias("nth", "c"))


def remove_repeats(docs: DataFrame, length: int = 200, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, spans (first byte, behind, ..) and kept_sha256.

    Removed is each byte of a text covered by a string of `length` bytes that starts anywhere else, too, in this
    text or another; strings are judged on the input. Null counts as empty; texts shorter than `length` stay whole;
    texts of `length` or more that occur twice go whole. An empty table gives no rows; repeated rows are copies of each
    other. Matches never cross texts. Columns of the added names that docs has are replaced.

    1. Every window has an anchor chosen by its own bytes. A run of windows with one anchor is a row: hash of the
       bytes that all of them share (its suffix bucket), hash of the run's whole context (its kind in the bucket).
       Rows whose bucket is in one place only are dropped: no window of theirs can occur twice.
    2. Of each kind, one context goes to its bucket, and a second one from another place, if there is any.
    3. Buckets are sorted blockwise, long ties by ranks of a difference-cover sample, and neighbours compared byte by
       byte: whole contexts of a kind, windows of different kinds. A bucket of more than HOT kinds is split by next
       bytes first. What repeats of a kind's context repeats in all its places.
    4. Texts with repeats (found by a filter of SLOTS slots, then exactly) meet their runs; all others are hashed
       where they lie.
    """
    if length < PLACES + GRAM + 8:
        raise ValueError(f"length must be {PLACES + GRAM + 8} at least")
    core = length - PLACES + 1
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "spans", "kept_sha256")
    columns = list(docs.columns if keep is None else keep)
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    source = docs.select(*columns, body.alias("__body")).withColumn("__rid", F.xxhash64("__body"))
    texts = source.select("__rid", "__body")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "__body", BATCH_BYTES):
            data, offsets = raw_bytes(batch.column(1))
            hasher = Hasher(data)
            doc, anchor, low, high = anchor_runs(data, offsets, length, hasher)
            if not len(doc):
                continue
            rid = batch.column(0).to_numpy(zero_copy_only=False)[doc]
            key = hasher.ranges(anchor, anchor + core)
            context = mixed(hasher.ranges(low, high + length) + ((anchor - low) * PLACES + anchor - high).astype(np.uint64))
            place = anchor - offsets[:-1][doc]
            pack = place * (PLACES * PLACES) + (anchor - low) * PLACES + (anchor - high)
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(key.view(np.int64)), pa.array(context.view(np.int64)), pa.array(pack)], names=["rid", "key", "context", "pack"])

    long_enough = texts.where(F.octet_length("__body") >= length)
    anchors = stored(long_enough.mapInArrow(runs, "rid long, key long, context long, pack long"), "anchors")
    place = F.xxhash64("rid", "pack")
    counted = anchors.groupBy("key").agg(F.min(place).alias("p0"), F.max(place).alias("p1"))
    keys = stored(counted.where("p0 <> p1").select("key"), "anchor-keys")
    repeated = stored(anchors.join(keys, "key"), "anchor-repeats")
    spot = F.struct("rid", "pack", place.alias("place"))
    kinds = repeated.groupBy(F.col("key").alias("bucket"), F.col("context").alias("kind")).agg(F.min(spot).alias("one"), F.max(spot).alias("two"))
    wanted = _with_places(stored(kinds, "anchor-kinds"), "place").select("c.rid", F.struct("bucket", "kind", "nth", "hot", "c.pack").alias("w"))
    wanted = wanted.groupBy("rid").agg(F.collect_list("w").alias("w"))

    def filtered(rids: DataFrame) -> DataFrame:
        slots = rids.select(F.pmod("rid", F.lit(SLOTS)).alias("slot")).distinct()  # SLOTS rows of one number at most
        return texts.join(F.broadcast(slots), F.pmod("__rid", F.lit(SLOTS)) == F.col("slot"), "left_semi")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds_of = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
        for batch in blocks(batches, "__body", BATCH_BYTES):
            out: list[tuple] = []
            for data, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for w in rows:
                    at, back = divmod(w["pack"], PLACES * PLACES)
                    before, behind = divmod(back, PLACES)
                    if at - behind + length <= len(data):
                        out.append((w["bucket"], w["kind"], w["nth"], before, behind, w["hot"], data[at - before : at - behind + length]))
            for first in range(0, len(out), 5_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[first : first + 5_000], strict=True), kinds_of, strict=True)], names=names)

    names = ["bucket", "kind", "nth", "before", "behind", "hot", "bytes"]
    # equal texts meet here as one: all rows of a text have the same bytes
    near = filtered(wanted).groupBy("__rid").agg(F.first("__body").alias("__body")).join(wanted, F.col("__rid") == F.col("rid")).select("__body", "w")
    contexts = stored(near.mapInArrow(cut, "bucket long, kind long, nth int, before int, behind int, hot boolean, bytes binary"), "contexts")
    runs_of_kinds = stored(repeated_windows(contexts, length), "repeated-windows").select(F.col("bucket").alias("key"), F.col("kind").alias("context"), "low", "high")
    at = F.expr(f"pack div {PLACES * PLACES}") * (PLACES * PLACES) + F.col("high") * PLACES + F.col("low")
    found = repeated.join(runs_of_kinds, ["key", "context"]).select("rid", at.alias("pack"), "key")
    # texts that occur twice or more go whole; 128 bits more than the id tell them apart
    digest = F.md5("__body")
    twice = source.where(F.octet_length("__body") >= length).groupBy("__rid", digest.alias("__md5")).agg(F.count("*").alias("c")).where("c > 1")
    twice = stored(twice.select(F.col("__rid").alias("rid"), "__md5"), "copies")
    # their runs, as many times over as there are copies, are left out
    found = stored(found.join(twice.select("rid").distinct(), "rid", "left_anti").distinct(), "repeat-runs").groupBy("rid").agg(F.collect_list(F.struct("pack", "key")).alias("runs"))

    known = found.join(twice, "rid", "full_outer").select(F.col("rid").alias("__known"), F.col("runs").alias("__runs"), "__md5")
    slots = repeated.select("rid").unionByName(twice.select("rid")).select(F.pmod("rid", F.lit(SLOTS)).alias("__slot")).distinct()
    marked = source.join(F.broadcast(slots), F.pmod("__rid", F.lit(SLOTS)) == F.col("__slot"), "left")
    nothing = F.lit(0).cast("long")
    clean = marked.where("__slot is null").select(*columns, F.octet_length("__body").cast("long").alias("n_bytes"), nothing.alias("n_removed"), nothing.alias("n_spans"), F.array().cast("array<long>").alias("spans"), F.sha2("__body", 256).alias("kept_sha256"))
    suspects = marked.where("__slot is not null").join(known, F.col("__rid") == F.col("__known"), "left")
    suspects = suspects.select(*columns, "__body", "__runs", F.coalesce(digest == F.col("__md5"), F.lit(False)).alias("__copy"))
    width = len(columns)
    added = ["n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"]

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "__body", BATCH_BYTES):
            out: list[list] = [[] for _ in added]
            for data, rows, copy in zip(*(batch.column(width + k).to_pylist() for k in range(3)), strict=True):
                cover = np.zeros(len(data) + 1, dtype=np.int64)
                if rows:
                    pack = np.array([r["pack"] for r in rows])
                    at = pack // (PLACES * PLACES)
                    low, high = at - pack % (PLACES * PLACES) // PLACES, at - pack % PLACES
                    fits = (low >= 0) & (high + length <= len(data))
                    at, low, high = at[fits], low[fits], high[fits]
                    # another text of the same 64-bit id would show other bytes at its anchors
                    own = Hasher(np.frombuffer(data, np.uint8)).ranges(at, at + core).view(np.int64) == np.array([r["key"] for r in rows])[fits]
                    np.add.at(cover, low[own], 1)
                    np.add.at(cover, high[own] + length, -1)
                gone = np.cumsum(cover)[:-1] > 0
                gone |= copy
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                left = np.frombuffer(data, np.uint8)[~gone].tobytes() if len(edges) else data
                for column, value in zip(out, (len(data), int(gone.sum()), len(edges) // 2, edges.tolist(), hashlib.sha256(left).hexdigest()), strict=True):
                    column.append(value)
            kinds_of = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(width)] + [pa.array(c, k) for c, k in zip(out, kinds_of, strict=True)], names=[*columns, *added])

    schema = type(clean.schema)(list(clean.schema))
    return clean.unionByName(suspects.mapInArrow(strip, schema))


#: The digest of what is left, with every string of 200 bytes grouped; blocks of 1,000 places keep the cuts short.
ORACLE_SQL = r"""
WITH h AS (SELECT doc_id, text, hex(coalesce(text, '')) AS x, strlen(coalesce(text, '')) AS n, row_number() OVER (ORDER BY doc_id, text) AS r FROM documents),
b AS (SELECT r, k, least(1000, n - 199 - k) AS m, substr(x, 2 * k + 1, 2 * 1199) AS part FROM (SELECT *, unnest(range(0, n - 199, 1000)) AS k FROM h WHERE n >= 200)),
w AS (SELECT r, k + i AS i, md5_number(substr(part, 2 * i + 1, 400)) AS code FROM (SELECT *, unnest(range(m)) AS i FROM b)),
o AS (SELECT code FROM w GROUP BY code HAVING count(*) > 1),
d AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS begins FROM w SEMI JOIN o USING (code)),
q AS (SELECT r, i, sum(begins) OVER (PARTITION BY r ORDER BY i) AS span FROM d),
s AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM q GROUP BY r, span),
e AS (SELECT r, a, b FROM s UNION ALL SELECT r, n, n FROM h),
k AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a, b), 0) AS since FROM e),
j AS (SELECT r, sum(b - a) AS n_removed, count(*) - 1 AS n_spans, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a, b) AS kept FROM k JOIN h USING (r) GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM h JOIN j USING (r)
"""
