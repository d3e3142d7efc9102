"""N-gram Jaccard join: MinHash bands chosen for a recall, verified on whole sets of word n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardiolake.llm.common import FOLD, blocks, hashed, mixed, per_text, raw_bytes, shingle_hashes, stored, text_id, with_facts, word_codes

#: Members of a bucket, and their n-grams, that are compared with each other at once; larger buckets are compared in pairs of blocks.
BLOCK, BLOCK_GRAMS = 1_000, 2_000_000
#: Bytes of the rows that go to the buckets in one batch.
BATCH_BYTES = 8_000_000
#: Distinct n-grams that a comparison of many members lays out at once.
COLUMNS = 4_096


def banding(similarity: float, recall: float, rows: int = 4) -> int:
    """Bands of `rows` hashes each that find a pair of this similarity with this recall at least."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def n_grams(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all n-grams of each text's words (A-Z folded, cut at white space), and their offsets."""
    data, offsets = raw_bytes(column)
    codes, distinct, at, _ = word_codes(FOLD[data], offsets)
    return shingle_hashes(hashed(distinct)[codes] if len(codes) else np.zeros(0, np.uint64), at, width)


def band_hashes(grams: np.ndarray, ends: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row for each text and a column for each band; the band is part of its hash."""
    full = np.flatnonzero(np.diff(ends))
    out = np.zeros((len(ends) - 1, bands), dtype=np.uint64)
    if len(full):
        starts = ends[:-1][full]
        for b in range(bands):
            total = np.full(len(full), b + 1, dtype=np.uint64)
            for r in range(rows):
                seed = np.uint64((0x9E3779B97F4A7C15 * (b * rows + r + 1)) & (2**64 - 1))
                h = (grams ^ seed) * np.uint64(0xFF51AFD7ED558CCD)
                h ^= h >> np.uint64(32)
                total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(h, starts))
            out[full, b] = total
    return out


def linked_pairs(sets: list[np.ndarray], bands: np.ndarray, here: np.uint64, similarity: float, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members whose Jaccard similarity is reached. A pair counts in its first common band alone.

    side: block of each member where two blocks are compared with each other; None to compare all.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    column = int(np.flatnonzero((bands == here).all(0))[0])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    dense = m > 6
    common = np.zeros((m, m), dtype=np.int64) if dense else None
    if dense:
        every = np.unique(np.concatenate(sets))
        for first in range(0, len(every), COLUMNS):
            part = every[first : first + COLUMNS]
            table = np.zeros((m, len(part)), dtype=np.float32)
            for i, s in enumerate(sets):
                own = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], side="right")]
                table[i, np.searchsorted(part, own)] = 1
            common += (table @ table.T).astype(np.int64)
    for i in range(m - 1):
        later = np.arange(i + 1, m)
        later = later[(np.minimum(sizes[i], sizes[later]) >= similarity * np.maximum(sizes[i], sizes[later])) & ~(bands[later, :column] == bands[i, :column]).any(1)]
        if side is not None:
            later = later[side[later] != side[i]]
        if not len(later):
            continue
        shared = common[i, later] if dense else np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in later])
        # integers on both sides of the threshold: shared / (a + b - shared) >= similarity
        hit = later[shared >= similarity * (sizes[i] + sizes[later] - shared) - 1e-9]
        found.append((np.full(len(hit), i), hit))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to the connected component of each end: v, root (the component's least id after contraction).

    Each round every vertex moves to its least neighbour and the graph shrinks to those; rounds stop when no edge
    is left. What is counted on the driver is one number a round.
    """
    steps = []
    edges = stored(edges.where("a <> b").distinct(), "links")
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stored(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("low")).select("v", F.least("v", "low").alias("root")), "link-roots")
        steps.append(step)
        moved = edges.join(step.select(F.col("v").alias("a"), F.col("root").alias("ra")), "a").join(step.select(F.col("v").alias("b"), F.col("root").alias("rb")), "b")
        edges = stored(moved.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
    if not steps:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    roots = steps[0]
    for step in steps[1:]:
        later = step.select(F.col("v").alias("root"), F.col("root").alias("next"))
        roots = roots.join(later, "root", "left").select("v", F.coalesce("next", "root").alias("root"))
    return roots


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, recall: float = 0.9997, rows: int = 4, text: str = "text", key: str = "doc_id", block: int = BLOCK, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """class_id and n_links for each row of docs: key, class_id, n_links, is_first.

    Two documents are linked where the Jaccard similarity of their sets of word n-grams is reached; equal texts are
    linked. A class is a connected component, named by its least key; n_links is the number of other documents
    linked. is_first marks one row of a class: that of least key (of equal keys that of least text hash; of wholly
    equal rows all). A document of fewer than `width` words, but not none, has one n-gram of all its words; one
    without words (null, empty) is a class of its own with no link. An empty table gives no rows.

    Copies of a text become one member with a count before anything is shuffled by band, so a group of copies costs
    one row. Members of a bucket are compared whole; a bucket of more than `block` members or `block_grams` n-grams is
    cut into blocks, and each pair of blocks is a group of its own: memory is bounded and no link is dropped. Rows that leave a bucket are sums and a spanning
    star of its links, not its pairs.
    """
    bands = banding(similarity, recall, rows)

    def signatures():
        def sign(column: pa.Array) -> list[pa.Array]:
            grams, ends = n_grams(column, width)
            h = band_hashes(grams, ends, bands, rows).view(np.int64)
            n = np.diff(ends)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)), pa.array(h[n > 0].ravel()))
            return [lists, pa.array(n)]

        return sign

    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("tid", text_id(F.col("text")))
    signed = per_text(slim, "text", signatures, "bands array<bigint>, n_grams long", ["key", "tid"])
    members = stored(signed.groupBy("tid").agg(F.min("key").alias("first_key"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("n_grams").alias("n_grams")), "near-members")
    entries = members.select("tid", "n_grams", F.explode("bands").alias("bucket"))
    parts = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("g") / block_grams)).cast("int").alias("parts")
    crowded = stored(entries.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("n_grams").alias("g")).where("m > 1").select("bucket", parts), "near-buckets")
    held = entries.join(crowded, "bucket").groupBy("tid").agg(F.collect_list(F.struct("bucket", "parts")).alias("buckets"))
    candidates = members.join(held, "tid")
    # the row of least key stands for its text: equal texts have other keys, so that no key of this join is hot but
    # that of rows that are wholly equal, of which a task sends one
    mine = (F.col("d.tid") == F.col("c.tid")) & F.col("d.key").eqNullSafe(F.col("c.first_key"))
    texts = slim.alias("d").join(candidates.alias("c"), mine)
    texts = texts.select("d.tid", "d.text", "c.n", "c.bands", F.transform("c.buckets", lambda b: b["bucket"]).alias("at"), F.transform("c.buckets", lambda b: b["parts"]).alias("parts"))
    dealt_names = ["bucket", "low", "high", "side", "tid", "n", "bands", "grams"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
        rows, size, last = [], 0, None

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=dealt_names)
            rows.clear()
            return batch

        for batch in blocks(batches, "text", 2_000_000):
            grams, ends = n_grams(batch.column(1), width)
            signed64 = grams.view(np.int64)
            for i, (tid, n, band, at, cuts) in enumerate(zip(batch.column(0).to_pylist(), *(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True)):
                if tid == last:
                    continue
                last = tid
                own = np.unique(signed64[ends[i] : ends[i + 1]]).tobytes()
                band_bytes = np.array(band, dtype=np.int64).tobytes()
                for bucket, parts in zip(at, cuts, strict=True):
                    side = int.from_bytes(tid[:6], "big") % parts
                    for other in range(parts):
                        rows.append((bucket, min(side, other), max(side, other), side, tid, n, band_bytes, own))
                        size += len(own)
                        if size > BATCH_BYTES:
                            yield flush()
                            size = 0
        if rows:
            yield flush()

    dealt = texts.mapInArrow(deal, "bucket long, low int, high int, side int, tid binary, n long, bands binary, grams binary")
    grouped = dealt.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "tid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            members = {row[4]: row for row in waiting}  # repeated rows of one key and text count once
            own = list(members.values())
            waiting.clear()
            if len(own) < 2:
                return
            sets = [np.frombuffer(r[7], np.int64) for r in own]
            sig = np.stack([np.frombuffer(r[6], np.int64) for r in own])
            side = None if own[0][1] == own[0][2] else np.array([r[3] for r in own])
            a, b = linked_pairs(sets, sig, np.int64(own[0][0]), similarity, side)
            if not len(a):
                return
            counts = np.array([r[5] for r in own], dtype=np.int64)
            links = np.bincount(a, weights=counts[b], minlength=len(own)) + np.bincount(b, weights=counts[a], minlength=len(own))
            parent = list(range(len(own)))

            def root(i: int) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                i, j = root(i), root(j)
                parent[max(i, j)] = min(i, j)
            for i in np.flatnonzero(links).tolist():
                out.append((own[i][4], int(links[i]), own[root(i)][4]))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["tid", "links", "root"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if waiting and waiting[0][:3] != row[:3]:
                    close()
                waiting.append(row)
            if out:
                yield flush()
        if waiting:
            close()
        yield flush()

    found = stored(grouped.mapInArrow(compare, "tid binary, links long, root binary"), "near-links")
    roots = components(found.select(F.col("tid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("tid").agg(F.sum("links").alias("links"))
    summary = members.join(links, "tid", "left").join(roots.withColumnRenamed("v", "tid"), "tid", "left")
    summary = stored(summary.select("tid", "first_key", "n", (F.size("bands") > 0).alias("worded"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "tid").alias("root")), "near-summary")
    firsts = summary.groupBy("root").agg(F.min(F.struct(F.col("first_key").isNull(), "first_key", "tid")).alias("f"))
    classes = stored(summary.join(firsts, "root").select("tid", "n", "worded", "links", F.col("f.first_key").alias("class_key"), F.col("f.tid").alias("class_tid")), "near-classes")
    rows_out = with_facts(slim.select("key", "tid"), classes.withColumn("copies", F.col("n")), "tid", "copies")
    alone = ~F.col("worded")
    return rows_out.select(
        F.col("key").alias(key),
        F.when(alone, F.col("key")).otherwise(F.col("class_key")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("links") + F.col("n") - 1).cast("long").alias("n_links"),
        (alone | F.col("key").eqNullSafe(F.col("class_key")) & (F.col("tid") == F.col("class_tid"))).alias("is_first"),
        F.col("tid").alias("text_id"),
    )


#: key, class_id and n_links with all pairs compared, at five words and a similarity of 4/5.
ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT text, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY text),
m AS (
  SELECT row_number() OVER (ORDER BY first_id, text) AS tid, n, first_id, text,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM t),
g AS (
  SELECT DISTINCT tid, array_to_string(w[i : i + 4], ' ') AS gram
  FROM (SELECT tid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM m WHERE len(w) > 0)),
s AS (SELECT tid, count(*) AS size FROM g GROUP BY tid),
c AS (SELECT a.tid AS x, b.tid AS y, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.tid < b.tid GROUP BY ALL),
p AS (
  SELECT x, y FROM c JOIN s sx ON sx.tid = x JOIN s sy ON sy.tid = y
  WHERE 5 * common >= 4 * (sx.size + sy.size - common)),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT tid AS root, tid FROM s UNION SELECT r.root, e.y FROM r JOIN e ON e.x = r.tid AND r.root < e.y),
k AS (SELECT tid, min(root) AS root FROM r GROUP BY tid),
n AS (SELECT e.x AS tid, sum(m.n) AS linked FROM e JOIN m ON m.tid = e.y GROUP BY e.x),
f AS (SELECT k.tid, m.text, min(m.first_id) OVER (PARTITION BY k.root) AS class_id, m.n - 1 + coalesce(n.linked, 0) AS n_links FROM k JOIN m USING (tid) LEFT JOIN n USING (tid))
SELECT d.doc_id, coalesce(f.class_id, d.doc_id) AS class_id, coalesce(f.n_links, 0)::BIGINT AS n_links FROM documents d LEFT JOIN f ON f.text = d.text
"""
