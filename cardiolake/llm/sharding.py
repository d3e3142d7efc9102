"""Sharding by Karmarkar-Karp differencing: groups that may not be divided, shards of nearly equal bytes."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardiolake.llm.common import stored, text_id, with_facts

#: A level of the tree takes about this many items in one task, and hands on BLOBS sums.
FAN_IN, BLOBS = 1_000, 16
#: Rows of a chunk of slots on average; pairs of key and text that are split, at most.
CHUNK, CROWDS = 5_000, 10_000
#: Blobs that the last level differences at most, besides the large groups and the single ones that tune the shards.
LAST = 4_000


def difference(sizes: Sequence[int], ways: int) -> list[int]:
    """The part (0 to ways-1) of each item.

    Every item starts as a partial partition of its own. The two partitions with the largest spread are combined
    again and again, the largest sum of one with the smallest of the other, until one is left.
    Ties go by position, so that reruns agree.
    """
    n = len(sizes)
    parent = list(range(n))
    heap = [(-int(s), i, ((int(s), i),)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, _, two = heapq.heappop(heap)
        # each is sorted, largest first, and holds its non-empty parts alone: pad to `ways`, join oppositely
        a = list(one) + [(0, -1)] * (ways - len(one))
        b = [(0, -1)] * (ways - len(two)) + list(two)[::-1]
        joined = []
        for (x, i), (y, j) in zip(a, b, strict=True):
            if i >= 0 and j >= 0:
                parent[j] = i
            joined.append((x + y, i if i >= 0 else j))
        joined.sort(key=lambda p: (-p[0], p[1]))
        least = joined[-1][0]
        # only differences matter from here on; empty parts are dropped again
        joined = tuple((s - least, i) for s, i in joined) if joined[-1][1] >= 0 else tuple(p for p in joined if p[1] >= 0)
        heapq.heappush(heap, (-(joined[0][0] - (joined[-1][0] if len(joined) == ways else 0)), turn, joined))
        turn += 1
    root_part = {i: k for k, (_, i) in enumerate(heap[0][2])} if heap else {}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    return [root_part[root(i)] for i in range(n)]


def _level(items: DataFrame, n: int, ways: int, height: int) -> DataFrame:
    """items (item, size) dealt by hash into tasks of about FAN_IN, each differenced into `ways` parts: item, size, blob."""
    buckets = max(1, math.ceil(n / FAN_IN))

    def within(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "item"], ascending=[False, True], ignore_index=True)
        part = difference(rows["size"].tolist(), ways)
        return pd.DataFrame({"item": rows["item"], "size": rows["size"], "blob": [f"{height}:{key[0]}:{p}" for p in part]})

    dealt = items.withColumn("bucket", F.pmod(F.xxhash64("item", F.lit(height)), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandas(within, "item string, size long, blob string")


def assign_groups(groups: DataFrame, shards: int, total: int, n: int) -> DataFrame:
    """groups (item: a string without colons, size long, one row each) with a shard: item, shard.

    About FAN_IN to 2 * FAN_IN single groups, taken by hash, and those too large for packing (over 1/2000 of all
    bytes: 2000 at most) go to the last level as they are. All others are packed by a tree of hash buckets, each
    differenced into blobs of nearly equal sums; the last level differences blobs and single groups together, and the
    many sizes of the latter close the last gaps. Hashes and ties go by the items, not by the place of a row, so any
    partitioning gives the same shards.
    """
    single = lambda rows: rows.select("item", "size")

    def last(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "item"], ascending=[False, True], ignore_index=True)
        return pd.DataFrame({"item": rows["item"], "shard": difference(rows["size"].tolist(), shards)})

    tuning = max(1, n // FAN_IN)
    apart = (F.col("size") * 2_000 > F.lit(total)) | (F.pmod(F.xxhash64("item", F.lit(-1)), F.lit(tuning)) == 0)
    marked = stored(groups.select("item", "size", apart.alias("apart")), "shard-groups")
    top, levels, count = single(marked.where("apart")), [], n
    if tuning > 1:
        rows = single(marked.where("not apart"))
        while not levels or count > LAST:
            levels.append(stored(_level(rows, count, BLOBS, len(levels)), "shard-level"))
            rows = levels[-1].groupBy(F.col("blob").alias("item")).agg(F.sum("size").alias("size"))
            count = max(1, math.ceil(count / FAN_IN)) * BLOBS
        top = top.unionByName(rows)
    placed = stored(top.withColumn("all", F.lit("all")).groupBy("all").applyInPandas(last, "item string, shard int"), "shard-top")
    if not levels:
        return placed
    blob = F.contains("item", F.lit(":"))
    shard_of = placed.where(blob).withColumnRenamed("item", "blob")
    for level in reversed(levels):
        shard_of = level.join(shard_of, "blob").select(F.col("item").alias("blob"), "shard")
    return shard_of.withColumnRenamed("blob", "item").unionByName(placed.where(~blob))


def _split_crowds(placed: DataFrame, slim: DataFrame, full: DataFrame, most: int, cell: list[str]) -> tuple[DataFrame, DataFrame]:
    """placed and the counts of its cells, where no cell holds many rows of one key and text.

    Rows of one pair of key and text hash are alike, so any order of them gives the same slots. Of each pair with more
    than `most` rows in the full chunks (CROWDS pairs at most) the rows are written once with a part of about CHUNK
    rows each; numbers then come from the counts of the parts. All others keep their chunk.
    """
    same = ["shard", "__pair"]
    nowhere = {"__own": F.lit(0).cast("long"), "__part": F.lit(0).cast("long")}
    pairs = slim.join(F.broadcast(full.select("shard", "__chunk")), ["shard", "__chunk"], "left_semi").groupBy(*same).count()
    crowds = stored(pairs.where(F.col("count") > most).select(*same, F.ceil(F.col("count") / CHUNK).alias("__parts")), "shard-crowds")
    some, parts = F.broadcast(crowds.select(*same)), F.broadcast(crowds)
    part = {"__own": F.col("__pair"), "__part": F.pmod(F.monotonically_increasing_id(), F.col("__parts")) + 1}
    alike = stored(placed.join(parts, same).withColumns(part).drop("__parts"), "shard-alike")
    others = placed.join(some, same, "left_anti").withColumns(nowhere)
    counts = slim.join(some, same, "left_anti").withColumns(nowhere).groupBy(*cell).count()
    return others.unionByName(alike), counts.unionByName(alike.groupBy(*cell).count())


def shard_documents(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row of docs with size, text_crc32, law, shard, slot and grown_shard added.

    Documents of equal text make a group that stays in one shard; groups are differenced so that the shards' bytes
    are nearly equal. A group beyond a fair share keeps a shard almost to itself: it is never divided. Shards hang
    on the texts alone, and slots on keys and texts, however the rows are dealt to partitions.
    Size is the text's UTF-8 bytes plus 1 (null text: 1; the null texts make a group, apart from the empty ones).
    slot counts the documents of a shard from 0 without gaps, by `key` inside hash chunks; rows that are wholly equal
    get slots of their own, and many of them are numbered in parts. An empty table gives no rows. Columns of these names that docs has are replaced.
    """
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    docs = docs.drop(*added)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    groups = docs.select(text_id(F.col(text)).alias("__tid"), size.alias("__size")).groupBy("__tid").agg(F.sum("__size").alias("size"), F.count("*").alias("n"))
    groups = stored(groups.withColumn("item", F.hex("__tid")), "shard-texts")
    n, total, rows = groups.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shard_of = stored(groups.select("__tid", "item", "n").join(assign_groups(groups, shards, total, n), "item").select("__tid", "n", "shard"), "shard-of-text")
    sized = docs.withColumns({"__tid": text_id(F.col(text)), "size": size, "text_crc32": F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))})
    placed = with_facts(sized, shard_of, "__tid", "n").drop("__tid")
    pair = F.xxhash64(F.col(key), "text_crc32")
    chunk = F.pmod(pair, F.lit(max(1, rows // CHUNK))).cast("int")
    placed = placed.withColumns({"__pair": pair, "__chunk": chunk})
    # the sums of the chunks come from the slim columns, so that no text is shuffled for them
    slim = with_facts(sized.select("__tid", pair.alias("__pair"), chunk.alias("__chunk")), shard_of, "__tid", "n")
    cell = ["shard", "__chunk"]
    counts = stored(slim.groupBy(*cell).count(), "shard-chunks")
    most = max(4 * CHUNK, rows // CROWDS)
    full = counts.where(F.col("count") > most)
    if full.limit(1).count():
        cell = [*cell, "__own", "__part"]
        placed, counts = _split_crowds(placed, slim, full, most, cell)
    numbered = placed.withColumn("__in", F.row_number().over(Window.partitionBy(*cell).orderBy(F.col(key), "text_crc32")))
    upto = F.sum("count").over(Window.partitionBy("shard").orderBy(*cell[1:]))
    before = counts.select(*cell, (upto - F.col("count")).alias("__before"))
    slots = numbered.join(before, cell).withColumn("slot", F.col("__before") + F.col("__in") - 1)
    order = [c for c in docs.columns] + added
    return slots.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).select(*order)
