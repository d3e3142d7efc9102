"""Benchmark decontamination: a prefix-filtered set join of item windows with whole documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardiolake.llm.common import FOLD, folded, per_text, raw_bytes, stored, strided_counts, sums_by_text, text_id, with_facts, word_codes

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OUTSIDE = np.ones(256, dtype=bool)
OUTSIDE[0x30:0x3A] = OUTSIDE[0x61:0x7B] = OUTSIDE[0x80:] = False
#: Windows that one broadcast holds at most; more are joined by Spark.
BLOCK_WINDOWS = 50_000
#: Bits of the filter of prefix words, by which the join's tasks choose what they send: 2 MB.
FILTER_BITS = 1 << 24
#: Candidate pairs verified at once.
PAIRS = 2_000_000


def item_windows(benchmark: DataFrame, window: int, text: str = "text", item: str = "item_id") -> DataFrame:
    """Every window of every item, with its rarest word (in the fewest items; of a tie the longest, then the first): item, words, word, offset."""
    words = F.regexp_extract_all(folded(F.col(text)), F.lit(WORD), F.lit(0))
    items = benchmark.select(F.col(item).cast("string").alias("item"), words.alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    windows = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("all", i, window))).alias("words")).distinct()
    rarity = items.select("item", F.explode(F.array_distinct("all")).alias("word")).groupBy("word").agg(F.countDistinct("item").alias("df"))
    placed = windows.select("item", "words", F.posexplode("words").alias("offset", "word")).join(rarity, "word")
    rarest = F.min(F.struct("df", (-F.length("word")).alias("short"), "offset", "word")).alias("r")
    return placed.groupBy("item", "words").agg(rarest).select("item", "words", F.col("r.word").alias("word"), F.col("r.offset").alias("offset"))


class Finder:
    """Windows of one block, by their rarest words."""

    def __init__(self, rows: list):
        self.vocabulary: dict[bytes, int] = {}
        rows = sorted(rows, key=lambda r: (r["word"], r["words"], r["item"] or ""))
        self.size = max((len(r["words"]) for r in rows), default=0)
        self.windows = np.full((len(rows), self.size), -1, dtype=np.int32)
        for i, r in enumerate(rows):
            for k, w in enumerate(r["words"]):
                self.windows[i, k] = self.vocabulary.setdefault(w.encode(), len(self.vocabulary))
        self.length = np.array([len(r["words"]) for r in rows], dtype=np.int64)
        self.offset = np.array([r["offset"] for r in rows], dtype=np.int64)
        self.items = [r["item"] for r in rows]
        first = np.array([self.vocabulary[r["word"].encode()] for r in rows], dtype=np.int64)
        # windows by their prefix word: a run each
        self.order = np.argsort(first, kind="stable")
        self.begin = np.searchsorted(first[self.order], np.arange(len(self.vocabulary) + 1))

    def find(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[int]], list[list[str]]]:
        """Words, hit words, hit spans (first word, word behind the last, ..) and items of each text."""
        data, offsets = raw_bytes(column)
        codes, distinct, at, _ = word_codes(FOLD[data], offsets, OUTSIDE)
        known = np.fromiter((self.vocabulary.get(w, -1) for w in distinct.to_pylist()), dtype=np.int32, count=len(distinct))
        seq = known[codes] if len(codes) else np.zeros(0, np.int32)
        runs = np.append(np.diff(self.begin), 0)  # the last entry is for unknown words (-1)
        places = np.flatnonzero(runs[seq] > 0)
        found_start, found_window = [], []
        taken = 0
        counts = runs[seq[places]]
        ends = np.cumsum(counts)
        while taken < len(places):
            upto = max(taken + 1, int(np.searchsorted(ends, (ends[taken - 1] if taken else 0) + PAIRS, side="right")))
            some, n = places[taken:upto], counts[taken:upto]
            window = self.order[np.repeat(self.begin[seq[some]], n) + strided_counts(n)]
            place = np.repeat(some, n)
            doc = np.searchsorted(at, place, side="right") - 1
            start = place - self.offset[window]
            fits = (start >= at[doc]) & (start + self.length[window] <= at[doc + 1])
            start, window = start[fits], window[fits]
            for k in range(self.size):
                inside = k < self.length[window]
                same = ~inside
                same[inside] = seq[start[inside] + k] == self.windows[window[inside], k]
                start, window = start[same], window[same]
            found_start.append(start)
            found_window.append(window)
            taken = upto
        start = np.concatenate(found_start) if found_start else np.zeros(0, np.int64)
        window = np.concatenate(found_window) if found_window else np.zeros(0, np.int64)
        spans: list[list[int]] = [[] for _ in range(len(column))]
        items: list[list[str]] = [[] for _ in range(len(column))]
        n_hit = np.zeros(len(column), np.int64)
        if len(start):
            cover = np.zeros(len(seq) + 1, dtype=np.int64)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + self.length[window], -1)
            hit = np.cumsum(cover)[:-1] > 0
            n_hit = sums_by_text(hit, at)
            doc_of_word = np.searchsorted(at, np.arange(len(seq)), side="right") - 1 if len(start) > 1_000 else None
            edge = hit.copy()
            edge[1:] &= ~hit[:-1]
            edge[at[:-1][at[:-1] < len(seq)]] |= hit[at[:-1][at[:-1] < len(seq)]]
            begins = np.flatnonzero(edge)
            last = hit.copy()
            last[:-1] &= ~hit[1:]
            ends_at = at[1:][at[1:] > at[:-1]] - 1
            last[ends_at] |= hit[ends_at]
            finish = np.flatnonzero(last) + 1
            docs = doc_of_word[begins] if doc_of_word is not None else np.searchsorted(at, begins, side="right") - 1
            for d, b, e in zip(docs.tolist(), (begins - at[docs]).tolist(), (finish - at[docs]).tolist(), strict=True):
                spans[d] += [b, e]
            docs = np.searchsorted(at, start, side="right") - 1
            for d, w in set(zip(docs.tolist(), window.tolist(), strict=True)):
                if self.items[w] is not None:
                    items[d].append(self.items[w])
        return np.diff(at), n_hit, spans, [sorted(set(x)) for x in items]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", keep: list[str] | None = None, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs with n_words, n_hit, spans, items and contaminated: the words inside any occurrence of an item's window.

    A window is `window` consecutive words of an item; an item of fewer, but not none, is one. For whole containment
    one prefix word suffices: the rarest of a window. Where it stands in a document, its offset gives the only place
    the window can have; the bounds of the document are applied, and then all words compared. Up to block_windows
    windows (a count is taken first) are broadcast; more meet the documents' prefix words in a join. spans are
    disjoint, first word and word behind the last of each.
    Null and empty texts have no words and are clean, as is everything where the benchmark is empty; items that are
    null or have no words are never hit; items of equal text are all listed, null item ids are not. Repeated rows are
    judged alike. Columns of the added names that docs has are replaced.
    """
    docs = docs.drop("n_words", "spans", "items", "n_hit", "contaminated")
    keep = [c for c in (docs.columns if keep is None else keep) if c in docs.columns]
    windows = stored(item_windows(benchmark, window), "leak-windows")
    found = _scanned(docs, windows, text, keep) if windows.count() <= block_windows else _joined(docs, windows, window, text, keep)
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def _scanned(docs: DataFrame, windows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast([r.asDict() for r in windows.collect()])

    def make():
        finder = Finder(shared.value)

        def find(column: pa.Array) -> list[pa.Array]:
            n, n_hit, spans, items = finder.find(column)
            return [pa.array(n, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]

        return find

    return per_text(docs, text, make, "n_words long, n_hit long, spans array<long>, items array<string>", keep)


def _joined(docs: DataFrame, windows: DataFrame, window: int, text: str, keep: list[str]) -> DataFrame:
    """The join proper: each place of a prefix word goes, with the words around it, to the windows of that prefix word.

    A filter of fixed size, made by Spark as bitmaps, tells tasks which words can be prefix words. A frequent prefix
    word is an ordinary skewed join key, which adaptive execution splits.
    """
    spark = docs.sparkSession
    slot = F.pmod(F.xxhash64("word"), F.lit(FILTER_BITS)) + 1
    bits = windows.select(F.bitmap_bucket_number(slot).alias("nth"), F.bitmap_bit_position(slot).alias("bit")).groupBy("nth").agg(F.bitmap_construct_agg("bit").alias("bits"))
    shared = spark.sparkContext.broadcast({r["nth"]: bytes(r["bits"]) for r in bits.collect()})  # FILTER_BITS at most
    around = window - 1

    def make():
        table = np.zeros(FILTER_BITS, dtype=bool)
        for nth, part in shared.value.items():
            table[(nth - 1) * 8 * len(part) : nth * 8 * len(part)] = np.unpackbits(np.frombuffer(part, np.uint8), bitorder="little")

        def places(column: pa.Array) -> list[pa.Array]:
            data, offsets = raw_bytes(column)
            codes, distinct, at, _ = word_codes(FOLD[data], offsets, OUTSIDE)
            wanted = np.fromiter((table[xxhash.xxh64_intdigest(w, 42) % FILTER_BITS] for w in distinct.to_pylist()), dtype=bool, count=len(distinct))
            place = np.flatnonzero(wanted[codes]) if len(codes) else np.zeros(0, np.int64)
            doc = np.searchsorted(at, place, side="right") - 1
            first, last = np.maximum(place - around, at[doc]), np.minimum(place + around + 1, at[doc + 1])
            words = distinct.cast(pa.string())

            def lists(begin: np.ndarray, end: np.ndarray) -> pa.Array:
                n = end - begin
                index = np.repeat(begin, n) + strided_counts(n)
                return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), words.take(pa.array(codes[index])))

            rows = pa.StructArray.from_arrays([pa.array(place - at[doc]), words.take(pa.array(codes[place])), lists(first, place), lists(place, last)], names=["place", "word", "before", "behind"])
            ends = np.searchsorted(place, at).astype(np.int32)
            return [pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(ends), rows)]

        return places

    added = "n_words long, __at array<struct<place: long, word: string, before: array<string>, behind: array<string>>>"
    marked = docs.withColumn("__tid", text_id(F.col(text)))
    rows = stored(per_text(marked, text, make, added, [*keep, "__tid"]), "leak-places")
    at = rows.select("__tid", F.explode("__at").alias("p")).select("__tid", "p.*")
    inside = (F.col("offset") <= F.size("before")) & (F.size("words") - F.col("offset") <= F.size("behind"))
    own = F.expr("concat(slice(before, greatest(size(before) - offset + 1, 1), offset), slice(behind, 1, size(words) - offset))")
    hits = at.join(windows, "word").where(inside & (own == F.col("words"))).withColumn("begin", F.col("place") - F.col("offset"))
    merged = F.expr(
        "aggregate(array_sort(__spans), cast(array() as array<bigint>), (done, x) -> if(size(done) > 0 and x.begin <= element_at(done, -1),"
        " concat(slice(done, 1, size(done) - 1), array(greatest(element_at(done, -1), x.end))), concat(done, array(x.begin, x.end))))"
    )
    span = F.struct("begin", (F.col("begin") + F.size("words")).alias("end"))
    facts = hits.groupBy("__tid").agg(F.collect_set(span).alias("__spans"), F.array_sort(F.collect_set("item")).alias("items")).withColumn("spans", merged)
    n_hit = F.expr("aggregate(spans, 0L, (n, x) -> x - n)")  # begin and end in turn: each end less its begin, added up
    facts = facts.withColumn("n_hit", n_hit).select("__tid", "n_hit", "spans", "items")
    copies = rows.groupBy("__tid").agg(F.count("*").alias("__n")).join(facts, "__tid", "left")
    nothing = {"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "spans": F.coalesce("spans", F.array().cast("array<long>")), "items": F.coalesce("items", F.array().cast("array<string>"))}
    return with_facts(rows.drop("__at"), stored(copies.withColumns(nothing), "leak-hits"), "__tid", "__n").drop("__tid")


def digest(found: DataFrame) -> DataFrame:
    """Adds n_items and items_sha256 (the items sorted as strings, comma-joined) for reports."""
    return found.withColumn("n_items", F.size("items").cast("long")).withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256))


ORACLE_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS words
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes WHERE len(w) >= n),
occ AS (SELECT dp.doc_id, dp.s, dp.n, win.item FROM dp JOIN win ON win.n = dp.n AND win.words = array_to_string(dp.w[dp.s : dp.s + dp.n - 1], ' ')),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
