"""Quality rules: base rules on words and lines, and tokeniser fertility with bands per language or script."""

from __future__ import annotations

import base64
import functools
import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardiolake.llm.common import SPACE, per_text, raw_bytes, stored, strided_counts, sums_by_text, word_codes

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
#: Distinct words whose ids a worker keeps; beyond that it starts anew.
MEMO = 1_000_000
#: Tokens that are sorted at once to be counted (a longer text's all at once).
TOKENS = 200_000
#: Bands around a group's median, in natural logarithms of the ratio to it (above the median, for shares of bytes):
#: half-widths for a text of very many tokens, and what is added divided by the root of its tokens.
CHARS_BAND, EVENNESS_BAND, BYTES_OVER = (0.15, 1.2), (0.45, 1.2), (0.10, 0.5)
#: Medians are those of values rounded to this many parts of one.
PARTS = 1_000


def repeated_words(codes: np.ndarray, at: np.ndarray, width: int = 5) -> np.ndarray:
    """For each word of each text: whether it lies in a window of `width` words found twice or more in that text."""
    n = len(codes)
    cover = np.zeros(n + 1, dtype=np.int64)
    if n >= width:
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        starts = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
        h = doc[starts].astype(np.uint64)
        for k in range(width):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + codes[starts + k].astype(np.uint64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        order = np.argsort(h, kind="stable")
        twin = np.flatnonzero(h[order[1:]] == h[order[:-1]])
        a, b = starts[order[twin]], starts[order[twin + 1]]
        same = doc[a] == doc[b]
        for k in range(width):
            same &= codes[a + k] == codes[b + k]
        hit = np.unique(np.concatenate([a[same], b[same]]))
        cover[hit] += 1
        np.add.at(cover, hit + width, -1)
    return np.cumsum(cover)[:n] > 0


def duplicate_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier line of it."""
    feed = data == 0x0A
    heads = np.zeros(len(data) + 1, dtype=bool)
    heads[1:][feed] = True
    heads[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    heads = np.flatnonzero(heads[:-1])
    if not len(heads):
        return np.zeros(len(offsets) - 1, dtype=np.int64)
    kept = np.concatenate([[0], np.cumsum(~feed)])
    bounds = np.append(kept[heads], kept[-1]).astype(np.int64)
    packed = np.ascontiguousarray(data[~feed])
    array = pa.Array.from_buffers(pa.large_binary(), len(heads), [None, pa.py_buffer(bounds), pa.py_buffer(packed)])
    codes = array.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    visible = np.concatenate([[0], np.cumsum(~SPACE[data])])
    ends = np.append(heads[1:], len(data))
    worded = visible[ends] > visible[heads]
    doc = np.searchsorted(offsets, heads, side="right") - 1
    key = (doc * (int(codes.max()) + 1) + codes)[worded]
    lines = np.bincount(doc[worded], minlength=len(offsets) - 1)
    distinct = np.bincount(doc[worded][np.unique(key, return_index=True)[1]], minlength=len(offsets) - 1)
    return lines - distinct


class Fertility:
    """Token counts of texts by a public vocabulary, each distinct word encoded once while the memo holds it.

    A sentencepiece model's byte tokens are its fallback bytes (and the unknown one); those of a byte-level vocabulary
    (ranks, with its pattern) are tokens that are no text by themselves, pieces of a character. Words of the latter
    have a blank before them, as inside a line.
    """

    def __init__(self, path: str, pattern: str | None = None):
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as file:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
            coder = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            # one by one: a batch hands each word to a pool of threads, which costs more than its encoding
            self.encode = lambda words: [coder.encode_ordinary(f" {w}") for w in words]
            self.is_byte = np.zeros(max(ranks.values()) + 1, dtype=bool)
            self.is_byte[[rank for token, rank in ranks.items() if b"\xef\xbf\xbd" in token.decode("utf-8", "replace").encode() and b"\xef\xbf\xbd" not in token]] = True
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda words: model.encode(words, num_threads=1)
            self.is_byte = np.array([model.is_byte(i) or model.is_unknown(i) for i in range(model.vocab_size())])
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.begins, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and length of each word's ids, and all ids that the memo holds."""
        if len(self.memo) > MEMO:
            self._forget()
        memo = self.memo
        new = [w for w in words if w not in memo]
        if new:
            lists = self.encode([w.decode("utf-8") for w in new])
            lengths = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
            flat = np.fromiter(itertools.chain.from_iterable(lists), dtype=np.int32, count=int(lengths.sum()))
            self.begins = np.concatenate([self.begins, np.cumsum(lengths) - lengths + len(self.flat)])
            self.lengths, self.flat = np.concatenate([self.lengths, lengths]), np.concatenate([self.flat, flat])
            memo.update(zip(new, range(len(memo), len(memo) + len(new)), strict=True))
        at = np.fromiter(map(memo.__getitem__, words), dtype=np.int64, count=len(words))
        return self.begins[at], self.lengths[at], self.flat

    def measure(self, codes: np.ndarray, words: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, byte tokens and entropy in bits of each text's tokens."""
        begin, lengths, flat = self.ids(words)
        run = lengths[codes] if len(codes) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(run)])
        ends = total[at]
        n_bytes, entropy = np.zeros(len(at) - 1, np.int64), np.zeros(len(at) - 1)
        first = 0
        while first < len(at) - 1:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + TOKENS, side="right")) - 1)
            own = slice(int(at[first]), int(at[last]))
            tokens = flat[np.repeat(begin[codes[own]], run[own]) + strided_counts(run[own])] if own.stop > own.start else np.zeros(0, np.int32)
            n = np.diff(ends[first : last + 1])
            n_bytes[first:last] = sums_by_text(self.is_byte[tokens], ends[first : last + 1] - ends[first])
            keys = np.sort(np.repeat(np.arange(last - first), n) * len(self.is_byte) + tokens)
            heads = np.flatnonzero(np.diff(keys, prepend=-1))
            c = np.diff(np.append(heads, len(keys))).astype(float)
            e = np.bincount(keys[heads] // len(self.is_byte), weights=c * np.log2(c), minlength=last - first)
            entropy[first:last] = np.where(n > 0, np.log2(np.maximum(n, 1)) - e / np.maximum(n, 1), 0.0)
            first = last
        return np.diff(ends), n_bytes, np.maximum(entropy, 0)


@functools.lru_cache(maxsize=8)
def fertility_of(path: str, pattern: str | None) -> Fertility:
    """A worker's vocabulary: its memo outlives a task, as workers are used again."""
    return Fertility(path, pattern)


def script(text: Column) -> Column:
    """The script of at least half of the letters, of those named here; 'none' without a letter, else 'other'. For texts without a language."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]+", "")
    rest = {"Greek": r"\p{IsGreek}", "Cyrillic": r"\p{IsCyrillic}", "Arabic": r"\p{IsArabic}", "Hebrew": r"\p{IsHebrew}", "CJK": r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]", "Hangul": r"\p{IsHangul}", "Latin": r"\p{IsLatin}"}
    counts = F.array(*[F.struct(F.regexp_count(letters, F.lit(p)).alias("n"), F.lit(name).alias("name")) for name, p in rest.items()])
    best = F.array_max(counts)
    return F.when(F.length(letters) == 0, "none").when(best["n"] * 2 < F.length(letters), "other").otherwise(best["name"])


#: Names of vocabularies with functions that find a file and a pattern (None for sentencepiece models) on any machine.
Vocabularies = dict[str, Callable[[], tuple[str, str | None]]]


def measured(docs: DataFrame, vocabularies: Vocabularies, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and n_tokens, n_byte_tokens and entropy by each vocabulary."""

    def make():
        known = [fertility_of(*find()) for find in vocabularies.values()]

        def measure(column: pa.Array) -> list[pa.Array]:
            data, offsets = raw_bytes(column)
            codes, distinct, at, _ = word_codes(data, offsets)
            points = sums_by_text(((data & 0xC0) != 0x80) & ~SPACE[data], offsets)
            columns = [np.diff(at), points, sums_by_text(SYMBOLS[data], offsets), duplicate_lines(data, offsets), sums_by_text(repeated_words(codes, at), at)]
            words = distinct.to_pylist()
            found = [f.measure(codes, words, at) for f in known]
            return [pa.array(c.astype(np.int64)) for c in columns] + [pa.array(a) for arrays in found for a in arrays]

        return measure

    own = ", ".join(f"n_tokens_{v} long, n_byte_tokens_{v} long, entropy_{v} double" for v in vocabularies)
    return per_text(docs, text, make, f"n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, {own}", keep)


def medians(rows: DataFrame, group: str, measures: list[str]) -> DataFrame:
    """__group, __medians: for each group an array with the (lower) median of each measure, rounded to 1/PARTS.

    From exact counts of rounded values: a group costs as many rows as it has different values, not as it has texts.
    """
    values = F.array(*[F.struct(F.lit(i).alias("m"), F.round(F.col(c) * PARTS).cast("long").alias("v")) for i, c in enumerate(measures)])
    counts = rows.select(F.col(group).alias("__group"), F.explode(values).alias("x")).groupBy("__group", "x.m", "x.v").agg(F.count("*").alias("n"))
    one = Window.partitionBy("__group", "m")
    upto = F.sum("n").over(one.orderBy(F.col("v").asc_nulls_first()))
    least = counts.withColumns({"upto": upto, "all": F.sum("n").over(one)}).where("2 * upto >= all").groupBy("__group", "m").agg(F.min("v").alias("v"))
    return least.groupBy("__group").agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "v"))), lambda x: x["v"] / PARTS).alias("__medians"))


def judge(docs: DataFrame, vocabularies: Vocabularies, text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """docs with the measures, the ratios by each vocabulary, base_failed and kept.

    base_failed: under 10 words, or more than a fifth of the words in repeated 5-word windows. The method's verdict:
    by every vocabulary, characters per token, byte share and token entropy (as a part of the most that so many tokens
    can have) lie within bands around the medians of the text's group. A group is a language or, where it is null, a
    script; medians are taken over all documents that pass the base rules. Bands are the wider the fewer tokens a text
    has, with the root of their number; no text is exempt. Null and empty texts have no words and fail. Empty tables
    give no rows; repeated rows are judged alike; a group of one document is its own median and passes. Columns of
    the added names that docs has are replaced.
    """
    ratios = [f"{r}_{v}" for v in vocabularies for r in ("chars_per_token", "byte_share", "evenness")]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"{c}_{v}" for v in vocabularies for c in ("n_tokens", "n_byte_tokens", "entropy")), *ratios, "fertility_group", "base_failed", "kept"]
    docs = docs.drop(*names)
    columns = list(docs.columns if keep is None else keep)
    grouped = docs.withColumn("fertility_group", F.coalesce(F.col(lang), F.concat(F.lit("script "), script(F.col(text)))))
    rows = measured(grouped, vocabularies, text, [*columns, "fertility_group"])
    for v in vocabularies:
        n = F.col(f"n_tokens_{v}")
        evenness = F.try_divide(f"entropy_{v}", F.log2(F.greatest(n, F.lit(2)).cast("double")))
        rows = rows.withColumns({f"chars_per_token_{v}": F.try_divide(F.col("word_chars"), n), f"byte_share_{v}": F.try_divide(F.col(f"n_byte_tokens_{v}"), n), f"evenness_{v}": evenness})
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    rows = stored(rows.withColumn("base_failed", failed), "quality")
    # stored, the few rows of medians have a known size, by which Spark decides to broadcast them
    middle = stored(medians(rows.where("not base_failed"), "fertility_group", ratios), "quality-medians")
    joined = rows.join(middle, F.col("fertility_group") == F.col("__group"), "left")
    good = F.lit(True)
    for i, v in enumerate(vocabularies):
        root = F.sqrt(F.greatest(F.col(f"n_tokens_{v}"), F.lit(1)).cast("double"))
        median = lambda k, i=i: F.element_at("__medians", 3 * i + k)
        apart = lambda c, k: F.abs(F.log(F.col(c) / median(k)))
        good &= apart(f"chars_per_token_{v}", 1) <= CHARS_BAND[0] + CHARS_BAND[1] / root
        good &= F.col(f"byte_share_{v}") - median(2) <= BYTES_OVER[0] + BYTES_OVER[1] / root
        good &= apart(f"evenness_{v}", 3) <= EVENNESS_BAND[0] + EVENNESS_BAND[1] / root
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(good, F.lit(False))).select(*columns, *names)
