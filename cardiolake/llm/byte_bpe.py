"""Byte-level BPE by dynamic programming over prefixes: each prefix of a match has one last token, stored for appends and edits."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cardiolake.llm.common import per_text, raw_bytes
from cardiolake.llm.token_files import pieces

BLOCK_BYTES = 4_000_000
#: Distinct pieces, and pairs of tokens, that a worker keeps; beyond that it starts anew.
MEMO, PAIRS = 500_000, 400_000
#: Characters behind a match's start that can decide where it ends, besides the one behind its end: a contraction has three.
AHEAD = 3
#: A rank above all.
NEVER = 1 << 60


class Ranks:
    """A vocabulary of byte strings with ranks: which tokens can follow each other, and the last token of every prefix."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        size = max(ranks.values()) + 1
        strings = [b""] * size
        for token, rank in ranks.items():
            strings[rank] = token
        self.strings = strings
        self.lengths = np.fromiter(map(len, strings), dtype=np.int64, count=size)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(strings), dtype=np.uint8)
        #: the tokens by their bytes from behind: a walk backwards stops where no token is left; key -1 has the rank
        self.backwards: dict = {}
        #: for each token: it and its last parts, its first parts, each with the rank at which the part merges on
        self.right: list = [None] * size
        self.left: list = [None] * size
        self.follows: dict[tuple[int, int], bool] = {}
        self.proper = True
        for token, rank in sorted(ranks.items(), key=lambda t: t[1]):
            parts = self.merged(token, stop=2)
            if len(parts) == 1:
                self.left[rank] = self.right[rank] = ((rank, NEVER),)
            elif parts[0] + parts[1] in ranks and (a := ranks[parts[0]]) < rank and (b := ranks[parts[1]]) < rank and self.left[a] and self.right[b]:
                self.left[rank] = (*self.left[a][:-1], (a, rank), (rank, NEVER))
                self.right[rank] = (*self.right[b][:-1], (b, rank), (rank, NEVER))
            else:  # no encoding holds a token that its own bytes don't merge to; one made of higher ranks has no spine
                self.proper &= self.merged(token) != [token]
                if self.merged(token) != [token]:
                    continue
            node = self.backwards
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[-1] = rank

    def merged(self, data: bytes, stop: int = 1) -> list[bytes]:
        """The definition, for short strings: of all neighbours whose bytes together have a rank, those of least rank (the first, for ties) merge, until `stop` or none are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > stop:
            rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens merge to just these two.

        They don't if, at some time, the last part of the left one and the first part of the right one merge before
        either merges on in its own token. Of equal ranks, the place further left comes first.
        """
        if not self.proper:
            return self.merged(self.strings[left] + self.strings[right]) == [self.strings[left], self.strings[right]]
        ranks, strings, i, j = self.ranks, self.strings, 0, 0
        a, b = self.right[left], self.left[right]
        while True:
            (x, x_on), (y, y_on) = a[i], b[j]
            rank = ranks.get(strings[x] + strings[y], NEVER)
            if rank < x_on and rank <= y_on and rank < NEVER:
                return False
            if x_on == y_on == NEVER:
                return True
            if x_on <= y_on:
                i += 1
            else:
                j += 1

    def extend(self, data: bytes, last: list[int], until: Callable[[int], bool] | None = None) -> list[int]:
        """Append to `last` the last token of each further prefix of data; until(i) may end it before byte i.

        A token is the last one of a prefix's encoding just if it ends the prefix and its neighbours fit: what is left
        without it has itself one last token, which is stored, and an encoding is right where each two neighbours
        are. So one token fits, and the work is linear in the bytes.
        """
        root, follows = self.backwards, self.follows
        for i in range(len(last), len(data)):
            if until is not None and until(i):
                break
            found, node, k = [], root, i
            while k >= 0 and (node := node.get(data[k])) is not None:
                if -1 in node:
                    found.append((k, node[-1]))
                k -= 1
            for k, rank in reversed(found):
                if not k:
                    break
                pair = last[k - 1], rank
                fit = follows.get(pair)
                if fit is None:
                    if len(follows) >= PAIRS:
                        follows.clear()
                    fit = follows[pair] = self.fits(*pair)
                if fit:
                    break
            last.append(rank)
        return last

    def tokens(self, last: list[int]) -> list[int]:
        """The encoding: the last token of the whole, then that of what lies before it."""
        out, i = [], len(last)
        while i:
            out.append(last[i - 1])
            i -= len(self.strings[last[i - 1]])
        return out[::-1]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids end to end."""
        run = self.lengths[ids]
        ends = np.cumsum(run)
        return self.flat[np.repeat(self.begins[ids] - (ends - run), run) + np.arange(int(run.sum()))]


@dataclass
class Prefixes:
    """A text, its matches, and the last token of each byte prefix of each match. Edits keep what they don't reach."""

    ranks: Ranks
    pattern: regex.Pattern
    text: str = ""
    #: begin of each match in characters, and its table
    begins: list[int] = field(default_factory=list)
    tables: list[list[int]] = field(default_factory=list)

    @property
    def ids(self) -> list[int]:
        return [t for table in self.tables for t in self.ranks.tokens(table)]

    @property
    def last(self) -> list[int]:
        """For each byte of the text, the last token of the match's prefix that ends there."""
        return [t for table in self.tables for t in table]

    def append(self, more: str) -> Prefixes:
        """The text with more behind it."""
        return self.edit(len(self.text), 0, more)

    def edit(self, at: int, removed: int, added: str) -> Prefixes:
        """The text with `removed` characters at `at` replaced by `added`: exactly the encoding of the new text.

        Matches that can't see the place stay; the first one that can keeps its table up to the first byte that
        differs; matching stops where it falls in with the old matches behind the edit, and inside a long match the
        table does so once it has agreed with the old one for as many bytes as the longest token has.
        """
        old = self.text
        text = old[:at] + added + old[at + removed :]
        shift = len(added) - removed
        ends = [*self.begins[1:], len(old)]
        first = len(self.begins)
        # a match looks one character behind its end, and AHEAD behind its start
        while first and (ends[first - 1] + 1 > at or self.begins[first - 1] + AHEAD > at):
            first -= 1
        place = self.begins[first] if first < len(self.begins) else len(old)
        begins, tables = self.begins[:first], self.tables[:first]
        known = {b + shift: k for k, b in enumerate(self.begins) if b >= at + removed}
        while place < len(text):
            if place in known and place >= at + len(added):
                begins += [b + shift for b in self.begins[known[place] :]]
                tables += self.tables[known[place] :]
                break
            match = self.pattern.match(text, place)
            twin = len(begins) if len(begins) < len(self.begins) and self.begins[len(begins)] == place <= at else None
            own = self._table(match.group().encode(), None if twin is None else (old[place : ends[twin]].encode(), self.tables[twin]))
            begins.append(place)
            tables.append(own)
            place = match.end()
        return Prefixes(self.ranks, self.pattern, text, begins, tables)

    def _table(self, data: bytes, before: tuple[bytes, list[int]] | None) -> list[int]:
        """The table of data, from that of an older match with the same start, if there is one."""
        if before is None:
            return self.ranks.extend(data, [])
        was, table = before
        least = min(len(was), len(data))
        a, b = np.frombuffer(was[:least], np.uint8), np.frombuffer(data[:least], np.uint8)
        same = int(np.argmax(a != b)) if (a != b).any() else least
        a, b = np.frombuffer(was[len(was) - least :], np.uint8)[::-1], np.frombuffer(data[len(data) - least :], np.uint8)[::-1]
        tail = int(np.argmax(a != b)) if (a != b).any() else least
        tail = min(tail, least - same)
        shift, reach = len(data) - len(was), self.ranks.longest
        last, agreed = table[:same], 0
        own = len(last)

        def falls_in(i: int) -> bool:
            nonlocal agreed, own
            while own < i:
                behind = own >= len(data) - tail
                agreed = agreed + 1 if behind and last[own] == table[own - shift] else 0
                own += 1
            return agreed >= reach

        self.ranks.extend(data, last, falls_in)
        return last + table[len(last) - shift :] if len(last) < len(data) else last


class PrefixEncoder:
    """Ids of whole texts; each distinct piece is matched and encoded once while the memo holds it."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = Ranks({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)})
        # white space as the property says, not as Python does: its separators 1C to 1F are none
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.begins, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def prefixes(self, text: str) -> Prefixes:
        """The tables of a text."""
        return Prefixes(self.ranks, self.pattern).append(text)

    def restored(self, text: str, last: list[int]) -> Prefixes:
        """The tables of a text from `last`: only the matches are looked for again."""
        begins, tables, byte = [], [], 0
        for match in self.pattern.finditer(text):
            begins.append(match.start())
            size = len(match.group().encode())
            tables.append(last[byte : byte + size])
            byte += size
        return Prefixes(self.ranks, self.pattern, text, begins, tables)

    def lists(self, texts: list[bytes]) -> list[list[int]]:
        """The ids of each of the texts. Distinct matches are encoded once, in order, each from the table of the one before as far as their bytes agree."""
        matches = [self.pattern.findall(t.decode()) for t in texts]
        found, before, table = {}, b"", []
        for word in sorted({word.encode() for words in matches for word in words}):
            k, most = 0, min(len(word), len(before))
            while k < most and word[k] == before[k]:
                k += 1
            del table[k:]
            found[word.decode()] = self.ranks.tokens(self.ranks.extend(word, table))
            before = word
        return [found[words[0]] if len(words) == 1 else [i for word in words for i in found[word]] for words in matches]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and n+1 offsets. Null is empty."""
        data, offsets = raw_bytes(column)
        codes, distinct, at = pieces(data, offsets)
        if len(self.memo) + len(distinct) > MEMO:
            self._forget()
        texts = distinct.to_pylist()
        new = [t for t in texts if t not in self.memo]
        lists = self.lists(new)
        if new:
            lengths = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
            self.begins = np.concatenate([self.begins, np.cumsum(lengths) - lengths + len(self.flat)])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, np.fromiter((i for ids in lists for i in ids), dtype=np.int32, count=int(lengths.sum()))])
            self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new)), strict=True))
        place = np.fromiter(map(self.memo.__getitem__, texts), dtype=np.int64, count=len(texts))[codes]
        run = self.lengths[place]
        total = np.concatenate([[0], np.cumsum(run)])
        return self.flat[np.repeat(self.begins[place] - total[:-1], run) + np.arange(int(total[-1]))], total[at]


@functools.lru_cache(maxsize=2)
def encoder_of(path: str, pattern: str) -> PrefixEncoder:
    """A worker's encoder: its memo outlives a task, as workers are used again."""
    return PrefixEncoder(path, pattern)


def encode_texts(docs: DataFrame, find: Callable[[], tuple[str, str]], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with `ids`, the ids of each whole text (null: empty), each match of the pattern by itself.

    find: gives the path of a rank file and the pattern, on whatever machine. Texts go through Arrow in blocks of
    bounded bytes, a longer text by itself; the work is linear in a text's bytes, however long its matches are. Empty
    texts have no ids, repeated rows the same; an empty table gives no rows; a column `ids` of docs is replaced.
    """

    def make():
        encoder = encoder_of(*find())

        def encoded(column: pa.Array) -> list[pa.Array]:
            ids, at = encoder.encode(column)
            return [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))]

        return encoded

    return per_text(docs, text, make, "ids array<int>", keep, BLOCK_BYTES)


def encode_digests(docs: DataFrame, find: Callable[[], tuple[str, str]], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids) and decoded_sha256 (of the bytes that the ids decode to).

    As encode_texts, in one pass: the worker that has encoded a block decodes its ids again. Columns of these names are replaced.
    """

    def make():
        encoder = encoder_of(*find())

        def digested(column: pa.Array) -> list[pa.Array]:
            ids, at = encoder.encode(column)
            words, raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B"), memoryview(encoder.ranks.decode(ids))
            begins = np.concatenate([[0], np.cumsum(encoder.ranks.lengths[ids])])[at]
            sha = lambda view, cuts: pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.string())
            return [pa.array(np.diff(at)), sha(words, 4 * at), sha(raw, begins)]

        return digested

    return per_text(docs, text, make, "n_tokens long, ids_sha256 string, decoded_sha256 string", keep, BLOCK_BYTES)


def encode_with_prefixes(docs: DataFrame, find: Callable[[], tuple[str, str]], text: str = "text") -> DataFrame:
    """docs with `ids` and `last`: for each byte of the text, the last token of the prefix of its match that ends there.

    The state that `edit_texts` starts from: an array as long as the text.
    """
    return _tables(docs, find, text, None)


def edit_texts(tabled: DataFrame, find: Callable[[], tuple[str, str]], at: str, removed: str, added: str, text: str = "text") -> DataFrame:
    """Rows of encode_with_prefixes with their texts edited, and `ids` and `last` renewed near the edits alone.

    Columns: at (characters before the edit; null: behind the text, an append), removed (characters that go; null: 0),
    added (what comes instead; null: nothing). Places beyond a text's end are its end.
    """
    return _tables(tabled, find, text, (at, removed, added))


def _tables(docs: DataFrame, find, text: str, edit: tuple[str, str, str] | None) -> DataFrame:
    docs = docs.drop("ids", *([] if edit else ["last"]))
    kept = [c for c in docs.columns if c != "last"]
    names = docs.columns
    new = docs.sparkSession.createDataFrame([], "ids array<int>, last array<int>").schema
    schema = type(new)([f for f in docs.schema if f.name != "last"] + list(new))

    def run(batches):
        encoder = encoder_of(*find())
        for batch in batches:
            texts, ids, lasts = [], [], []
            column = lambda name: batch.column(names.index(name)).to_pylist()
            old = column("last") if edit else [None] * batch.num_rows
            edits = zip(*map(column, edit), strict=True) if edit else [None] * batch.num_rows
            for own, last, change in zip(column(text), old, edits, strict=True):
                own = own or ""
                if change is None:
                    table = encoder.prefixes(own)
                else:
                    place, gone, more = change
                    place = len(own) if place is None else min(max(place, 0), len(own))
                    table = encoder.restored(own, last or []).edit(place, min(max(gone or 0, 0), len(own) - place), more or "")
                texts.append(table.text)
                ids.append(table.ids)
                lasts.append(table.last)
            arrays = [pa.array(texts, schema_text) if name == text and edit else batch.column(names.index(name)) for name in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(ids, pa.list_(pa.int32())), pa.array(lasts, pa.list_(pa.int32()))], names=[*kept, "ids", "last"])

    schema_text = pa.string()
    return docs.mapInArrow(run, schema)
