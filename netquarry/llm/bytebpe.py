"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is split by the vocabulary's pattern. First tier: pre-tokens that are whole
entries of the vocabulary are found by a minimal perfect hash, a batch of distinct
pre-tokens at a time, and compared byte by byte with the one entry they can be.
Second tier: the others are merged from single bytes, a heap giving the lowest rank,
leftmost first, over a linked list of the parts. The rank file is a parameter,
read by the driver and sent to the tasks in the closure.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbytes import mix, slices, utf8

#: Characters of text that are split at a time; a longer text is cut before white space.
PIECE = 1 << 18
#: Bytes of texts whose ids are held at a time; a longer text stands alone.
SLICE = 1 << 22
#: Pre-tokens up to this length stay known to a worker, this many at a time.
SHORT, KNOWN = 64, 1 << 18

_ROOM = 1.5


class PerfectHash:
    """Maps n distinct byte strings onto 0 .. n - 1, one each; any other string onto some entry or -1.

    Each level has a table half as large again as the keys left: keys that fall on a
    place of their own are numbered by it, the others go to the next level.
    """

    def __init__(self, keys: list[bytes]) -> None:
        if len(set(keys)) != len(keys):
            raise ValueError("keys repeat")
        self.seed = next(s for s in range(64) if len(np.unique(self._hashes(keys, s))) == len(keys))
        self.levels: list[np.ndarray] = []
        left, n = self._hashes(keys, self.seed), 0
        while len(left):
            size = int(len(left) * _ROOM) + 1
            place = self._place(left, len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            numbers = np.where(alone, np.cumsum(alone) - 1 + n, -1).astype(np.int32)
            n += int(alone.sum())
            self.levels.append(numbers)
            left = left[~alone[place]]

    @staticmethod
    def _hashes(keys: list[bytes], seed: int) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(k, seed) for k in keys), np.uint64, len(keys))

    @staticmethod
    def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(hashes + np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))) % np.uint64(size)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        hashes = self._hashes(keys, self.seed)
        out, open_ = np.full(len(keys), -1, np.int32), np.arange(len(keys))
        for level, numbers in enumerate(self.levels):
            got = numbers[self._place(hashes[open_], level, len(numbers))]
            out[open_] = got
            open_ = open_[got < 0]
        return out


class Vocabulary:
    """Byte strings with ranks; every single byte must have one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"{len(missing)} single bytes have no rank")
        self.ranks, self.pattern = ranks, pattern

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        """From a file of lines with a base64 string and its rank, on the driver."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}, pattern)


def merge(token: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ranks of a byte string's parts after merging neighbours of the lowest rank, leftmost first, while any pair has a rank."""
    n, rank_of = len(token), ranks.get
    row = list if n < 1 << 12 else lambda x: array("q", x)
    after, ahead = row(range(1, n + 2)), row(range(-1, n))
    # of each part with the one after it; -1: none, or no part begins here any more
    pair = row([rank_of(token[i : i + 2], -1) for i in range(n - 1)] + [-1])
    # one number an entry, rank and then place; it is alive while the pair at the place still has that rank
    shift = n.bit_length()
    here = (1 << shift) - 1
    heap = [r << shift | i for i, r in enumerate(pair) if r >= 0]
    heapq.heapify(heap)
    while heap:
        entry = heapq.heappop(heap)
        i = entry & here
        if pair[i] != entry >> shift:
            continue
        j = after[i]
        end = after[i] = after[j]
        pair[j] = -1
        if end < n:
            ahead[end] = i
            r = pair[i] = rank_of(token[i : after[end]], -1)
            if r >= 0:
                heapq.heappush(heap, r << shift | i)
        else:
            pair[i] = -1
        p = ahead[i]
        if p >= 0:
            r = pair[p] = rank_of(token[p:end], -1)
            if r >= 0:
                heapq.heappush(heap, r << shift | p)
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i : after[i]]])
        i = after[i]
    return tuple(out)


def pieces(text: str) -> Iterator[str]:
    """The text in parts of about PIECE characters. A part ends between another character and white space, where every match of the pattern ends, so the matches are those of the whole text."""
    at, n = 0, len(text)
    gap = regex.compile(r"(?<=\S)\s")
    while n - at > PIECE:
        cut = gap.search(text, at + PIECE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    if at < n or not n:
        yield text[at:]


class Encoder:
    """A worker's two tiers over one vocabulary; the pre-tokens met last stay known, at most twice KNOWN of them."""

    def __init__(self, vocabulary: Vocabulary, hashed: PerfectHash) -> None:
        self.ranks, self.hashed = vocabulary.ranks, hashed
        self.split = regex.compile(vocabulary.pattern).findall
        keys = list(vocabulary.ranks)
        self.entries, self.ids = [b""] * len(keys), [()] * len(keys)
        for at, key in zip(hashed.find(keys).tolist(), keys):
            self.entries[at], self.ids[at] = key, (vocabulary.ranks[key],)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _learn(self, tokens: set[str]) -> None:
        """Resolves pre-tokens, all at once in the first tier."""
        if len(self.known) > KNOWN:
            self.known, self.older = {}, self.known
        fresh = []
        for t in tokens.difference(self.known):
            if (found := self.older.get(t)) is None:
                fresh.append(t)
            else:
                self.known[t] = found
        raw = [t.encode() for t in fresh]
        for t, b, at in zip(fresh, raw, self.hashed.find(raw).tolist()):
            self.known[t] = self.ids[at] if at >= 0 and self.entries[at] == b else merge(b, self.ranks)

    def encode(self, texts: list[str]) -> list[array]:
        out = [array("i") for _ in texts]
        group: list[tuple[array, list[str]]] = []
        size = 0
        for ids, text in zip(out, texts):
            for part in pieces(text):
                group.append((ids, self.split(part)))
                size += len(part)
                if size >= PIECE:
                    self._written(group)
                    group, size = [], 0
        self._written(group)
        return out

    def _written(self, group: list[tuple[array, list[str]]]) -> None:
        tokens = set().union(*(t for _, t in group))
        self._learn(tokens)
        for ids, part in group:
            ids.extend(chain.from_iterable([self.known[t] for t in part]))
        for t in tokens:
            if len(t) > SHORT:
                del self.known[t]


def _encoding(vocabulary: Vocabulary, hashed: PerfectHash) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, hashed)
        for batch in batches:
            texts = batch["text"]
            if isinstance(texts, pa.ChunkedArray):
                texts = texts.combine_chunks()
            _, offsets = utf8(texts)
            for begin, end in slices(offsets, SLICE):
                held = encoder.encode([t or "" for t in texts.slice(begin, end - begin).to_pylist()])
                ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.frombuffer(x, np.int32) if x else np.zeros(0, np.int32) for x in held])))
                yield pa.RecordBatch.from_arrays([batch["key"].slice(begin, end - begin), ids], ["key", "ids"])

    return run


def encode(df: DataFrame, key: str, text: str, vocabulary: Vocabulary) -> DataFrame:
    """(key, ids) of every row of df: the ranks of its whole text, null and empty texts without any.

    Each row of df gives one row, repeated keys and null keys too; other columns are not
    read, whatever their names. Texts of any length are encoded whole, in parts that
    end where the pattern's matches end; one single match of n bytes (a run of
    blanks, say) takes about 60 n bytes in a task. The pattern must end every match between a
    character and white space that follows it, as the published ones of this kind do.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_encoding(vocabulary, PerfectHash(list(vocabulary.ranks))), f"key {kind}, ids array<int>")


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """The bytes that an array of ranks stands for; null for a null array, an error for a rank that the vocabulary lacks. They need not be UTF-8 where a caller cuts ids."""
    entries = {rank: entry for entry, rank in vocabulary.ranks.items()}
    table = np.array([entries.get(r) for r in range(max(entries) + 1)], object)

    def one(x: np.ndarray | None) -> bytes | None:
        if x is None:
            return None
        if len(x) and (x.min() < 0 or x.max() >= len(table)):
            raise ValueError("a rank is not in the vocabulary")
        return b"".join(table[x])  # an unused rank is None and not joined

    @F.pandas_udf("binary")
    def joined(column: pd.Series) -> pd.Series:
        return column.map(one, na_action="ignore")

    return joined(ids)
