"""Packing tokenised documents into fixed windows by bounded-space online best fit.

Every partition keeps at most OPEN_WINDOWS open windows. A document's tokens are
cut into full windows while it is longer than one; what remains goes into the
open window that it fills best. When none fits, the fullest window is topped up
with the head of the remainder (unless its gap is under TOP_UP) and emitted, and
the rest is placed. The windows still open at a partition's end are merged in
one more round, MERGE_PARTITIONS partitions to a group, by the same rule without
cutting. So padding is below TOP_UP tokens for emitted windows, plus at most
OPEN_WINDOWS part-filled windows a group of partitions.

Tokens: the ids that the `tokenizers` library gives by the file at `tokenizer`,
without special tokens added (strings of the file's added tokens inside a text are
those tokens), with `end` after each document. Texts are encoded in parts, cut
between a character that is not white space and a blank, and before a full stop or
comma after an ASCII letter or digit: no token of a byte-level vocabulary reaches over
such a place, so each part is encoded only once.

Cases: a null or empty text is the end token alone. Any length of text is
handled; memory holds one batch's texts, the ids of a slice of them, and OPEN_WINDOWS windows;
a run without such a place is one part. Repeated rows
and ids are packed each for itself: a piece names its document by key only. An
empty table gives no piece. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import cut
from .textbytes import hashes, slices, utf8

OPEN_WINDOWS = 32
TOP_UP = 16
MERGE_PARTITIONS = 64
SLICE_BYTES = 1 << 20
MEMORY, SHORT = 1 << 18, 64
PIECES = "key long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, done boolean"
_SCHEMA = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("done", pa.bool_())])


_CUT = re.compile(r"(?<=\S)(?= )|(?<=[0-9A-Za-z])(?=[.,])")  # the rule of cuts
_WHITE, _ALNUM = (np.array([k < 128 and bool(re.match(kind, chr(k))) for k in range(256)]) for kind in (r"\s", r"[0-9A-Za-z]"))
_WIDE = [int.from_bytes(chr(k).encode()) for k in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
JOINED = 256
KEY_LOW, SEEN_BITS = 20, 21


def _after_white(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the characters that end before these places are white space."""
    white = _WHITE[data[at - 1]]
    wide = np.flatnonzero(data[at - 1] >= 128)
    one, two, three = (data[at[wide] - k].astype(np.int64) for k in (1, 2, 3))
    two = two << 8 | one
    white[wide] = np.isin(two, _WIDE[:2]) | np.isin(three << 16 | two, _WIDE[2:])
    return white


def _edges(data: np.ndarray, offsets: np.ndarray, marks: bool) -> np.ndarray:
    """Where the parts of texts begin, and the end: as _CUT says, its second half only if marks."""
    begins = np.zeros(len(data), bool)
    at = np.flatnonzero(data[1:] == 32) + 1
    begins[at[~_after_white(data, at)]] = True
    if marks:
        at = np.flatnonzero((data[1:] == 46) | (data[1:] == 44)) + 1
        begins[at[_ALNUM[data[at - 1]]]] = True
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.append(np.flatnonzero(begins), len(data))


def _bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def parts(text: str) -> list[str]:
    """text cut where no token reaches over: at a blank after a character that is not white space, and at a full stop or comma after an ASCII letter or digit."""
    data, offsets = _bytes([text])
    edges = _edges(data, offsets, True).tolist()
    return [data[lo:hi].tobytes().decode() for lo, hi in zip(edges, edges[1:])] or [text]


def _runs(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places at, at + 1, ... of runs of n places, one run after the other."""
    return np.arange(int(n.sum())) + np.repeat(at - np.cumsum(n) + n, n)


class Encoder:
    """Ids of whole texts. Each distinct part of a slice of texts is encoded once; of short parts the first MEMORY ones that came twice, so the frequent ones, are remembered.

    Parts are told apart by hashes, and each is then compared with the bytes of the one that stands for it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread, as Spark runs a task a core
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary, added = self.tokenizer.get_vocab(), self.tokenizer.get_added_tokens_decoder()
        split = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        # GPT-2's pattern ends a run of letters or digits at a mark
        self.marks = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not any(re.search("[.,]", token.content) for token in added.values())
        self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # of each id: byte-level tokens have a character a byte
        for token, k in vocabulary.items():
            self.bytes[k] = len(added[k].content.encode()) if k in added else len(token)
        # what is remembered: sorted hashes, the last one above all; of each where its bytes and ids are, and how many
        self.keys, self.text, self.ids = np.array([1 << 63], np.uint64), np.zeros(0, np.uint8), np.zeros(0, "<u4")
        self.text_at, self.text_n, self.ids_at, self.ids_n = (np.zeros(1, np.int32) for _ in range(4))
        self.seen = np.zeros(1 << SEEN_BITS, bool)

    @property
    def known(self) -> list[bytes]:
        """The parts that are remembered."""
        return [self.text[at : at + n].tobytes() for at, n in zip(self.text_at[:-1].tolist(), self.text_n[:-1].tolist())]

    def _encoded(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, at, n) of parts from s to e. Parts that begin with a blank and end without are encoded as one text, JOINED at a time, and their ids told apart by the bytes that they stand for."""
        raw = data.tobytes()
        texts = [raw[lo:hi] for lo, hi in zip(s.tolist(), e.tolist())]
        found, at, n, total = [], np.zeros(len(s), np.int64), np.zeros(len(s), np.int64), 0
        fits = (data[s] == 32) & ~_after_white(data, e)
        fit, single = np.flatnonzero(fits), np.flatnonzero(~fits).tolist()
        groups = [fit[k : k + JOINED] for k in range(0, len(fit), JOINED)]
        for group, one in zip(groups, self.tokenizer.encode_batch_fast([b"".join(map(texts.__getitem__, g.tolist())).decode() for g in groups], add_special_tokens=False)):
            ids = np.array(one.ids, "<u4")
            reached, ends = np.cumsum(self.bytes[ids]), np.cumsum((e - s)[group])
            last = np.minimum(np.searchsorted(reached, ends), max(0, len(ids) - 1))
            if not len(ids) or reached[-1] != ends[-1] or (reached[last] != ends).any():
                single += group.tolist()  # as where a normaliser changes the text
                continue
            n[group] = np.diff(last, prepend=-1)
            at[group] = total + last + 1 - n[group]
            found.append(ids)
            total += len(ids)
        for k, one in zip(single, self.tokenizer.encode_batch_fast([texts[k].decode() for k in single], add_special_tokens=False)):
            found.append(np.array(one.ids, "<u4"))
            at[k], n[k] = total, len(found[-1])
            total += len(found[-1])
        return np.concatenate([np.zeros(0, "<u4"), *found]), at, n

    def _slice(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts between edges, and how many each has."""
        s, e = edges[:-1], edges[1:]
        size = e - s
        if len(s) == 1:
            ids, _, n = self._encoded(data, s, e)
            return ids, n
        key = hashes(data, s, e)
        low = np.uint64((1 << KEY_LOW) - 1)
        key = (key & ~low) | np.arange(len(key), dtype=np.uint64)
        key.sort()
        place = (key & low).astype(np.int64)
        key >>= np.uint64(KEY_LOW)
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(fresh)
        of = np.empty(len(key), np.int64)
        of[place] = np.cumsum(fresh) - 1
        times = np.diff(np.append(first, len(key)))
        key, some = key[first], place[first]
        held = np.searchsorted(self.keys, key)
        known = self.keys[held] == key
        new = np.flatnonzero(~known)
        # every part against the one that stands for it: those that only share its hash are encoded singly
        text, at = np.concatenate([self.text, data]), len(self.text)
        model = np.where(known, self.text_at[held], at + s[some])[of]
        same = text.take(np.arange(at, len(text)) + np.repeat(model - at - s, size), mode="clip") == data
        wrong = np.flatnonzero((np.where(known, self.text_n[held], size[some])[of] != size) | ~np.logical_and.reduceat(same, s))
        own = np.concatenate([new, len(key) + np.arange(len(wrong))])
        of[wrong] = own[len(new) :]
        which = np.concatenate([some[new], wrong])
        ids, ids_at, ids_n = self._encoded(data, s[which], e[which])
        starts, counts = (np.concatenate([x[held].astype(np.int64), np.zeros(len(wrong), np.int64)]) for x in (self.ids_at, self.ids_n))
        starts[own], counts[own] = len(self.ids) + ids_at, ids_n
        ids = np.concatenate([self.ids, ids])
        out = ids[_runs(starts[of], counts[of])], counts[of]
        room = MEMORY + 1 - len(self.keys)
        if room > 0:
            spot = key[new] & np.uint64((1 << SEEN_BITS) - 1)
            keep = new[((times[new] > 1) | self.seen[spot]) & (size[some[new]] <= SHORT)][:room]
            self.seen[spot] = True
            self._remember(key[keep], held[keep], data[_runs(s[some[keep]], size[some[keep]])], size[some[keep]], ids[_runs(starts[keep], counts[keep])], counts[keep])
        return out

    def _remember(self, key: np.ndarray, held: np.ndarray, text: np.ndarray, text_n: np.ndarray, ids: np.ndarray, ids_n: np.ndarray) -> None:
        for name, values in (("keys", key), ("text_at", len(self.text) + np.cumsum(text_n) - text_n), ("text_n", text_n), ("ids_at", len(self.ids) + np.cumsum(ids_n) - ids_n), ("ids_n", ids_n)):
            setattr(self, name, np.insert(getattr(self, name), held, values))
        self.text, self.ids = np.concatenate([self.text, text]), np.concatenate([self.ids, ids])

    def encoded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin, and the end."""
        edges = _edges(data, offsets, self.marks)
        found = [self._slice(data[edges[lo] : edges[hi]], edges[lo : hi + 1] - edges[lo]) for lo, hi in slices(edges, SLICE_BYTES)]
        reached = np.cumsum(np.concatenate([[0], *(n for _, n in found)]))
        return np.concatenate([np.zeros(0, "<u4"), *(ids for ids, _ in found)]), reached[np.searchsorted(edges[:-1], offsets)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        ids, at = self.encoded(*_bytes(texts))
        return [ids[lo:hi] for lo, hi in zip(at.tolist(), at[1:].tolist())]


@cache
def encoder(path: str) -> Encoder:
    """One a worker process, whose tasks share what it remembers."""
    return Encoder(path)


class Windows:
    """The open windows of one partition: at most `most`, found by their gap."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.gaps, self.open = size, most, [], {}
        self.born = 0

    def best(self, length: int) -> int | None:
        """The window with the smallest gap that holds `length` tokens."""
        at = bisect_left(self.gaps, (length, -1))
        return self.gaps[at][1] if at < len(self.gaps) else None

    def fullest(self) -> tuple[int, int]:
        return self.gaps[0]

    def add(self, window: int | None, pieces: list[tuple], length: int) -> list[tuple] | None:
        """Put pieces of so many tokens into a window, a new one if None; its pieces if that makes it full."""
        if window is None:
            window, gap = self.born, self.size
            self.born += 1
            self.open[window] = []
        else:
            gap = self.size - sum(p[2] for p in self.open[window])
            self.gaps.remove((gap, window))
        self.open[window] += pieces
        if gap == length:
            return self.open.pop(window)
        insort(self.gaps, (gap - length, window))
        return None

    def close(self, window: int) -> list[tuple]:
        self.gaps = [g for g in self.gaps if g[1] != window]
        return self.open.pop(window)


def _place(windows: Windows, piece: tuple) -> Iterator[list[tuple]]:
    """Place (key, start, length, ids, doc_tokens); yields windows that it makes full or pushes out."""
    key, start, length, ids, total = piece
    while length:
        fit = windows.best(length)
        if fit is not None or len(windows.open) < windows.most:
            if full := windows.add(fit, [(key, start, length, ids, total)], length):
                yield full
            return
        gap, window = windows.fullest()
        if TOP_UP <= gap < length:
            windows.open[window].append((key, start, gap, ids[:gap], total))
            start, length, ids = start + gap, length - gap, ids[gap:]
        yield windows.close(window)


def _rows(window: list[tuple], sequence: int, done: bool) -> list[tuple]:
    out, offset = [], 0
    for key, start, length, ids, total in window:
        out.append((key, start, length, ids.tobytes() if isinstance(ids, np.ndarray) else ids, total, sequence, offset, done))
        offset += length
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def pack(docs: DataFrame, key: str, text: str, tokenizer: str, size: int = 1024, end: int = 0) -> DataFrame:
    """One row a piece: key, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    rows = docs.select(F.spark_partition_id().alias("part"), F.col(key).alias("key"), F.col(text).alias("text"))

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(tokenizer), np.array([end], "<u4")
        windows, sequence, out, held = Windows(size, OPEN_WINDOWS), 0, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sequence = max(sequence, batch.column(0)[0].as_py() << 33)
            data, offsets = utf8(batch.column(2))
            for lo, hi in slices(offsets, SLICE_BYTES):
                found, at = encode.encoded(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for name, begin, stop in zip(batch.column(1)[lo:hi].to_pylist(), at.tolist(), at[1:].tolist()):
                    ids = np.concatenate([found[begin:stop], last])
                    total = len(ids)
                    whole = total // size * size
                    full = [[(name, at, size, ids[at : at + size], total)] for at in range(0, whole, size)]
                    if whole < total:
                        full += _place(windows, (name, whole, total - whole, ids[whole:].copy(), total))
                    for window in full:
                        out += _rows(window, sequence, True)
                        held += size
                        sequence += 1
                    if held >= 1 << 18:
                        yield _batch(out)
                        out, held = [], 0
        for window in windows.open.values():
            out += _rows(window, sequence, False)
            sequence += 1
        yield _batch(out)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, number = Windows(size, OPEN_WINDOWS), None
        held: list[tuple] = []

        def placed(pieces: list[tuple], sequence: int) -> Iterator[list[tuple]]:
            length = sum(p[2] for p in pieces)
            numbers.append(sequence)
            while (fit := windows.best(length)) is None and len(windows.open) >= windows.most:
                yield windows.close(windows.fullest()[1])
            if full := windows.add(fit, pieces, length):
                yield full

        # Each window that came in gives its number back, and no more windows go out than came in.
        numbers: list[int] = []
        for batch in batches:
            for k, start, length, ids, total, sequence, _, _ in zip(*(c.to_pylist() for c in batch.columns)):
                if sequence != number and held:
                    for window in placed(held, number):
                        yield _batch(_rows(window, numbers.pop(), True))
                    held = []
                number = sequence
                held.append((k, start, length, ids, total))
        if held:
            for window in placed(held, number):
                yield _batch(_rows(window, numbers.pop(), True))
        for window in list(windows.open.values()):
            yield _batch(_rows(window, numbers.pop(), True))

    pieces = cut(rows.mapInArrow(online, PIECES))  # both parts below read it
    left = pieces.where(~F.col("done"))
    group = F.shiftright("sequence_id", 33) / MERGE_PARTITIONS
    merged = left.withColumn("g", group.cast("long")).repartition("g").sortWithinPartitions("g", "sequence_id", "offset").drop("g").mapInArrow(merge, PIECES)
    return pieces.where("done").unionByName(merged).drop("done")
