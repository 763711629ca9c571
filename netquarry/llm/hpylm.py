"""Language-model scoring by a hierarchical Pitman-Yor model of word triples.

Every pair of context words has a Chinese restaurant whose customers are the words
that follow it in training; its tables are customers of the restaurant of its last
word, whose tables are customers of one parent restaurant of single words, over a
base with a place for every known word and one for all unknown ones. Seatings are
sampled by Gibbs: in turn each dish of a restaurant gets a new number of tables from
its conditional given the other dishes (generalised Stirling numbers, the rising
concentration and the parent's probability). The last two levels lie in one task and
are sampled together, but for frequent context words (below); the parent is summed up over all tasks after a first seating
and again after a sampled one. Predictive probabilities are averaged over SAMPLES
seatings. Discounts are estimated from the counts of counts; concentrations are 1.

All triples of all texts are dealt once, by the last context word, into parts of about
PART_TOKENS tokens; a part holds whole restaurants of both levels, and three passes
(first seating, sampling, scoring) read the same shuffled blocks. Context words with
HOT or more of all tokens would make a part hot: they are dealt by both context
words, so a part has whole restaurants of word pairs, but the restaurant of such a
word reaches over all parts. Its dishes are dealt into buckets by (word, dish): after
a pass each part sends its tables of them, a bucket adds them up and seats them, all
buckets by the same totals of each such word, and sends every part the seats of the
dishes it asked for, which stand through its next pass. A text's first word has one
context only, START: its customers sit in the restaurant of START itself. A token's own
count, which the base score needs, is its count as a context, so one shuffle serves
both scores.

The parent serves words with HEAVY or more of all tokens singly and all other known
words in CLASSES hash classes, equally within a class; its size does not grow with the
corpus. A word not seen in training has the probability of the place for unknown
words, exactly, whatever its class.

Cases: null and empty texts are the end token alone. Without training texts every
probability comes from the base. Repeated rows and keys are scored each; a null key
stays null. Texts of any length are read whole. Dishes with more than ROW customers use
the Stirling numbers' limit, and those expected at more than ROW / 2 tables a normal
approximation. Extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import RDD
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from . import bucketcounts
from .shared import cut, cut_by, drop, of_value
from .textbytes import distinct, mix, slices, utf8, words

HEAVY = 1 / 2**17
HOT = 1 / 4096
CLASS_BITS = 20
CLASSES = 1 << CLASS_BITS
SINGLES = 1 << 18
TABLE_BITS = CLASS_BITS + 1
TOTAL_BITS = 15
PART_TOKENS = 3 << 19
ROW = 128
BURN_IN, SAMPLES = 2, 3
THETA = 1.0
UNKNOWN = 0.5
SLICE_BYTES, SLICE_ROWS = 8 << 20, 1 << 15
UNIT = 2.0**32
"""Logarithms are rounded to whole numbers of 1 / UNIT for each token before they are added up: sums take fewer bytes and are the same in any order."""
START, END = np.uint64(1), np.uint64(2)
_pack = zstandard.ZstdCompressor(level=1)


def _blob(*values: object) -> bytes:
    """values compressed; of arrays of integers byte by byte, as their high bytes are much alike."""
    planes = lambda x: (x.dtype.str, len(x), x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())
    return _pack.compress(pickle.dumps([planes(np.ascontiguousarray(v)) if isinstance(v, np.ndarray) and v.dtype.kind in "iu" else v for v in values], protocol=5))


def _arrays(blob: bytes) -> list:
    back = lambda kind, n, raw: np.frombuffer(raw, np.uint8).reshape(-1, n).T.copy().view(kind).reshape(n) if n else np.zeros(0, kind)
    return [back(*v) if isinstance(v, tuple) else v for v in pickle.loads(zstandard.decompress(bytes(blob)))]


def _sums(rows: np.ndarray, base: np.ndarray, model: np.ndarray, hits: np.ndarray) -> bytes:
    """The sums of a slice's rows, in order of these; those of logarithms are whole numbers."""
    return _blob(np.diff(rows, prepend=rows.dtype.type(0)), base.astype(np.int64), model.astype(np.int64), hits.astype(np.int32))


def _of_sums(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    steps, *sums = _arrays(blob)
    return np.cumsum(steps, dtype=np.int64), *sums


# -- restaurants --------------------------------------------------------------


def stirling(d: float) -> np.ndarray:
    """log S_d(c, t) for c and t up to ROW; row ROW + 1 is the limit for more customers, up to a constant."""
    s = np.full((ROW + 2, ROW + 1), -np.inf)
    s[1, 1] = 0.0
    t = np.arange(ROW + 1)
    for c in range(1, ROW):
        stay = np.log(np.maximum(c - d * t, 1e-300)) + s[c]
        s[c + 1, 1:] = np.logaddexp(stay[1:], s[c, :-1])
    gamma = np.concatenate([[0, 0], np.cumsum(np.log(np.arange(1, ROW)))])  # log (t - 1)!
    s[ROW + 1, 1:] = -gamma[1:] - (t[1:] - 1) * np.log(d)
    return s


def sample_tables(rng: np.random.Generator, s: np.ndarray, d: float, c: np.ndarray, a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Tables of dishes with c customers, given a = concentration + d (other tables) and the parent's probability p."""
    t = np.ones(len(c), np.int64)
    mean = a * p * np.log1p(c / np.maximum(a * p, 1e-300))  # of tables opened at the rate a p against all customers
    many = mean > ROW / 2
    if many.any():
        spread = np.sqrt(np.maximum(mean - a * p * c / (c + a * p), 1.0))
        t[many] = np.clip(np.rint(rng.normal(mean, spread)), 1, c)[many]
    low = 1
    while low < ROW + 1:
        high = min(2 * low, ROW)
        rows = np.flatnonzero(~many & (c > low) & ((c <= high) if high < ROW else True))
        for at in range(0, len(rows), max(1, (1 << 20) // high)):
            pick = rows[at : at + max(1, (1 << 20) // high)]
            steps = np.cumsum(np.log(a[pick, None] + d * np.arange(high)), axis=1)
            odds = s[np.minimum(c[pick], ROW + 1)][:, 1 : high + 1] + np.arange(1, high + 1) * np.log(p[pick])[:, None] + steps
            odds -= np.log(-np.log(rng.random(odds.shape) + 1e-300) + 1e-300)
            t[pick] = odds.argmax(axis=1) + 1
        if high == ROW:
            break
        low = high
    return t


@dataclass
class Parent:
    """What all parts need: single words' codes are their places in heavy, some of them hot contexts; word probabilities by class, and the unknown words'."""

    heavy: np.ndarray
    hot: np.ndarray
    p: np.ndarray
    unknown: float
    discounts: tuple[float, float]
    """of the restaurants of one and of two context words."""
    totals: np.ndarray
    """customers of the hot words' restaurants by their places among these, and from the middle on their tables."""


def classes(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < SINGLES, codes, SINGLES + (codes & np.uint32(CLASSES - 1))).astype(np.int64)


def codes(hashes: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """32-bit names of words: single ones by place, others by hash."""
    # from the first of its leading bits a word's place is a step or two away, which takes less time than a search
    first = np.searchsorted(heavy, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46)).astype(np.int32)
    slot = (hashes >> np.uint64(46)).astype(np.int32)
    at = np.minimum(first[slot], len(heavy) - 1)
    for _ in range(int(np.diff(np.append(first, len(heavy))).max()) - 1):
        at += (heavy[at] < hashes) & (at < len(heavy) - 1)
    return np.where(heavy[at] == hashes, at, SINGLES + (hashes >> np.uint64(33))).astype(np.uint32)


def parent_of(heavy: np.ndarray, tables: np.ndarray, sizes: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """A word's probability by class, and an unknown word's, from the summed tables of all context restaurants and the number of known words by class."""
    d = 0.5
    m = tables[: SINGLES + CLASSES].astype(float)
    units = sizes[: len(m)].astype(float)
    units[1 : len(heavy)] = 1  # START, at 0, is no word
    base = (1 - UNKNOWN) * units / max(1.0, units.sum())
    own = np.where(m > 0, 1, 0)
    hit = np.flatnonzero((m > 1) & (base > 0))
    rng, s = np.random.default_rng(seed), stirling(d)
    for _ in range(3):
        other = own.sum() - own[hit]
        own[hit] = sample_tables(rng, s, d, m[hit].astype(np.int64), THETA + d * other, base[hit])
    rest = (THETA + d * own.sum()) / (THETA + m.sum())
    p = (m - d * own) / (THETA + m.sum()) + rest * base
    unknown = rest * UNKNOWN if m.sum() else 1.0
    return np.where(units > 0, p / np.maximum(units, 1), unknown), unknown


# -- dealing pairs -------------------------------------------------------------


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about SLICE_BYTES, so that short texts make no more slices, and so no more blocks, than long ones."""
    held, size, rows = [], 0, 0
    for batch in batches:
        held.append(batch)
        size, rows = size + batch.nbytes, rows + batch.num_rows
        del batch
        if size >= SLICE_BYTES or rows >= SLICE_ROWS:
            # nothing is held here while a batch is worked on
            yield held.pop() if len(held) == 1 else _one(held)
            size, rows = 0, 0
    if rows:
        yield _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One batch of the rows of all, which are let go."""
    table = pa.Table.from_batches(held)
    held.clear()
    columns = [c.combine_chunks() for c in table.columns]
    return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], names=table.column_names)


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for lo, hi in slices(offsets, SLICE_BYTES):
        for at in range(lo, hi, SLICE_ROWS):
            yield at, min(hi, at + SLICE_ROWS)


def heavy_words(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of all words with HEAVY or more of the tokens, sorted, with START and END; which of them have HOT or more; and the number of tokens.

    A word with that share has it in some slice, so slices report only such words;
    fewer than 2 / HEAVY can pass the final test.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            found, n, total = [], [], 0
            for lo, hi in _slices(offsets):
                h = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])[2]
                h.sort()
                starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                c = np.diff(np.append(starts, len(h)))
                keep = c >= HEAVY * (len(h) + hi - lo)
                found.append(h[starts[keep]].astype(np.int64))
                n.append(c[keep])
                total += len(h) + hi - lo
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[0], *found]).astype(np.int64)), pa.array(np.concatenate([[total], *n]).astype(np.int64))], ["word", "n"])

    sums = rows.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = sums.where("word = 0").agg(F.sum("n")).first()[0] or 0
    found = sums.where((F.col("word") != 0) & (F.col("n") >= HEAVY / 2 * max(1, total))).toPandas()
    often = {int(w): int(n) for w, n in zip(found["word"], found["n"])}
    heavy = np.unique(np.concatenate([[START, END], np.array(list(often), np.int64).view(np.uint64)]))
    hot = np.array([often.get(int(h), 0) >= HOT / 2 * total for h in heavy.view(np.int64)])
    hot[:2] = True
    return heavy, hot, total


def deal(rows: DataFrame, heavy: np.ndarray, hot_words: np.ndarray, parts: int) -> DataFrame:
    """(part, slice, data): the triples of one slice of texts for one part; and with part -1 - n the slice's keys."""
    bits = np.uint64(64 - (parts.bit_length() - 1))
    END_CODE, START_CODE = np.searchsorted(heavy, END), np.searchsorted(heavy, START)
    assert (END_CODE, START_CODE) == (1, 0)

    def sliced(row: int, lo: int, hi: int, key: pa.Array, train: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """The blocks of rows lo to hi. Arrays are let go once used: they are most of a worker's memory."""
        h, first = words(data, offsets)[2:]
        count = np.diff(first)
        at = first[:-1] + np.arange(hi - lo)  # where each text's START goes
        inner = np.ones(len(h) + hi - lo, bool)
        inner[at] = False
        context = np.empty(len(inner), np.uint64)
        context[at], context[inner] = START, h
        code = codes(h, heavy)
        del h
        word = np.full(len(context), np.uint32(1))
        word[np.flatnonzero(inner) - 1] = code
        own = np.zeros(len(context), np.uint32)
        own[inner] = code
        del code, inner
        before = np.concatenate([[np.uint32(0)], own[:-1]])  # START, 0, before a text's first word
        before[at] = 0
        hot = own < len(hot_words)
        hot[hot] = hot_words[own[hot]]
        del own
        spread = mix(context)
        spread[hot] = mix(context[hot] * np.uint64(0x9E3779B1) + before[hot])
        spread[at] = mix(np.arange(lo, hi, dtype=np.uint64) + (np.uint64(row) << np.uint64(20)))
        del hot, at
        # by part and then context, so that a part names each context once; places ride in the low bits through
        # a plain sort, several times as fast as argsort; contexts alike in the high bits may take turns
        low = np.uint64(max(1, len(spread).bit_length()))
        spread >>= bits
        spread <<= bits
        spread |= context >> (np.uint64(64) - bits)
        spread >>= low
        spread <<= low
        spread |= np.arange(len(spread), dtype=np.uint64)
        spread.sort()
        edges = np.searchsorted(spread, np.arange(parts, dtype=np.uint64) << bits).tolist() + [len(spread)]
        spread &= (np.uint64(1) << low) - np.uint64(1)
        order = spread.view(np.int64)
        context, word, before = context[order], word[order], before[order]
        doc = np.repeat(np.arange(hi - lo, dtype=np.uint16) | train.astype(np.uint16) << np.uint16(15), count + 1)[order]
        del spread, order
        out = [(-1 - row % parts, row, _blob(key.to_pylist(), count.astype(np.int32) + 1))]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            if a < b:
                u, fresh = context[a:b], np.flatnonzero(np.concatenate([[True], context[a + 1 : b] != context[a : b - 1]]))
                out.append((k, row, _blob(u[fresh], np.diff(np.append(fresh, b - a)).astype(np.uint32), word[a:b], doc[a:b], before[a:b])))
        return out

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _joined(batches):
            row, key, train = np.asarray(batch.column(0)), batch.column(1), np.asarray(batch.column(3))
            data, offsets = utf8(batch.column(2))
            for lo, hi in _slices(offsets):
                out = sliced(int(row[lo]), lo, hi, key.slice(lo, hi - lo), train[lo:hi], data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], ["part", "slice", "data"])

    return rows.mapInArrow(pairs, "part long, slice long, data binary")


# -- passes over parts ---------------------------------------------------------


class Part:
    """All triples of one part. Triples: one entry a distinct (context word, word, word before); dishes: one a distinct (context word, word)."""

    def __init__(self, blobs: list[tuple[int, bytes]], heavy: np.ndarray, hot: np.ndarray):
        self.slices = [s for s, _ in blobs]
        fields = []
        for k, (_, blob) in enumerate(blobs):
            fields.append(_arrays(blob))
            blobs[k] = None  # the compressed block is not needed beside its arrays
        contexts, back = distinct(np.concatenate([f[0] for f in fields]))
        run = np.concatenate([f[1] for f in fields])
        word, doc, before = (np.concatenate([f[k] for f in fields]) for k in (2, 3, 4))
        self.contexts, self.lengths = contexts, [len(f[3]) for f in fields]
        del fields
        # two sorts of single 64-bit keys, which numpy does several times as fast as one of two keys; in place, as a part's arrays are most of a worker's memory
        pair = np.repeat(back.astype(np.uint64) << np.uint64(32), run)
        del back, run
        pair |= word
        del word
        order = np.argsort(pair)
        pair = pair[order]
        new_pair = np.concatenate([[True], pair[1:] != pair[:-1]])
        triple = np.cumsum(new_pair, dtype=np.uint64)
        triple -= np.uint64(1)
        triple <<= np.uint64(32)
        triple |= before[order]
        del before
        then = np.argsort(triple)  # moves rows within their pair only
        order = order[then].astype(np.uint32)
        triple = triple[then]
        del then
        before = (triple & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        self.order, self.docs = order, doc
        train = (doc[order] >> 15).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], triple[1:] != triple[:-1]]))
        self.size = np.diff(np.append(starts, len(pair)))
        self.c = np.add.reduceat(train, starts)
        self.dish = np.cumsum(new_pair)[starts] - 1
        u = (pair[starts] >> np.uint64(32)).astype(np.int64)
        self.u = u
        self.before = before[starts]
        first = np.flatnonzero(new_pair)
        self.dish_u = (pair[first] >> np.uint64(32)).astype(np.int64)
        self.w = (pair[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        self.dish_starts = np.flatnonzero(np.concatenate([[True], self.dish[1:] != self.dish[:-1]]))
        self.u_starts = np.flatnonzero(np.concatenate([[True], self.dish_u[1:] != self.dish_u[:-1]]))
        self.u_sizes = np.diff(np.append(self.u_starts, len(self.dish_u)))
        self.customers = np.bincount(u, self.c, len(contexts)).astype(np.int64)
        at = np.minimum(np.searchsorted(heavy, contexts), len(heavy) - 1)
        self.hot = np.where((heavy[at] == contexts) & hot[at], at, -1)
        self.at_start = self.hot[u] == 0

    @cached_property
    def room(self) -> np.ndarray:
        """The restaurant of both context words, by triple."""
        return distinct(mix(self.u.astype(np.uint64) << np.uint64(32) | self.before))[1]

    @cached_property
    def doc(self) -> np.ndarray:
        """Slice and row of every token, in the order of triples."""
        nth = np.repeat(np.arange(len(self.lengths)), self.lengths)
        return (nth[self.order] << 15) | (self.docs[self.order] & 0x7FFF)

    def opened(self) -> np.ndarray:
        """Customers of the dishes when every triple has one table."""
        return np.bincount(self.dish, np.where(self.at_start, self.c, np.minimum(self.c, 1)), len(self.w)).astype(np.int64)

    @cached_property
    def shared(self) -> np.ndarray:
        """Which dishes are of hot words, so of restaurants over all parts."""
        return self.hot[self.dish_u] >= 0

    def asked(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The shared dishes by bucket, their names, and where each bucket begins."""
        dishes = np.flatnonzero(self.shared)
        names = self.hot[self.dish_u[dishes]].astype(np.uint64) << np.uint64(32) | self.w[dishes]
        bucket = (mix(names) >> np.uint64(65 - parts.bit_length())).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return dishes[order], names[order], np.searchsorted(bucket[order], np.arange(parts + 1))

    def seated(self, parent: Parent, answers: dict[int, bytes], parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The shared dishes and their probabilities by the seats that the buckets sent."""
        dishes, names, edges = self.asked(parts)
        c, t = np.zeros(len(dishes)), np.zeros(len(dishes))
        for k in np.flatnonzero(np.diff(edges)):
            c[edges[k] : edges[k + 1]], t[edges[k] : edges[k + 1]] = _arrays(answers[k])
        d, of = parent.discounts[0], np.searchsorted(np.flatnonzero(parent.hot), (names >> np.uint64(32)).astype(np.int64))
        guests, tables = np.split(parent.totals, 2)
        return dishes, (c - d * t + (THETA + d * tables[of]) * parent.p[classes(self.w[dishes])]) / (THETA + guests[of])

    def seatings(self, parent: Parent, answers: dict[int, bytes], parts: int, rounds: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, Callable[[], np.ndarray]]]:
        """Gibbs rounds over both levels: (tables and customers of each dish, probability of each triple's word, found when called). Shared dishes have no tables here."""
        (d2, d3), rng = parent.discounts, np.random.default_rng(seed)
        shared, p_shared = self.seated(parent, answers, parts)
        s2, s3 = stirling(d2), stirling(d3)
        p1 = parent.p[classes(self.w)]
        by_u = lambda x: np.repeat(np.add.reduceat(x, self.u_starts), self.u_sizes)
        sums = lambda of, x, k: np.bincount(of, x, k).astype(np.int64)
        rooms = int(self.room.max()) + 1 if len(self.room) else 0
        guests = sums(self.room, self.c, rooms)
        t3, c2 = np.where(self.at_start, self.c, np.minimum(self.c, 1)), self.opened()
        t2 = np.where(self.shared, 0, np.minimum(c2, 1))
        more = np.flatnonzero((self.c > 1) & ~self.at_start)
        side = rng.random(len(more)) < 0.5

        def p_dish() -> np.ndarray:
            p2 = (c2 - d2 * t2 + (THETA + d2 * by_u(t2)) * p1) / (THETA + by_u(c2))
            p2[shared] = p_shared
            return p2

        def p_triple() -> np.ndarray:
            p2 = p_dish()[self.dish]
            p3 = (self.c - d3 * t3 + (THETA + d3 * sums(self.room, t3, rooms)[self.room]) * p2) / (THETA + guests[self.room])
            return np.where(self.at_start, p2, p3)

        halves = more[side], more[~side]
        for _ in range(rounds):
            p2 = p_dish()
            for rows in halves:
                a = THETA + d3 * (sums(self.room, t3, rooms)[self.room[rows]] - t3[rows])
                t3[rows] = sample_tables(rng, s3, d3, self.c[rows], a, p2[self.dish[rows]])
            c2 = np.add.reduceat(t3, self.dish_starts)
            t2 = np.where(self.shared, 0, np.clip(t2, np.minimum(c2, 1), c2))
            some = np.flatnonzero((c2 > 1) & ~self.shared)
            half = rng.random(len(some)) < 0.5
            for rows in (some[half], some[~half]):
                a = THETA + d2 * (by_u(t2)[rows] - t2[rows])
                t2[rows] = sample_tables(rng, s2, d2, c2[rows], a, p1[rows])
            yield t2, c2, p_triple


def _parts(rows: Iterator[Row], answers: str | None) -> Iterator[tuple[int, list, dict[int, bytes]]]:
    """The blocks of a partition by part, in a fixed order, and the answers to it by bucket, from the shared folder."""
    held: dict[int, list] = defaultdict(list)
    for r in rows:
        held[r["part"]].append((r["slice"], r["data"]))
    for part in sorted(held):
        told = {} if answers is None or part < 0 else {r["other"]: r["counts"] for r in of_value(answers, "segment", part)}
        yield part, sorted(held.pop(part)), told


COUNTS = "kind string, segment int, other int, counts binary"


def _totals(heavy: np.ndarray, hot_words: np.ndarray, parts: int, work: Callable[[int, Part, dict], tuple[np.ndarray, np.ndarray]], answers: str | None) -> Callable[[Iterator[Row]], Iterator[tuple]]:
    """Rows (kind, segment, other, counts) that sum up a pass: tables by class; for each bucket the part's customers of shared dishes; and of the first pass the names of these, known words by class, customers of hot contexts, and counts of counts."""

    first = answers is None

    def read(rows: Iterator[Row]) -> Iterator[tuple]:
        tables, known = np.zeros(1 << TABLE_BITS, np.int64), np.zeros(1 << TABLE_BITS, np.int64)
        hot: dict[int, int] = defaultdict(int)
        seen = np.zeros(6, np.int64)
        for part, blobs, told in _parts(rows, answers):
            if part < 0:
                continue
            p = Part(blobs, heavy, hot_words)
            t, guests = work(part, p, told)
            tables += np.bincount(classes(p.w), t, len(tables)).astype(np.int64)
            dishes, names, edges = p.asked(parts)
            for k in np.flatnonzero(np.diff(edges)):
                of = slice(edges[k], edges[k + 1])
                yield "asked", int(k), part, _blob(*(names[of],) * first, guests[dishes[of]].astype(np.uint64))
            if not first:
                continue
            words_ = p.contexts[(p.hot < 0) & (p.customers > 0)]
            known += np.bincount(classes(codes(words_, heavy)), minlength=len(known))
            for k in np.flatnonzero(p.hot >= 0):
                hot[int(p.hot[k])] += int(p.customers[k])
            seen += (int(p.c.sum()), len(words_), *(int((x == n).sum()) for x in (guests[~p.shared], p.c[~p.at_start]) for n in (1, 2)))
        for kind, table in (("tables", tables), ("known", known)):
            for k, blob in bucketcounts.blobs(table):
                yield kind, k, 0, blob
        if first:
            yield "rest", 0, 0, _blob(dict(hot), seen)

    return read


def _seats(hot_words: np.ndarray, parent: Callable[[], Parent | None], rounds: list[np.ndarray], seed: int, answer: bool) -> Callable[[Iterator[Row]], Iterator[tuple]]:
    """Seats the shared dishes of a bucket: at first a table a dish, then a round for each of rounds, the totals of all buckets before it.

    Rows as COUNTS: totals (customers and tables by hot word; last of either half, dishes with one and with two customers); to answer, also tables by class and each part's seats.
    """
    hots = np.flatnonzero(hot_words)
    half = 1 << (TOTAL_BITS - 1)
    assert len(hots) < half

    def read(rows: Iterator[Row]) -> Iterator[tuple]:
        buckets: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(lambda: [None, None]))
        for r in rows:
            *named, guests = _arrays(r["counts"])
            own = buckets[r["segment"]][r["other"]]
            if named:
                own[0] = named[0]
            if not named or own[1] is None:  # of the later pass, which sends no names, if there are two
                own[1] = guests
        totals, tables = np.zeros(2 * half, np.int64), np.zeros(1 << TABLE_BITS, np.int64)  # the latter touched for answers only
        for bucket in sorted(buckets):
            asked = buckets.pop(bucket)
            order = sorted(asked)
            named, guests = zip(*(asked[part] for part in order))
            names, back = np.unique(np.concatenate(named), return_inverse=True)
            c = np.bincount(back, np.concatenate(guests), len(names)).astype(np.int64)
            of = np.searchsorted(hots, (names >> np.uint64(32)).astype(np.int64))
            kinds = classes((names & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            t, some, rng = np.minimum(c, 1), np.flatnonzero(c > 1), np.random.default_rng((seed, bucket))
            for before in rounds:
                d = parent().discounts[0]
                t[some] = sample_tables(rng, stirling(d), d, c[some], THETA + d * (before[half + of[some]] - t[some]), parent().p[kinds[some]])
            totals += np.bincount(of, c, 2 * half).astype(np.int64) + np.bincount(half + of, t, 2 * half).astype(np.int64)
            totals[[half - 1, -1]] += ((c == 1).sum(), (c == 2).sum())
            if not answer:
                continue
            np.add.at(tables, kinds, t)
            at = 0
            for part, own in zip(order, named):
                pick = back[at : at + len(own)]
                yield "answer", part, bucket, _blob(c[pick].astype(np.uint64), t[pick].astype(np.uint64))
                at += len(own)
        for kind, table in (("totals", totals), ("tables", tables))[: 1 + answer]:
            for k, blob in bucketcounts.blobs(table):
                yield kind, k, 0, blob

    return read


def score(docs: DataFrame, key: str, text: str, train: Column, seed: int = 5) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) for each row; train marks the rows learned from."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    heavy, hot_words, total = heavy_words(rows)
    parts = 1 << max(1, int(total // PART_TOKENS).bit_length())
    # An RDD, so that the passes below share the blocks of one shuffle without another copy of them on disk.
    dealt = deal(rows, heavy, hot_words, parts).repartitionById(parts, F.pmod("part", F.lit(parts)).cast("int")).rdd

    made: list[str] = []  # folders that hold what the passes tell each other

    def summed(found: DataFrame, kind: str, bits: int = TABLE_BITS) -> np.ndarray:
        return bucketcounts.summed(found.where(F.col("kind") == kind), bits)

    def passed(work: Callable[[int, Part, dict], tuple[np.ndarray, np.ndarray]], answers: str | None) -> DataFrame:
        return cut(spark.createDataFrame(dealt.mapPartitions(_totals(heavy, hot_words, parts, work, answers)), COUNTS), made)

    def of_buckets(found: DataFrame) -> RDD:
        return found.where("kind = 'asked'").select("segment", "other", "counts").repartitionById(parts, F.col("segment")).rdd

    def seated(asked: RDD, parent: Callable[[], Parent | None], rounds: list[np.ndarray], more: int) -> tuple[str, np.ndarray, DataFrame]:
        """The folder of the shared dishes' answers, totals and all rows of COUNTS after rounds and as many more, each of which goes by all buckets' totals of the round before."""
        seats = lambda answer: spark.createDataFrame(asked.mapPartitions(_seats(hot_words, parent, rounds, seed, answer)), COUNTS)
        for _ in range(more):
            rounds = [*rounds, summed(seats(False), "totals", TOTAL_BITS)]
        out = cut(seats(True), made)
        answers = out.where("kind = 'answer'").select("segment", "other", "counts").repartitionById(parts, F.col("segment"))
        made.append(cut_by(answers, "segment"))
        return made[-1], summed(out, "totals", TOTAL_BITS), out

    def opened(part: int, p: Part, _: dict) -> tuple[np.ndarray, np.ndarray]:
        guests = p.opened()
        return np.where(p.shared, 0, np.minimum(guests, 1)), guests

    found = passed(opened, None)
    answers, shared, seats = seated(of_buckets(found), lambda: None, [], 0)
    tables, known = summed(found.unionByName(seats), "tables"), summed(found, "known")
    hot, seen = defaultdict(int), np.zeros(6, np.int64)
    for r in found.where("kind = 'rest'").select("counts").collect():
        counts, rest = _arrays(r["counts"])
        for k, v in counts.items():
            hot[k] += v
        seen += rest
    seen[2:4] += shared[[len(shared) // 2 - 1, -1]]
    tokens = int(seen[0])
    discounts = tuple(min(0.95, max(0.1, once / (once + 2 * twice))) if once and twice else 0.75 for once, twice in ((float(seen[2]), float(seen[3])), (float(seen[4]), float(seen[5]))))
    vocabulary = int(seen[1]) + sum(1 for k, v in hot.items() if k > 1 and v > 0) + (tokens > 0)
    first = spark.sparkContext.broadcast(Parent(heavy, hot_words, *parent_of(heavy, tables, known, seed), discounts, shared))

    def sampled(part: int, p: Part, told: dict) -> tuple[np.ndarray, np.ndarray]:
        for t, guests, _ in p.seatings(first.value, told, parts, BURN_IN + 1, seed + part):
            pass
        return t, guests

    named, found = found, passed(sampled, answers)
    answers, shared, seats = seated(of_buckets(named.unionByName(found)), lambda: first.value, [shared], BURN_IN - 1)
    final = spark.sparkContext.broadcast(Parent(heavy, hot_words, *parent_of(heavy, summed(found.unionByName(seats), "tables"), known, seed + 1), discounts, shared))
    for path in made:
        if path != answers:  # the last pass reads these only
            drop(spark, path)
    ends = int(hot.get(0, 0))  # customers of START: training texts, each with one end token

    def partial(rows: Iterator[Row]) -> Iterator[tuple]:
        sums: dict[int, list] = defaultdict(list)  # by slice, added up over the partition's parts before they are shuffled
        parent = final.value
        for part, blobs, told in _parts(rows, answers):
            if part < 0:
                for slice_, blob in blobs:
                    yield slice_, True, bytes(blob)
                continue
            p = Part(blobs, heavy, hot_words)
            mean = np.zeros(len(p.c))
            for turn, (_, _, q) in enumerate(p.seatings(parent, told, parts, BURN_IN + SAMPLES, seed + parts + part)):
                if turn >= BURN_IN:
                    mean += q() / SAMPLES
            count = p.customers.copy()
            for k in np.flatnonzero(p.hot >= 0):
                count[k] = hot[int(p.hot[k])]
            # a word that is unknown, as its row as a context shows, was rated by its class above: here that is put right
            mend = np.where(count > 0, 0.0, np.log10(parent.unknown) - np.log10(parent.p[classes(codes(p.contexts, heavy))]))
            mend[p.hot == 0] = 0.0
            count[p.hot == 0] = ends
            log_count = np.rint(np.log10(count + 1.0) * UNIT)[p.u]
            some, back = distinct(p.doc.view(np.uint64))
            of = lambda x: np.bincount(back, np.repeat(x, p.size), len(some))
            fields = [(some & np.uint64(0x7FFF)).astype(np.uint16), of(log_count), of(np.rint((np.log10(mean) + mend[p.u]) * UNIT)), of((count[p.u] > 0).astype(float)).astype(np.int32)]
            edges = np.searchsorted(some, np.arange(len(p.slices) + 1, dtype=np.uint64) << np.uint64(15))
            for k, slice_ in enumerate(p.slices):
                sums[slice_].append([x[edges[k] : edges[k + 1]] for x in fields])
        for slice_, pieces in sums.items():
            rows_, *logs = (np.concatenate(x) for x in zip(*pieces))
            if len(pieces) > 1:
                rows_, back = np.unique(rows_, return_inverse=True)
                logs = [np.bincount(back, x) for x in logs]
            yield slice_, False, _sums(rows_, *logs)

    got = spark.createDataFrame(dealt.mapPartitions(partial), "slice long, head boolean, data binary")

    def gather(table: pa.Table) -> pa.Table:
        keys, tokens_of = next(_arrays(d.as_py()) for h, d in zip(table["head"], table["data"]) if h.as_py())
        base, model, hits = np.zeros(len(keys)), np.zeros(len(keys)), np.zeros(len(keys), np.int64)
        for h, d in zip(table["head"], table["data"]):
            if not h.as_py():
                at, b, m, k = _of_sums(d.as_py())
                base[at] += b
                model[at] += m
                hits[at] += k
        base, model = base / UNIT - tokens_of * np.log10(tokens + vocabulary + 1.0), model / UNIT
        return pa.table([pa.array(keys, pa.int64()), pa.array(tokens_of.astype(np.int64)), pa.array(hits), pa.array(base), pa.array(model)], ["key", "n_tokens", "n_known", "base_score", "score"])

    out = got.groupBy("slice").applyInArrow(gather, "key long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(tokens).cast("long"))
