"""N-gram Jaccard join: rare-first prefix filtering, verified once a pair.

A text's set holds its distinct word n-grams (64-bit hashes). Texts with equal
sets are one class, named by 128 bits and represented by its smallest key. Two
classes link when 100 |A & B| >= percent |A | B|.

1.  Bucket counts of all n-grams give one global order, rarest first (equal
    counts by hash); the order steers only the work. A class's prefix is its first
    n - ceil(t n) + 1 n-grams; of two linked classes the smaller shares an n-gram
    within the shorter prefix n - ceil(2 t n / (1 + t)) + 1. Prefix n-grams held by
    one class alone go.
2.  Classes of an n-gram's list that is longer than TILE are first compared with one
    pivot of it, a linear number of pairs, and verified links are contracted to
    components: a huge group of copies is one component from here on.
3.  Lists are cut into tiles. In a tile, pairs of different components must pass
    the length filter, the positional filter (what is left behind both places) and
    the suffix filter (overlap bounded by a SUFFIX_PARTS-way partition of the
    sets, compared part by part). A tile returns a spanning forest of the pairs that
    pass, at most as many rows as it read, never the pairs. The forests' components
    are clusters: both classes of every pair that can still link are in one.
4.  Each cluster's texts are read once, its sets made again and all pairs of
    different components compared exactly. Larger clusters are cut into blocks by
    number and size: first each block alone, then, after contraction, blocks
    of what is outside the cluster's largest component against all its blocks. A
    tile returns a spanning forest of the links.

Long lists and clusters leave out only pairs within one component, so components
are exact whatever a group's size.

Cases: null and empty texts, and texts without a word, have the empty set and
link with nothing; a text of fewer words than n has one n-gram, all its words.
Copies and repeated rows share a class. A key may repeat: its rows share one
vertex. Rows with a null key are a component of their own, null. Texts of any length
are read whole. Extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bucketcounts
from .components import connected_components, forest
from .shared import cut, hot_values, join_hot
from .textbytes import mix, shingle_sets, slices, utf8

SKETCH_BITS = 20
SIEVE_BITS = 22
SUFFIX_PARTS = 64
HEAVY = 1 / 2**14
SALTS = 64
TILE = 2048
TILE_SIZE = 1 << 21
CHUNK = 64
PAIRS = 1 << 17
SLICE_BYTES = 1 << 20


def _ceil(n: np.ndarray | int, up: int, down: int) -> np.ndarray | int:
    return -(-n * up // down)


def _slices(batch: pa.RecordBatch, column: int, n: int) -> Iterator[list[np.ndarray]]:
    """The sets of a batch's texts, a slice of texts at a time."""
    data, offsets = utf8(batch.column(column))
    for lo, hi in slices(offsets, SLICE_BYTES):
        yield list(shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n))


def _sets(batch: pa.RecordBatch, column: int, n: int) -> Iterator[np.ndarray]:
    for sets in _slices(batch, column, n):
        yield from sets


def _joined(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All elements, each one's row, and the rows' sizes."""
    size = np.array([len(x) for x in sets], np.int64)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.repeat(np.arange(len(sets)), size), size


def _classes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set: two sums of mixed elements."""
    every, _, size = _joined(sets)
    edges = np.concatenate([[0], np.cumsum(size)])
    out = []
    for salt in (0, 0xA5A5A5A5DEADBEEF):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(every ^ np.uint64(salt)), dtype=np.uint64)])
        out.append((sums[edges[1:]] - sums[edges[:-1]]).view(np.int64))
    return out[0], out[1]


def survey(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """One pass over the texts: rows (key, size, class, check, parts), and beside them, told apart by kind, segments of the n-gram counts and n-grams that are frequent in a slice."""
    names = ["kind", "key", "size", "class", "check", "parts", "segment", "counts"]
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary())

    def row_batch(m: int, **given: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(m, t)) for c, t in zip(names, types)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            size, one, two, parts, often = [], [], [], [], []
            for sets in _slices(batch, 1, n):
                every, row, k = _joined(sets)
                size.append(k)
                for names_, x in zip((one, two), _classes(sets)):
                    names_.append(x)
                pieces = np.bincount(row * SUFFIX_PARTS + (every >> np.uint64(58)).astype(np.int64), minlength=len(sets) * SUFFIX_PARTS).astype("<i4")
                parts += [r.tobytes() for r in pieces.reshape(-1, SUFFIX_PARTS)]
                np.add.at(table, bucketcounts.bucket(every, SKETCH_BITS), 1)
                gram, count = np.unique(every, return_counts=True)
                frequent = count >= max(8, HEAVY * len(every))
                often.append(np.stack([gram[frequent].view(np.int64), count[frequent]]))
            flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            m = batch.num_rows
            yield row_batch(m, kind=pa.array(np.zeros(m, np.int32)), key=batch.column(0).cast(pa.int64()), size=pa.array(flat(size)), **{"class": pa.array(flat(one)), "check": pa.array(flat(two)), "parts": pa.array(parts, pa.binary())})
            gram, count = np.concatenate(often, axis=1) if often else np.zeros((2, 0), np.int64)
            yield row_batch(len(gram), kind=pa.array(np.full(len(gram), 2, np.int32)), key=pa.array(gram), size=pa.array(count))
        found = list(bucketcounts.blobs(table))
        yield row_batch(len(found), kind=pa.array(np.ones(len(found), np.int32)), segment=pa.array([k for k, _ in found], pa.int32()), counts=pa.array([b for _, b in found], pa.binary()))

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(read, "kind int, key long, size long, class long, check long, parts binary, segment int, counts binary")


def prefixes(docs: DataFrame, key: str, text: str, n: int, percent: int, counts: np.ndarray, heavy: np.ndarray, copied: dict[int, int]) -> DataFrame:
    """(gram, class, size, place, salt) of every prefix n-gram, rarest first.

    heavy n-grams, at most 1 / HEAVY, get a salt by class, others 0. Of the classes in
    `copied` only the row with the key given there is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((np.minimum(counts, 2**32 - 1).astype(np.uint32), np.sort(heavy), np.array(sorted(copied), np.int64), np.array([copied[c] for c in sorted(copied)], np.int64)))

    def among(x: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(ordered, x), max(0, len(ordered) - 1))
        return at, ordered[at] == x if len(ordered) else np.zeros(len(x), bool)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, often, many, reps = shared.value
        for batch in batches:
            key_of, at_row = batch.column(0), 0
            for sets in _slices(batch, 1, n):
                keys = key_of[at_row : at_row + len(sets)]
                at_row += len(sets)
                name = _classes(sets)[0]
                at, hit = among(name, many)
                size = np.array([len(x) for x in sets], np.int64)
                mine = np.asarray(keys.fill_null(0)) == (reps[at] if len(reps) else 0)
                kept = np.where((size > 0) & np.asarray(keys.is_valid()) & (~hit | mine), size - _ceil(size, percent, 100) + 1, 0)
                grams = []
                for x, m in zip(sets, kept.tolist()):
                    if m:
                        grams.append(x[np.argsort(table[bucketcounts.bucket(x, SKETCH_BITS)], kind="stable")[:m]])
                place = np.arange(int(kept.sum())) - np.repeat(np.cumsum(kept) - kept, kept)
                gram = np.concatenate(grams).view(np.int64) if grams else np.zeros(0, np.int64)
                named = np.repeat(name, kept)
                salt = np.where(among(gram, often)[1], 1 + (mix(named.view(np.uint64)) % np.uint64(SALTS)).astype(np.int64), 0)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(named), pa.array(np.repeat(size, kept)), pa.array(place.astype(np.int32)), pa.array(salt.astype(np.int32))], ["gram", "class", "size", "place", "salt"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(read, "gram long, class long, size long, place int, salt int")


def _suffix_filter(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose part-by-part overlap bound still allows a link, from rows (a, b, a_parts, b_parts)."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<i4").reshape(-1, SUFFIX_PARTS) for k in (2, 3))
                most, total = np.minimum(x, y).sum(axis=1, dtype=np.int64), (x + y).sum(axis=1, dtype=np.int64)
                keep = pa.array(100 * most >= percent * (total - most))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return pairs.select("a", "b", "a_parts", "b_parts").mapInArrow(bound, "a long, b long")


def _stars(docs: DataFrame, key: str, text: str, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of keys that link, each b compared with its pivot a on whole sets; a pivot is read once for CHUNK partners."""
    pairs = cut(pairs)
    load = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("partners"))
    chunks = join_hot(pairs, load, "a", hot_values(pairs.select("a"), pairs.count())).select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("partners") / CHUNK)).alias("chunk"))
    asked = chunks.select("a", "chunk", F.col("b").alias("key"), F.lit(1).alias("role")).unionByName(chunks.select("a", "chunk", F.col("a").alias("key"), F.lit(0).alias("role")).distinct())
    asked = cut(asked)
    held = asked.join(_texts(docs, key, text, asked), "key").select("a", "chunk", "role", "key", "text")
    held = held.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role", "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pivots = None, []
        for batch in batches:
            one, two = [], []
            for a, chunk, role, k, s in zip(*(batch.column(c).to_pylist() for c in range(4)), _sets(batch, 4, n)):
                if (a, chunk) != now:
                    now, pivots = (a, chunk), []
                if role == 0:
                    pivots.append(s)  # more than one only if a key repeats with other texts
                    continue
                for pivot in pivots:
                    common = len(pivot) + len(s) - len(np.union1d(pivot, s))
                    if 100 * common >= percent * (len(pivot) + len(s) - common):
                        one.append(a)
                        two.append(k)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["a", "b"])

    return held.mapInArrow(compare, "a long, b long")


def _within(size: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """Whether a place lies in the shorter prefix."""
    return place <= size - _ceil(size, 2 * percent, 100 + percent)


def _may_link(runs: np.ndarray, size: np.ndarray, place: np.ndarray, group: np.ndarray, block: np.ndarray, across: np.ndarray, parts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of one run whose classes may link; rows come ordered by run and size. In runs marked across only pairs of two blocks count."""
    n = len(runs)
    ends = np.searchsorted(runs, runs, "right")
    # within a run sizes ascend, so each row meets the rows behind it up to the length filter's bound
    base = runs << 40
    upto = np.minimum(ends, np.searchsorted(base + size, base + size * 100 // percent, "right"))
    number = np.maximum(0, upto - np.arange(n) - 1)
    one, two, at = [], [], 0
    total = np.concatenate([[0], np.cumsum(number)])
    while at < n:
        stop = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
        m = number[at:stop]
        i = np.repeat(np.arange(at, stop), m)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
        si, sj = size[i], size[j]
        keep = (group[i] != group[j]) & (~across[i] | (block[i] != block[j])) & (_within(si, place[i], percent) | ((si == sj) & _within(sj, place[j], percent)))
        keep &= np.minimum(si - place[i], sj - place[j]) >= _ceil(si + sj, percent, 100 + percent)
        i, j = i[keep], j[keep]
        for k in range(0, len(i), PAIRS):
            a, b = i[k : k + PAIRS], j[k : k + PAIRS]
            most = np.minimum(parts[a], parts[b]).sum(axis=1, dtype=np.int64)
            ok = 100 * most >= percent * (size[a] + size[b] - most)
            one.append(a[ok])
            two.append(b[ok])
        at = stop
    return (np.concatenate(one), np.concatenate(two)) if one else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _edges(names: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """A spanning forest of the links between names[i] and names[j] as rows (a, b)."""
    every, back = np.unique(names, return_inverse=True)
    root = forest(len(every), back[i], back[j])
    linked = np.flatnonzero(root != np.arange(len(every)))
    return pa.RecordBatch.from_arrays([pa.array(every[linked]), pa.array(every[root[linked]])], ["a", "b"])


def _tiled(rows: DataFrame, by: str, name: str, size: Column) -> DataFrame:
    """rows of every `by` that has several groups, with their block and once for each tile (lo, hi) of two blocks that they are in.

    A list within the bounds is one tile of one block. Of a larger one only pairs
    with a row outside its largest group are left to compare: blocks of such
    rows meet each other and the blocks of the largest group. Blocks hold about TILE
    rows and sizes of TILE_SIZE together.
    """
    groups = rows.groupBy(by, "group").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("s"))
    lists = groups.groupBy(by).agg(F.max(F.struct("n", "s", "group")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    blocks = lambda n, s: F.greatest(F.ceil(n / TILE), F.ceil(s / TILE_SIZE), F.lit(1)).cast("int")
    lists = lists.select(by, F.col("top.group").alias("top"), (blocks(F.col("n"), F.col("s")) == 1).alias("whole"), blocks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("outer"), blocks(F.col("top.n"), F.col("top.s")).alias("inner"))
    dealt = rows.join(lists, by)
    outside = F.col("group") != F.col("top")
    draw = F.xxhash64(name, F.lit(7))
    block = F.when(F.col("whole"), 0).when(outside, F.pmod(draw, "outer")).otherwise(F.col("outer") + F.pmod(draw, "inner")).cast("int")
    last = F.when(F.col("whole"), 0).when(outside, F.col("outer") + F.col("inner") - 1).otherwise(F.col("outer") - 1)
    met = dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return met.select(*rows.columns, "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))


def _candidates(entries: DataFrame, percent: int) -> DataFrame:
    """Forest edges (a, b) of the pairs of reps that may link, from rows (gram, lo, hi, block, rep, size, place, group, parts)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(table: pa.Table) -> pa.RecordBatch:
            gram, lo, hi, block, rep, size, place, group = (np.asarray(table.column(k)) for k in range(8))
            parts = np.frombuffer(b"".join(table.column(8).to_pylist()), "<i4").reshape(-1, SUFFIX_PARTS)
            fresh = (gram[1:] != gram[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
            runs = np.concatenate([[0], np.cumsum(fresh)])
            return _edges(rep, *_may_link(runs, size, place, group, block, lo != hi, parts, percent))

        for batch in batches:
            held.append(batch)
            gram, lo, hi = (np.asarray(batch.column(k)) for k in range(3))
            last = np.flatnonzero((gram[1:] != gram[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
            # a run goes on in the next batch: work on all before it
            if len(last):
                k = int(last[-1]) + 1
                yield work(pa.Table.from_batches([*held[:-1], batch.slice(0, k)]))
                held = [batch.slice(k)]
        if held and sum(map(len, held)):
            yield work(pa.Table.from_batches(held))

    tiles = entries.select("gram", "lo", "hi", "block", "rep", "size", "place", "group", "parts")
    # batches end anywhere, also between the batches' runs; a run's rows are ordered by size
    return tiles.repartition("gram", "lo", "hi").sortWithinPartitions("gram", "lo", "hi", "size").mapInArrow(compare, "a long, b long").distinct()


def _texts(docs: DataFrame, key: str, text: str, keys: DataFrame) -> DataFrame:
    """(key, text) of the rows whose key may be among `keys`; a small sieve drops most of the others before any shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bucketcounts.of_longs(keys, "key", SIEVE_BITS) > 0))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            keep = bits[bucketcounts.bucket(np.asarray(batch.column(0).fill_null(0)), SIEVE_BITS)]
            yield batch.filter(pa.array(keep & np.asarray(batch.column(0).is_valid())))

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(sift, "key long, text string")


def _links_in_tile(sets: list[np.ndarray], group: np.ndarray, block: np.ndarray, across: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of different groups that link, compared on whole sets."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    every, row, size = _joined([sets[k] for k in order])
    _, code, count = np.unique(every, return_inverse=True, return_counts=True)
    held = count[code] > 1  # only elements of two sets or more can be common
    code, edges = code[held], np.searchsorted(row[held], np.arange(len(sets) + 1))
    group, block = group[order], block[order]
    upto = np.searchsorted(size, size * 100 // percent, "right")
    flag = np.zeros(len(count), bool)
    one, two = [], []
    for i in range(len(sets)):
        a, b = edges[i + 1], edges[upto[i]]
        other = group[i + 1 : upto[i]] != group[i]
        if across:
            other &= block[i + 1 : upto[i]] != block[i]
        if not other.any():
            continue
        mine = code[edges[i] : edges[i + 1]]
        flag[mine] = True
        hits = np.concatenate([[0], np.cumsum(flag[code[a:b]])])
        common = hits[edges[i + 2 : upto[i] + 1] - a] - hits[edges[i + 1 : upto[i]] - a]
        flag[mine] = False
        j = np.flatnonzero(other & (100 * common >= percent * (size[i] + size[i + 1 : upto[i]] - common)))
        one.append(np.full(len(j), order[i]))
        two.append(order[i + 1 + j])
    return (np.concatenate(one), np.concatenate(two)) if one else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _compared(docs: DataFrame, key: str, text: str, tiles: DataFrame, n: int, percent: int) -> DataFrame:
    """Forest edges (a, b) of the links in tiles, from rows (cluster, lo, hi, block, rep, group)."""
    tiles = cut(tiles.select("cluster", "lo", "hi", "block", "group", F.col("rep").alias("key")))
    held = tiles.join(_texts(docs, key, text, tiles), "key").select("cluster", "lo", "hi", "block", "group", "key", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, sets = None, [], []

        def work() -> pa.RecordBatch:
            name, group, block = (np.array(x, np.int64) for x in zip(*rows))
            return _edges(name, *_links_in_tile(sets, group, block, now[1] != now[2], percent))

        for batch in batches:
            columns = (batch.column(k).to_pylist() for k in range(6))
            for cluster, lo, hi, block, group, k, s in zip(*columns, _sets(batch, 6, n)):
                if (cluster, lo, hi) != now:
                    if rows:
                        yield work()
                    now, rows, sets = (cluster, lo, hi), [], []
                if not rows or rows[-1][0] != k or not np.array_equal(s, sets[-1]):  # a repeated row is read once
                    rows.append((k, group, block))
                    sets.append(s)
        if rows:
            yield work()

    return held.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "key").mapInArrow(compare, "a long, b long")


def join(docs: DataFrame, key: str, text: str, n: int = 4, percent: int = 85) -> DataFrame:
    """(key, size, component) for each row: the set's size and the smallest key reachable by links."""
    found = cut(survey(docs, key, text, n))
    rows = found.where("kind = 0").select("key", "size", "class", "check", "parts")
    named = rows.where("size > 0 and key is not null")
    classes = cut(named.groupBy("class", "check", "size").agg(F.min("key").alias("rep"), F.min("parts").alias("parts"), F.count(F.lit(1)).alias("copies")))
    n_rows, grams = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    counts = bucketcounts.summed(found.where("kind = 1"), SKETCH_BITS)
    # all three lists are short whatever the input: shares of 1 / 2 ** 14 or more
    heavy = [r["key"] for r in found.where("kind = 2").groupBy("key").agg(F.sum("size").alias("n")).where(F.col("n") >= max(2, HEAVY * grams)).select("key").collect()]
    copied = classes.where(F.col("copies") >= max(2, HEAVY * n_rows)).select("class", "check", "rep").collect()

    by_gram = Window.partitionBy("gram", "salt")
    pivot = F.min(F.struct(F.xxhash64("class"), F.col("class").alias("p_class"), F.col("size").alias("p_size"))).over(by_gram)
    entries = prefixes(docs, key, text, n, percent, counts, np.array(heavy, np.int64), {r["class"]: r["rep"] for r in copied})
    entries = entries.withColumns({"pivot": pivot, "hi": F.max("class").over(by_gram), "lo": F.min("class").over(by_gram), "n": F.count(F.lit(1)).over(by_gram)}).where("hi <> lo or salt > 0")
    entries = cut(entries.select("gram", "salt", "class", "size", "place", "n", "pivot.p_class", "pivot.p_size"))

    # long lists, and heavy ones, whose salted parts' pivots meet again: stars around their pivots
    is_long = (F.col("n") > TILE) | (F.col("salt") > 0)
    long = entries.where(is_long)
    tops = long.where("salt > 0").select("gram", "p_class", "p_size").distinct()
    top = tops.groupBy("gram").agg(F.min(F.struct(F.xxhash64("p_class"), "p_class", "p_size")).alias("t"))
    above = tops.join(top, "gram").select(F.col("p_class").alias("class"), F.col("p_size").alias("size"), F.col("t.p_class").alias("p_class"), F.col("t.p_size").alias("p_size"))
    stars = long.select("class", "size", "p_class", "p_size").unionByName(above)
    stars = cut(stars.where((F.col("class") != F.col("p_class")) & (F.least("size", "p_size") * 100 >= F.greatest("size", "p_size") * percent)).distinct())
    first = docs.sparkSession.createDataFrame([], "a long, b long")
    nodes = classes.select("class", "size", "rep", "parts", F.col("rep").alias("group"))
    if number := stars.count():
        pivots = classes.select(F.col("class").alias("p_class"), F.col("size").alias("q_size"), F.col("rep").alias("a"), F.col("parts").alias("a_parts"))
        met = join_hot(stars, pivots, "p_class", hot_values(stars.select("p_class"), number)).where("p_size = q_size").drop("q_size")
        met = met.join(classes.select("class", "size", F.col("rep").alias("b"), F.col("parts").alias("b_parts")), ["class", "size"]).where("a <> b")
        first = cut(_stars(docs, key, text, _suffix_filter(met, percent).distinct(), n, percent))
        joined = connected_components(first, "a", "b")
        nodes = cut(classes.join(joined, classes["rep"] == joined["vertex"], "left").select("class", "size", "rep", "parts", F.coalesce("component", "rep").alias("group")))

    # classes that share a 64-bit name are told apart by their texts; both take part wherever one does
    left = entries.select("gram", "class", "size", "place", is_long.alias("long")).join(nodes, ["class", "size"]).drop("class")
    tiles = left.where(~F.col("long")).drop("long").withColumns({"block": F.lit(0), "lo": F.lit(0), "hi": F.lit(0)})
    if number:
        tiles = tiles.unionByName(_tiled(cut(left.where("long").drop("long")), "gram", "rep", F.lit(0)))
    may = cut(_candidates(tiles, percent))

    clusters = connected_components(may, "a", "b").select(F.col("vertex").alias("rep"), F.col("component").alias("cluster"))
    members = cut(clusters.join(nodes.select("rep", "size", "group"), "rep"))
    spread = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("size") / TILE_SIZE)).cast("int").alias("blocks"))
    alone = members.join(spread, "cluster").withColumn("block", F.pmod(F.xxhash64("rep", F.lit(7)), "blocks").cast("int"))
    links = cut(first.unionByName(_compared(docs, key, text, alone.withColumns({"lo": F.col("block"), "hi": F.col("block")}), n, percent)))
    linked = connected_components(links, "a", "b")
    if spread.where("blocks > 1").take(1):
        now = members.join(spread.where("blocks > 1"), "cluster").join(linked, members["rep"] == linked["vertex"], "left")
        now = cut(now.select("rep", "cluster", "size", F.coalesce("component", "rep").alias("group")))
        linked = connected_components(links.unionByName(_compared(docs, key, text, _tiled(now, "cluster", "rep", F.col("size")), n, percent)), "a", "b")
    reps = cut(classes.join(linked, classes["rep"] == linked["vertex"], "left").select("class", "check", F.coalesce("component", "rep").alias("component")))
    # rows of a class with many copies are marked by broadcast, so that they need not meet in one task
    marked, cold = rows.withColumn("hot", F.lit(None).cast("boolean")), reps
    if copied:
        hot = F.broadcast(docs.sparkSession.createDataFrame([(r["class"], r["check"], True) for r in copied], "class long, check long, hot boolean"))
        marked = rows.join(hot, ["class", "check"], "left")
        warm = marked.where("hot").join(F.broadcast(reps.join(hot.drop("hot"), ["class", "check"])), ["class", "check"], "left")
    answers = marked.where("hot is null").join(cold, ["class", "check"], "left")
    answers = answers.unionByName(warm) if copied else answers
    return answers.select("key", "size", F.when(F.col("key").isNotNull(), F.coalesce("component", "key")).alias("component"))
