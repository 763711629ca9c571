"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's bag holds the hashed character n-grams (3 to 5 bytes) of `<word>`, so a
misspelling or a new ending shares most of its vectors with the words seen in
training. A passage's embedding is the mean of its n-gram vectors and a linear
softmax gives its two class probabilities; embeddings and softmax are trained
jointly in numpy. A document is read as passages of PASSAGE words that cover its
whole text, and its score is the highest passage probability of the toxic
class, so length does not dilute a toxic remark. In training, the passage with
the highest score stands for its document, toxic or not.

Because the softmax is linear in the mean, each n-gram bucket adds one number
(vector x weight difference); tasks carry that table of BUCKETS floats.

Cases: null and empty texts, and texts without a word, get the score of an empty
bag (the softmax bias). Without both classes in training every score is 0.
Memory is bounded by slices of a batch. Rows are scored alone, ties and repeated
rows included; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import mix, slices, utf8, words

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
PASSAGE = 8
SLICE_BYTES = 1 << 18

_PASSAGES = re.compile(r"(?:[^\x20\t-\r]{1,64}[\x20\t-\r]*){1,%d}" % PASSAGE)
_SPACES = re.compile(r"[\x20\t-\r]+")
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)


@dataclass
class SubwordSoftmax:
    """worth: (BUCKETS,) log-odds that one n-gram of a bag adds; bias: log-odds of an empty bag."""

    worth: np.ndarray
    bias: float


def bags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, passage, row): n-gram buckets with their passage, and each passage's row."""
    start, end, _, first = words(data, offsets)
    count = np.diff(first)
    parts = -(-count // PASSAGE)
    row = np.repeat(np.arange(len(count)), parts)
    base = np.cumsum(parts) - parts
    nth = np.arange(len(start)) - np.repeat(first[:-1], count)
    passage_of_word = np.repeat(base, count) + nth * np.repeat(parts, count) // np.repeat(count, count)  # of even sizes
    # one buffer in which every word stands as <word>
    size = end - start + 2
    at = np.cumsum(size) - size
    total = int(size.sum())
    word = np.repeat(np.arange(len(start)), size)
    place = np.arange(total) - at[word]
    source = start[word] + place - 1
    letters = _LOWER[data[np.clip(source, 0, max(0, len(data) - 1))]] if total else np.zeros(0, np.uint64)
    letters[at] = 60
    letters[at + size - 1] = 62
    left = size[word] - place
    buckets, of = [], []
    rolling = letters.copy()
    for n in range(2, max(GRAMS) + 1):
        if total < n:
            break
        rolling = rolling[:-1] * np.uint64(0x100000001B3) ^ letters[n - 1 :]
        if n in GRAMS:
            ok = np.flatnonzero(left[: len(rolling)] >= n)
            buckets.append((mix(rolling[ok] + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int32))
            of.append(passage_of_word[word[ok]])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), row
    return np.concatenate(buckets), np.concatenate(of), row


def _passages(model: SubwordSoftmax, bucket: np.ndarray, passage: np.ndarray, n: int) -> np.ndarray:
    sums = np.bincount(passage, model.worth[bucket], n)
    return sums / np.maximum(1, np.bincount(passage, minlength=n)) + model.bias


def train(texts: list[str], labels: list[int], dim: int = 8, epochs: int = 120, rate: float = 0.05, decay: float = 1e-6, seed: int = 11) -> SubwordSoftmax | None:
    """Joint training of embeddings and softmax by Adam over whole documents; None if a class is missing."""
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2:
        return None
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    pieces, rows = [], []
    for lo, hi in slices(offsets, SLICE_BYTES):
        b, p, r = bags(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        pieces.append((b, (p + sum(map(len, rows))).astype(np.int32)))
        rows.append(r + lo)
    row = np.concatenate(rows)
    size = np.maximum(1, sum(np.bincount(p, minlength=len(row)) for _, p in pieces))
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, dim))
    weight = rng.normal(0, 0.5, dim)
    bias = -2.0
    state = [np.zeros_like(table), np.zeros_like(table), np.zeros(dim), np.zeros(dim), 0.0, 0.0]
    docs, begin = np.unique(row, return_index=True)
    each = np.diff(np.append(begin, len(row)))
    share = np.where(y[docs] == 1, 0.5 / max(1, (y[docs] == 1).sum()), 0.5 / max(1, (y[docs] == 0).sum()))
    for step in range(1, epochs + 1):
        # the softmax is linear in a bag's mean, so each n-gram needs only its own log-odds
        worth = table @ weight
        odds = sum(np.bincount(p, worth[b], len(row)) for b, p in pieces) / size + bias
        sharp = 0.5 if step <= epochs // 10 else 4.0  # first all passages of a document take part, then the strongest
        soft = np.exp(sharp * (odds - np.repeat(np.maximum.reduceat(odds, begin), each)))
        soft /= np.repeat(np.add.reduceat(soft, begin), each)
        pooled = np.add.reduceat(soft * odds, begin)
        error = (1 / (1 + np.exp(-np.clip(pooled, -500, 500))) - y[docs]) * share
        d_odds = soft * np.repeat(error, each)
        g_bias = float(d_odds.sum())
        part = d_odds / size
        gathered = sum(np.bincount(b, part[p], BUCKETS) for b, p in pieces)
        g_weight = table.T @ gathered
        g_table = gathered[:, None] * weight[None, :] + decay * table
        for k, (p, g) in enumerate(((table, g_table), (weight, g_weight))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-7)
        state[4] += 0.1 * (g_bias - state[4])
        state[5] += 0.02 * (g_bias * g_bias - state[5])
        bias -= rate * (state[4] / (1 - 0.9**step)) / (np.sqrt(state[5] / (1 - 0.98**step)) + 1e-7)
    seen = sum(np.bincount(b, minlength=BUCKETS) for b, _ in pieces) > 0
    return SubwordSoftmax(np.where(seen, table @ weight, 0).astype(np.float32), bias)


def _scores(texts: pa.Array, model: SubwordSoftmax | None) -> tuple[np.ndarray, np.ndarray]:
    """Scores and numbers of passages of whole texts."""
    data, offsets = utf8(texts)
    out, parts = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for lo, hi in slices(offsets, SLICE_BYTES) if model else ():
        bucket, passage, row = bags(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        odds = np.full(hi - lo, -np.inf)
        np.maximum.at(odds, row, _passages(model, bucket, passage, len(row)))
        odds[np.isinf(odds)] = model.bias
        out[lo:hi] = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        parts[lo:hi] = np.bincount(row, minlength=hi - lo)
    return out, parts


def score(docs: DataFrame, model: SubwordSoftmax | None, key: str, text: str) -> DataFrame:
    """(key, score, predicted, n_passages) for each row over its whole text."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, parts = _scores(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out), pa.array((out >= 0.5).astype(np.int32)), pa.array(parts)], ["key", "score", "predicted", "n_passages"])

    return rows.mapInArrow(rate, "key long, score double, predicted int, n_passages long")


def keep_clean(docs: DataFrame, model: SubwordSoftmax | None, text: str) -> DataFrame:
    """The rows of docs, all columns, whose predicted class is not toxic."""
    at = docs.columns.index(text)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), model)[0] < 0.5))

    return docs.mapInArrow(sift, docs.schema)


def some_passages(text: str, most_bytes: int, seed: int) -> str:
    """text, or if it is over most_bytes, hash-chosen passages from all over it, in their order; one at least."""
    if len(text.encode("utf-8", "replace")) <= most_bytes:
        return text
    spans = np.array([m.span() for m in _PASSAGES.finditer(text)], np.int64).reshape(-1, 2)
    chosen, left = [], most_bytes
    for k in np.argsort(mix(np.arange(len(spans), dtype=np.uint64) + mix(np.array([seed % (1 << 64)], np.uint64)))).tolist():
        passage = _SPACES.sub(" ", text[spans[k, 0] : spans[k, 1]])
        left -= len(passage.encode("utf-8", "replace")) + 1
        if chosen and left < 0:
            break
        chosen.append((k, passage))
    return "".join(f"{passage.rstrip(' ')} " for _, passage in sorted(chosen))


def bound_of(sizes: list[int], most: int) -> int:
    """The largest bound on each size under which all sizes add up to most at the most."""
    for n, size in zip(range(len(sizes), 0, -1), sorted(sizes)):
        if size * n > most:
            return most // n
        most -= size
    return max(sizes, default=0)


def sample_labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, zeros: int, ones: int, most_bytes: int = 12 << 20) -> tuple[list[str], list[int]]:
    """About so many texts of each class, drawn by a hash of the key; class sizes are counted over all labels.

    Texts are whole if they are within most_bytes together. If not, the longest are
    read in passages drawn from all over them, within one bound that makes the sum
    fit; no row is left out for its size. Both numbers and most_bytes bound what the
    driver trains on. Only labels of rows that have a text are drawn from. Where these are of one class, train()
    has nothing to tell apart: every score is then 0 and nothing is rejected.
    """
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y"))
    marks = marks.join(docs.where(F.length(text) > 0).select(F.col(key).alias("key")), "key", "left_semi")
    sizes = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    limit = F.lit(0.0)
    for y, n in sizes.items():
        limit = F.when(F.col("y") == y, F.lit(min(1.0, (zeros, ones)[y] / max(1, n)))).otherwise(limit)
    draw = F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1 << 30))
    drawn = marks.where(draw < limit * (1 << 30)).withColumn("draw", draw).orderBy("draw", "key").limit(2 * (zeros + ones))  # bounded, so broadcast
    rows = docs.where(F.length(text) > 0).select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(drawn), "key")
    rows = rows.withColumn("own", F.xxhash64("text"))
    first = lambda found: found.orderBy("draw", "key", "own").limit(2 * (zeros + ones)).collect()
    lengths = [r["n"] for r in first(rows.select("draw", "key", "own", F.octet_length("text").alias("n")))]
    bound = bound_of(lengths, most_bytes)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):  # a row at a time: a batch may hold long texts
                r = batch.slice(k, 1)
                short = some_passages(r.column(3)[0].as_py(), bound, r.column(2)[0].as_py())
                yield pa.RecordBatch.from_arrays([*r.columns[:3], pa.array([short]), r.column(4)], ["draw", "key", "own", "text", "y"])

    taken = rows.select("draw", F.col("key").cast("long").alias("key"), "own", "text", "y")
    if sum(lengths) > most_bytes:
        taken = taken.mapInArrow(shorten, "draw long, key long, own long, text string, y int")
    kept = first(taken)
    return [r["text"] for r in kept], [r["y"] for r in kept]
