"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers, one reading forwards and one backwards, run over
windows of a text's UTF-8 bytes; a softmax on both states labels every byte, and
a document's probabilities are the mean of its bytes' probabilities. The network
is trained in numpy by backpropagation through time on windows drawn from the
whole of a bounded sample of labelled texts.

Cases: a null text, or one without a letter, is `und` with score 0. No labelled
text at all gives `und` everywhere. Long texts are cut into windows that cover
every byte, so memory is bounded by a batch. Extra columns are ignored; repeated
rows and ids are each labelled alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbytes import slices, utf8

WINDOW = 64
BATCH = 2048
RESULT = "key long, lang_pred string, score double, n_bytes long"


@dataclass
class ByteGRU:
    """x: (2, 3H, 256) input weights, u: (2, 3H, H) recurrent ones, v: (L, 2H), c: (L,); first index: direction. Gates: reset, update, candidate."""

    langs: list[str]
    x: np.ndarray
    u: np.ndarray
    v: np.ndarray
    c: np.ndarray

    @property
    def hidden(self) -> int:
        return self.u.shape[2]

    def states(self, windows: np.ndarray) -> np.ndarray:
        """(T, 2H, B) states of both directions for windows (T, B) of bytes."""
        t, b = windows.shape
        n = self.hidden
        out = np.empty((t, 2 * n, b), np.float32)
        r = np.empty((3 * n, b), np.float32)
        g = np.empty((3 * n, b), np.float32)
        for way in (0, 1):
            h = np.zeros((n, b), np.float32)
            x, u = self.x[way], self.u[way]
            for step in range(t) if way == 0 else range(t - 1, -1, -1):
                np.take(x, windows[step], axis=1, out=g, mode="clip")
                np.matmul(u, h, out=r)
                gates, cand = r[: 2 * n], r[2 * n :]
                gates += g[: 2 * n]
                gates *= 0.5
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                cand *= gates[:n]
                cand += g[2 * n :]
                np.tanh(cand, out=cand)
                h -= cand
                h *= gates[n:]
                h += cand
                out[step, way * n : way * n + n] = h
        return out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """(T, L, B) label probabilities of every position."""
        logits = np.matmul(self.v, states) + self.c[:, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits


def _backward(net: ByteGRU, windows: np.ndarray, states: np.ndarray, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backpropagation through time: gradients of x and u."""
    t, b = windows.shape
    n = net.hidden
    gx, gu = np.zeros_like(net.x), np.zeros_like(net.u)
    for way in (0, 1):
        x, u = net.x[way], net.u[way]
        steps = list(range(t)) if way == 0 else list(range(t - 1, -1, -1))
        back = np.zeros((n, b), np.float32)
        inputs = np.empty((t, 3 * n, b), np.float32)
        for k in range(t - 1, -1, -1):
            step = steps[k]
            before = states[steps[k - 1], way * n : way * n + n] if k else np.zeros((n, b), np.float32)
            a, r = x[:, windows[step]], u @ before
            gates = 0.5 * np.tanh(0.5 * (a[: 2 * n] + r[: 2 * n])) + 0.5
            reset, keep = gates[:n], gates[n:]
            cand = np.tanh(a[2 * n :] + reset * r[2 * n :])
            d = back + d_states[step, way * n : way * n + n]
            d_cand = d * (1 - keep) * (1 - cand * cand)
            d_keep = d * (before - cand) * keep * (1 - keep)
            d_reset = d_cand * r[2 * n :] * reset * (1 - reset)
            d_r = np.concatenate([d_reset, d_keep, d_cand * reset])
            inputs[step] = np.concatenate([d_reset, d_keep, d_cand])
            gu[way] += d_r @ before.T
            back = d * keep + u.T @ d_r
        flat = inputs.transpose(1, 0, 2).reshape(3 * n, -1)
        index = windows.reshape(-1)
        for row in range(3 * n):
            gx[way, row] = np.bincount(index, flat[row], 256)
    return gx, gu


def train(samples: list[tuple[str, bytes]], hidden: int = 8, steps: int = 500, batch: int = 256, rate: float = 0.02, seed: int = 7) -> ByteGRU | None:
    """Fit on (language, bytes) windows with Adam; every position carries its window's language. None without samples."""
    langs = sorted({lang for lang, _ in samples})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    lengths = np.array([min(len(s), WINDOW) for _, s in samples])
    data = np.zeros((WINDOW, len(samples)), np.int64)
    for k, (_, s) in enumerate(samples):
        data[: lengths[k], k] = np.frombuffer(s[:WINDOW], np.uint8)
    target = np.array([langs.index(lang) for lang, _ in samples])
    by_lang = [np.flatnonzero(target == k) for k in range(len(langs))]
    n = hidden
    net = ByteGRU(langs, *(rng.normal(0, s, shape).astype(np.float32) for s, shape in ((0.3, (2, 3 * n, 256)), (n**-0.5 / 2, (2, 3 * n, n)), (0.3, (len(langs), 2 * n)), (0.0, (len(langs),)))))
    moments = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in "xuvc"}
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(rows, max(1, batch // len(langs))) for rows in by_lang])
        w, y = data[:, pick], target[pick]
        mask = (np.arange(WINDOW)[:, None] < lengths[pick]).astype(np.float32)
        states = net.states(w)
        d = net.probabilities(states)
        d[:, y, np.arange(len(pick))] -= 1
        d *= (mask / max(1.0, float(mask.sum())))[:, None, :]
        grads = {"v": np.einsum("tlb,thb->lh", d, states, optimize=True), "c": d.sum(axis=(0, 2))}
        grads["x"], grads["u"] = _backward(net, w, states, np.matmul(net.v.T, d))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        now = rate * (1 - 0.9 * step / steps)
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m = moments[k]
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            getattr(net, k)[...] -= now * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return net


def sample_windows(texts: DataFrame, lang: str, text: str, per_lang: int, windows: int, seed: int = 7, most: int = 25_000, most_langs: int = 1000) -> list[tuple[str, bytes]]:
    """At most `windows` windows of bytes, at random places of the whole text, from about per_lang texts of each language.

    Counts by language are over all distinct texts, copies once; texts are then drawn by their
    hash. With many languages each gives fewer texts, so that all have about `most`
    together (8 each at least). Of more than `most_langs` labels those with the most texts are
    learnt, ties by name. `most` x windows and 8 x windows a label bound what reaches the driver.
    """
    rows = texts.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = rows.select("lang", F.xxhash64("text").alias("draw")).distinct().groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()
    languages = len(counts)
    if not counts:
        return []
    counts = texts.sparkSession.createDataFrame([(r["lang"], r["count"]) for r in counts], f"lang {rows.schema['lang'].dataType.simpleString()}, count long")
    each = max(1, min(per_lang, most // max(1, languages)))
    drawn = (
        rows.join(F.broadcast(counts), "lang")
        .where(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30)) < F.least(F.lit(1.0), F.greatest(F.lit(each), F.lit(8)) / F.col("count")) * (1 << 30))
        .select("lang", F.encode("text", "utf-8").alias("data"), F.xxhash64("text").alias("draw"))
    )
    drawn = drawn.groupBy("lang", "draw").agg(F.min("data").alias("data"))
    spots = F.transform(F.sequence(F.lit(1), F.lit(windows)), lambda k: F.substring(F.col("data"), F.pmod(F.xxhash64("draw", k), F.greatest(F.lit(1), F.length("data") - WINDOW + 1)).cast("int") + 1, F.lit(WINDOW)))
    taken = drawn.select("lang", F.explode(spots).alias("w"), "draw").orderBy("draw", "lang", "w")
    return [(r["lang"], bytes(r["w"])) for r in taken.collect()]


def identify(docs: DataFrame, net: ByteGRU | None, key: str, text: str) -> DataFrame:
    """(key, lang_pred, score, n_bytes) for each row of docs, over its whole text."""
    lettered: Column = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(key).alias("key"), F.when(lettered, F.col(text)).alias("text"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            total = np.zeros((len(net.langs) if net else 1, batch.num_rows))
            for lo, hi in slices(offsets, WINDOW * BATCH * 4) if net else ():
                _pool(net, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], total[:, lo:hi])
            sizes = np.diff(offsets)
            mean = total / np.maximum(1, sizes)
            best = mean.argmax(axis=0)
            known = (sizes > 0) & (net is not None)
            names = np.array([*(net.langs if net else []), "und"], object)[np.where(known, best, -1)]
            score = np.where(known, np.clip(mean.max(axis=0), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(names, pa.string()), pa.array(score), pa.array(sizes.astype(np.int64))], ["key", "lang_pred", "score", "n_bytes"])

    return rows.mapInArrow(label, RESULT)


def _pool(net: ByteGRU, data: np.ndarray, offsets: np.ndarray, total: np.ndarray) -> None:
    """Add to total (L, rows) the summed probabilities of each row's bytes."""
    sizes = np.diff(offsets)
    parts = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), parts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = offsets[:-1][row] + nth * WINDOW
    length = np.minimum(WINDOW, offsets[1:][row] - begin)
    order = np.argsort(-length, kind="stable")  # short last windows run together, in fewer steps
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    for at in range(0, len(order), BATCH):
        pick = order[at : at + BATCH]
        most = int(length[pick[0]])
        steps = np.arange(most)[:, None]
        inside = steps < length[pick]
        windows = np.where(inside, padded[begin[pick] + steps], 0).astype(np.intp)
        p = net.probabilities(net.states(windows))
        p *= inside[:, None, :]
        sums = p.sum(axis=0)
        for k in range(len(sums)):
            total[k] += np.bincount(row[pick], sums[k], total.shape[1])
