"""Quality by hierarchical empirical Bayes over hosts and paths.

Evidence: a logistic classifier over surface features of the whole text gives
each document a log-likelihood ratio of good against poor. Grouped aggregation
sums the classifier's probabilities by host and by path within host; the
strength of each level's prior is estimated from the spread between its groups
(method of moments), and each group's mean is shrunk towards its parent:

    host mean = (sum + k_host * global) / (n + k_host)
    path mean = (sum + k_path * host mean) / (n + k_path)

A document's posterior log-odds are its log-likelihood ratio plus the log-odds of
its path's mean, bounded by PRIOR_REACH so that no site alone decides. Documents
with a posterior below the threshold are rejected.

Cases: null and empty texts have no evidence and get their path's mean. A null
host or path is a group of its own. Without labels of both classes all evidence
is 0 and the global mean is 0.5, so everything is kept. Extra columns are
carried by keep_good() and never read; repeated rows count as often as
they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut
from .textbytes import slices, utf8, words

FEATURES = ("symbols", "capitals", "digits", "repeats_1", "repeats_2", "repeats_3", "repeats_4", "long_words", "short_words", "mean_word", "lines")
SLICE_BYTES = 1 << 18
PRIOR_REACH = 2.0
BROADCAST_GROUPS = 200_000

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[[ord(c) for c in "!#$%&*|<>{}[]=~^@_\\/+"]] = 1
_CAPITAL = np.zeros(256, np.uint8)
_CAPITAL[65:91] = 1
_DIGIT = np.zeros(256, np.uint8)
_DIGIT[48:58] = 1
_LINE = np.zeros(256, np.uint8)
_LINE[10] = 1


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, len(FEATURES)) surface measures of whole texts, each bounded."""
    n = np.maximum(1, np.diff(offsets))

    def share(marks: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(marks[data], dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    start, end, hashes, first = words(data, offsets)
    count = np.diff(first)
    row = np.repeat(np.arange(len(n)), count)
    some = np.maximum(1, count)
    size = end - start
    per = lambda mark: np.bincount(row, mark, len(n)) / some
    out = [share(_SYMBOL) / n, share(_CAPITAL) / n, share(_DIGIT) / n]
    for lag in (1, 2, 3, 4):
        same = np.zeros(len(hashes), bool)
        if len(hashes) > lag:
            same[lag:] = (hashes[lag:] == hashes[:-lag]) & (row[lag:] == row[:-lag])
        out.append(per(same))
    out += [per(size > 25), per(size == 1), np.minimum(per(size), 40) / 10, np.minimum(1, share(_LINE) * 20 / n)]
    return np.sqrt(np.stack(out, axis=1))


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    base: float
    """base: the training classes' log-odds, taken off to leave the evidence."""

    def ratio(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weight + self.bias - self.base, -30, 30)


def fit(x: np.ndarray, y: np.ndarray, steps: int = 60, penalty: float = 1e-3) -> Logistic | None:
    """Newton's method; None if a class is missing."""
    if len(set(y.tolist())) < 2:
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) / len(y) + penalty * w
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-6)[:, None]) / len(y) + penalty * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, scale, w[:-1], float(w[-1]), float(np.log(y.mean() / (1 - y.mean()))))


def _measured(docs: DataFrame, text: str, model: Logistic | None, keep_text: bool = False) -> DataFrame:
    """docs, without its text unless kept, with log_ratio and (for training) features."""
    kept = [c for c in docs.columns if c != text]
    rows = docs.select(*kept, F.col(text).alias("__text"))
    kept += ["__text"] * keep_text
    schema = rows.select(*kept).schema.add("log_ratio", T.DoubleType()).add("features", T.ArrayType(T.DoubleType()))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(batch.num_columns - 1))
            parts = [features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in slices(offsets, SLICE_BYTES)]
            x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
            ratio = np.where(np.diff(offsets) > 0, model.ratio(x), 0.0) if model else np.zeros(len(x))
            given = pa.array([None] * len(x), pa.list_(pa.float64())) if model else pa.array(list(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(ratio), given], [*kept, "log_ratio", "features"])

    return rows.mapInArrow(measure, schema)


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int = 20_000) -> Logistic | None:
    """Fit the document classifier on the features of about `most` labelled texts, drawn by a hash of the key."""
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("double").alias("y"))
    n = marks.count()
    draw = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1 << 30))
    drawn = marks.where(draw < min(1.0, most / max(1, n)) * (1 << 30)).orderBy(draw, "key").limit(2 * most)  # bounded, so broadcast
    rows = docs.where(F.length(text) > 0).select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(drawn), "key")
    got = _measured(rows, "text", None).orderBy("key", "log_ratio").limit(2 * most).select("features", "y").toPandas()
    if not len(got):
        return None
    return fit(np.stack(got["features"].to_numpy()), got["y"].to_numpy())


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def site_means(evidence: DataFrame, host: str, path: str) -> tuple[DataFrame, float]:
    """(host, path, path_mean, host_mean, n_path, n_host) for every path, and the global mean.

    evidence has p_doc, the classifier's probability. It is read three times over,
    so its group sums are written once. The strength of a level is
    k = m(1 - m) / (variance between its groups' means) - 1 with the variance
    that sampling alone explains taken off, kept within 1 and 10,000.
    """
    paths = evidence.groupBy(host, path).agg(F.sum("p_doc").alias("sum_path"), F.count(F.lit(1)).alias("n_path"))
    paths = cut(paths)
    hosts = paths.groupBy(F.col(host).alias("__host")).agg(F.sum("sum_path").alias("sum_host"), F.sum("n_path").alias("n_host"))
    total = hosts.agg(F.sum("sum_host").alias("s"), F.sum("n_host").alias("n")).first()
    mean = (total["s"] or 0.0) / total["n"] if total["n"] else 0.5

    def strength(groups: DataFrame, s: str, n: str) -> float:
        x = F.col(s) / F.col(n)
        row = groups.where(F.col(n) >= 2).agg(F.avg((x - mean) ** 2).alias("v"), F.avg(mean * (1 - mean) / F.col(n)).alias("noise")).first()
        between = max(1e-9, (row["v"] or 0.0) - (row["noise"] or 0.0))
        return float(min(10_000.0, max(1.0, mean * (1 - mean) / between - 1)))

    k_host, k_path = strength(hosts, "sum_host", "n_host"), strength(paths, "sum_path", "n_path")
    hosts = hosts.withColumn("host_mean", (F.col("sum_host") + k_host * mean) / (F.col("n_host") + k_host))
    joined = paths.join(hosts, F.col(host).eqNullSafe(F.col("__host"))).withColumn("path_mean", (F.col("sum_path") + k_path * F.col("host_mean")) / (F.col("n_path") + k_path))
    return joined.select(F.col(host).alias("__host"), F.col(path).alias("__path"), "path_mean", "host_mean", "n_path", "n_host"), mean


def judge(docs: DataFrame, model: Logistic | None, text: str, host: Column, path: Column, threshold: float = 0.5, keep_text: bool = False) -> DataFrame:
    """docs, without its text unless kept, plus log_ratio, host_mean, path_mean, score (posterior probability of good) and kept.

    The table of path means is broadcast only while it has BROADCAST_GROUPS rows or
    fewer; beyond that it is joined by shuffle.
    """
    base = model.base if model else 0.0
    named = docs.withColumns({"__h": host, "__p": path})
    p_doc = 1 / (1 + F.exp(-(F.col("log_ratio") + base)))
    evidence = _measured(named.select("__h", "__p", text), text, model).select("__h", "__p", p_doc.alias("p_doc"))
    means, overall = site_means(evidence, "__h", "__p")
    means = cut(means)
    small = means.count() <= BROADCAST_GROUPS
    on = F.col("__h").eqNullSafe(F.col("__host")) & F.col("__p").eqNullSafe(F.col("__path"))
    joined = _measured(named, text, model, keep_text).drop("features").join(F.broadcast(means) if small else means, on, "left")
    centre = _logit(F.lit(overall))
    prior = centre + F.greatest(F.lit(-PRIOR_REACH), F.least(F.lit(PRIOR_REACH), _logit(F.col("path_mean")) - centre))
    scored = joined.withColumn("score", 1 / (1 + F.exp(-(F.col("log_ratio") + prior))))
    return scored.withColumn("kept", F.col("score") >= threshold).drop("__h", "__p", "__host", "__path")


def keep_good(docs: DataFrame, model: Logistic | None, text: str, host: Column, path: Column) -> DataFrame:
    """The rows of docs, all columns, that judge() keeps."""
    names = [f"__c{k}" for k in range(len(docs.columns))]  # judge() adds columns, whose names docs may have too
    renamed = docs.withColumns({"__hc": host, "__pc": path}).toDF(*names, "__hc", "__pc")
    judged = judge(renamed, model, names[docs.columns.index(text)], F.col("__hc"), F.col("__pc"), keep_text=True).where("kept")
    return judged.select(*(F.col("__text" if c == text else n).alias(c) for n, c in zip(names, docs.columns)))
