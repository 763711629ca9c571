"""Exact top-k inner products of integer vectors by ball-tree branch and bound.

Candidates are dealt by a hash of their id into shards of about SHARD rows, and
each shard gets a ball tree: nodes with a centre and a radius, leaves of LEAF
rows. For a query q a node's scores are at most q . centre + |q| radius; a leaf
also keeps its ancestors' bounds. Queries go in blocks of about BLOCK. A block
first searches one home shard; the k-th scores found there go with it to all the
other shards, which it visits in chains of CHAIN, raising the k-th scores from
shard to shard. Leaves are visited from the highest bound down, and a query stops
where no bound reaches its current k-th score. A bound equal to it is still
visited, so ties are decided by id.

Components times the scale must stay under 2 ** 63. Scores are exact: products are summed as doubles while all partial sums stay
under 2 ** 53, else as Python integers. A score must fit a long.

Cases: unusable vectors (null, empty, or with null or non-finite components) and
rows with a null id take no part. Vectors are compared with those of their own
length only. Rows that repeat an id are candidates each, but none for a query of
that id. Fewer than k candidates give all; an empty table gives no row. Extra
columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut
from .vectors import matrix, usable

SHARD = 8192
LEAF = 32
BLOCK = 256
CHAIN = 8


class BallTree:
    """levels: for each depth, centres (nodes, d) and radii; the last level's nodes are the leaves, rows bounds[i]:bounds[i + 1]."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.arange(len(x))
        depth = max(0, math.ceil(math.log2(max(1, len(x)) / LEAF)))
        bounds = np.array([0, len(x)])
        self.levels = []
        for level in range(depth + 1):
            centres = np.array([x[order[a:b]].mean(axis=0) if b > a else np.zeros(x.shape[1]) for a, b in zip(bounds, bounds[1:])])
            radii = np.array([np.sqrt(((x[order[a:b]] - c) ** 2).sum(axis=1).max()) if b > a else -np.inf for a, b, c in zip(bounds, bounds[1:], centres)])
            self.levels.append((centres, radii))
            if level == depth:
                break
            split = [0]
            for a, b in zip(bounds, bounds[1:]):
                rows = order[a:b]
                if len(rows) > 1:  # halve along the line through a far point and the point farthest from it
                    far = x[rows[((x[rows] - x[rows].mean(axis=0)) ** 2).sum(axis=1).argmax()]]
                    other = x[rows[((x[rows] - far) ** 2).sum(axis=1).argmax()]]
                    order[a:b] = rows[np.argsort(x[rows] @ (other - far), kind="stable")]
                split += [(a + b) // 2, b]
            bounds = np.array(split)
        self.ids, self.x, self.bounds = ids[order], x[order], bounds

    def leaf_bounds(self, q: np.ndarray) -> np.ndarray:
        """(queries, leaves) upper bounds, each with its ancestors'."""
        size = np.sqrt((q * q).sum(axis=1))[:, None]
        best = np.full((len(q), 1), np.inf)
        for k, (centres, radii) in enumerate(self.levels):
            with np.errstate(invalid="ignore"):
                own = q @ centres.T + np.where(radii < 0, -np.inf, size * np.maximum(radii, 0))
            own += np.where(radii < 0, 0, np.abs(own) * 1e-9 + 1e-6)
            best = np.minimum(np.repeat(best, 2, axis=1) if k else best, own)
        return best


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    return q @ x.T if most < 2**53 else q.astype(np.int64).astype(object) @ x.astype(np.int64).astype(object).T


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.found: list[list[tuple]] = [[] for _ in ids]
        self.kth = np.full(len(ids), -np.inf)

    def offer(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ok = (ids != self.ids[query]) & (scores.astype(float) >= self.kth[query])
        if ok.any():
            got = self.found[query] + [(-int(s), int(i)) for s, i in zip(scores[ok], ids[ok])]
            self.found[query] = sorted(got)[: self.k]
            if len(self.found[query]) == self.k:
                self.kth[query] = max(self.kth[query], float(-self.found[query][-1][0]))


def search(tree: BallTree, q: np.ndarray, best: Best) -> None:
    bounds = tree.leaf_bounds(q)
    order = np.argsort(-bounds, axis=1, kind="stable")
    for turn in range(order.shape[1]):
        leaf = order[:, turn]
        bound = bounds[np.arange(len(q)), leaf]
        active = np.flatnonzero((bound >= best.kth) & (bound > -np.inf))
        if not len(active):
            break
        for node in np.unique(leaf[active]):
            rows = active[leaf[active] == node]
            a, b = tree.bounds[node], tree.bounds[node + 1]
            for query, scores in zip(rows, _scores(q[rows], tree.x[a:b])):
                best.offer(query, tree.ids[a:b], scores)


_FOUND = "query_id long, vec_id long, score long"


def _rows(best: list[Best]) -> pa.RecordBatch:
    rows = [(int(q), i, -s) for b in best for q, found in zip(b.ids, b.found) for s, i in found]
    columns = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])


def integers(vector: Column, scale: float) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def top_k(vectors: DataFrame, key: str, vector: str, queries: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates for each row that `queries` marks."""
    rows = vectors.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), integers(F.col(vector), scale).alias("x"), F.coalesce(queries, F.lit(False)).alias("asks")).withColumn("dim", F.size("x"))
    sizes = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"), F.ceil(F.greatest(F.sum(F.col("asks").cast("int")), F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(sizes, "dim")

    def build(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        tree = BallTree(np.asarray(table["id"]), matrix(table["x"], dim, "f8"))
        return pa.table([pa.array([dim], pa.int32()), pa.array([table["shard"][0].as_py()], pa.int32()), pa.array([pickle.dumps(tree)], pa.binary())], ["dim", "shard", "tree"])

    trees = rows.withColumn("shard", F.pmod(F.xxhash64("id"), "shards").cast("int")).select("dim", "shard", "id", "x")
    trees = cut(trees.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, tree binary"))

    def gather(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        block = pickle.dumps((np.asarray(table["id"]), matrix(table["x"], dim, "f8")))
        first = lambda c: pa.array([table[c][0].as_py()], pa.int32())
        return pa.table([first("dim"), first("block"), first("shards"), pa.array([block], pa.binary())], ["dim", "block", "shards", "queries"])

    asked = rows.where("asks").withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), "blocks").cast("int")).select("dim", "block", "shards", "id", "x")
    asked = cut(asked.groupBy("dim", "block").applyInArrow(gather, "dim int, block int, shards int, queries binary"))

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, block, tree, queries in zip(*(c.to_pylist() for c in batch.columns)):
                ids, q = pickle.loads(queries)
                best = Best(ids, k)
                search(pickle.loads(tree), q, best)
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([block], pa.int32()), pa.array([pickle.dumps(best)], pa.binary())], ["dim", "block", "best"])

    home = F.pmod("block", "shards")
    start = asked.withColumn("shard", home).join(trees, ["dim", "shard"]).select("dim", "block", "tree", "queries")
    start = cut(start.repartition("dim", "block").mapInArrow(at_home, "dim int, block int, best binary"))

    def chain(table: pa.Table) -> pa.Table:
        best = pickle.loads(table["best"][0].as_py())
        _, q = pickle.loads(table["queries"][0].as_py())
        best.found = [[] for _ in best.ids]  # the home shard's rows stay there; only its k-th scores are shared
        for tree in table["tree"]:
            search(pickle.loads(tree.as_py()), q, best)
        return pa.Table.from_batches([_rows([best])])

    visits = asked.join(start, ["dim", "block"]).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).where(F.col("shard") != home)
    visits = visits.join(trees, ["dim", "shard"]).select("dim", "block", F.expr(f"shard div {CHAIN}").alias("chain"), "queries", "best", "tree")
    away = visits.groupBy("dim", "block", "chain").applyInArrow(chain, _FOUND)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows([pickle.loads(b) for b in batch.column(0).to_pylist()])

    found = start.select("best").mapInArrow(unpack, _FOUND).unionByName(away)
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
