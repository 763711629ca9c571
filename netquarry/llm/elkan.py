"""Exact integer k-means by Elkan's bounds.

Vectors become integers, floor(scale * x), and are kept in blocks. Every vector
caches its cluster, an upper bound of the distance to that cluster's centroid and
a lower bound to each centroid. When centroids move, the bounds move by the drift;
a centroid is measured only where neither its lower bound nor half its distance to
the vector's own centroid shows that it lies strictly farther away. Bounds are
rounded outwards and compared strictly, so a centroid that could tie is always
measured; measured distances are exact integers.

Each round is one pass over the blocks of the round before, written as Parquet to
the shared checkpoint folder; the folder before that is then deleted. Only the sums
of each cluster (k * dim numbers) come to the driver.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .shared import drop, folder
from .vectors import matrix, usable

BLOCK = 1 << 13
#: Components below this keep every squared distance of up to 128 dimensions in 63 bits.
LARGEST = 1 << 27

_BLOCK = "ids binary, nulls binary, vectors binary, width int, cluster binary, distance binary, upper binary, lower binary, sums binary, counts binary"
_EPS = 2.0**-50


def _above(x: np.ndarray) -> np.ndarray:
    return x * (1 + _EPS) + 1e-300


def _below(x: np.ndarray) -> np.ndarray:
    return np.maximum(x * (1 - _EPS) - 1e-300, 0)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows x to the one integer row c."""
    d = x.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


def first_bounds(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, ...]:
    """(cluster, distance, upper, lower): nearest centroid, ties to the smaller number, and bounds that hold."""
    exact = np.stack([squared(x, c) for c in centroids], 1) if len(x) else np.zeros((0, len(centroids)), np.int64)
    cluster = exact.argmin(1).astype(np.int32)
    distance = exact[np.arange(len(x)), cluster]
    return cluster, distance, _above(np.sqrt(distance)), _below(np.sqrt(exact))


def moved_bounds(x: np.ndarray, before: np.ndarray, centroids: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
    """(cluster, distance, upper, lower, measured) after centroids moved from `before`; distance is exact where it was measured, else -1; measured counts distances."""
    k = len(centroids)
    drift = np.array([np.sqrt(squared(before[j : j + 1], centroids[j])[0]) for j in range(k)])
    between = np.stack([_below(np.sqrt(squared(centroids, c))) / 2 for c in centroids])
    np.fill_diagonal(between, np.inf)
    cluster, upper = cluster.copy(), _above(upper + _above(drift)[cluster])
    lower = _below(lower - _above(drift)[None, :])
    distance, measured = np.full(len(x), -1, np.int64), 0
    # a vector whose bound is strictly within half the way to the nearest other centroid keeps its cluster
    rows = np.flatnonzero(~(upper < between.min(1)[cluster]))
    mine = np.arange(k)[None, :] == cluster[rows, None]
    rows = rows[(~(upper[rows, None] < lower[rows]) & ~(upper[rows, None] < between[cluster[rows]]) & ~mine).any(1)]
    for j in range(k):  # the upper bound is made tight once
        own = rows[cluster[rows] == j]
        distance[own] = squared(x[own], centroids[j])
        upper[own], lower[own, j] = _above(np.sqrt(distance[own])), _below(np.sqrt(distance[own]))
    measured += len(rows)
    held = cluster[rows].copy()
    for j in range(k):
        near = rows[(held != j) & (cluster[rows] != j) & ~(upper[rows] < lower[rows, j]) & ~(upper[rows] < between[cluster[rows], j])]
        if not len(near):
            continue
        exact = squared(x[near], centroids[j])
        measured += len(near)
        root = np.sqrt(exact)
        lower[near, j] = _below(root)
        wins = (exact < distance[near]) | ((exact == distance[near]) & (j < cluster[near]))
        won = near[wins]
        cluster[won], distance[won], upper[won] = j, exact[wins], _above(root[wins])
    return cluster, distance, upper, lower, measured


def _sums(x: np.ndarray, cluster: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    sums = np.zeros((k, x.shape[1]), np.int64)
    for j in np.unique(cluster):
        sums[j] = x[cluster == j].sum(0, dtype=np.int64)
    return sums, np.bincount(cluster, minlength=k).astype(np.int64)


def _packed(row: dict, x: np.ndarray, cluster: np.ndarray, distance: np.ndarray, upper: np.ndarray, lower: np.ndarray, k: int) -> dict:
    sums, counts = _sums(x, cluster, k)
    return row | {"cluster": cluster.astype("<i4").tobytes(), "distance": distance.astype("<i8").tobytes(), "upper": upper.tobytes(), "lower": lower.tobytes(), "sums": sums.tobytes(), "counts": counts.tobytes()}


def _vectors(row: dict, dim: int) -> np.ndarray:
    return np.frombuffer(row["vectors"], f"<i{row['width']}").reshape(-1, dim)


def _written(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


_ARROW = pa.schema([(f.split()[0], pa.int32() if f.endswith("int") else pa.binary()) for f in _BLOCK.split(", ")])


def _start(dim: int, scale: float, centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = pa.Table.from_batches([batch.slice(at, BLOCK)])
                x = np.floor(matrix(part["vector"], dim, "float64") * scale)
                if len(x) and np.abs(x).max() >= LARGEST:
                    raise ValueError(f"components of {LARGEST / scale} or more give squared distances beyond 63 bits")
                width = 2 if not len(x) or np.abs(x).max() < 1 << 15 else 4
                x = x.astype(f"<i{width}")
                ids = part["id"].combine_chunks()
                row = {"ids": np.asarray(ids.fill_null(0)).astype("<i8").tobytes(), "nulls": np.asarray(ids.is_null()).tobytes(), "vectors": x.tobytes(), "width": width}
                yield _written([_packed(row, x, *first_bounds(x, centroids), len(centroids))], _ARROW)

    return run


def _round(dim: int, before: np.ndarray, centroids: np.ndarray):
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                x = _vectors(row, dim)
                cluster, distance, upper, lower, _ = moved_bounds(x, before, centroids, np.frombuffer(row["cluster"], "<i4"), np.frombuffer(row["upper"]), np.frombuffer(row["lower"]).reshape(-1, k))
                yield _written([_packed(row, x, cluster, distance, upper, lower, k)], _ARROW)

    return run


def _added(k: int, dim: int):
    """The sums of a task's blocks, one row a component of a cluster; whole numbers of any size as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim), object), np.zeros(k, object)
        for batch in batches:
            for s, n in zip(batch["sums"], batch["counts"]):
                sums += np.frombuffer(s.as_py(), np.int64).reshape(k, dim).astype(object)
                counts += np.frombuffer(n.as_py(), np.int64).astype(object)
        if any(counts):
            cells = np.concatenate([sums, counts[:, None]], 1).ravel()
            yield pa.RecordBatch.from_pydict({"cell": pa.array(range(len(cells)), pa.int32()), "total": pa.array([str(v) for v in cells])})

    return run


def _means(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every non-empty cluster's componentwise floor(sum / count)."""
    k, dim = centroids.shape
    parts = blocks.select("sums", "counts").mapInArrow(_added(k, dim), "cell int, total string")
    found = {r["cell"]: int(r["total"]) for r in parts.groupBy("cell").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    out = centroids.copy()
    for j in range(k):
        if n := found.get(j * (dim + 1) + dim, 0):
            out[j] = [found[j * (dim + 1) + d] // n for d in range(dim)]
    return out


def _rows(dim: int, centroids: np.ndarray):
    """One row a vector; the distance is measured where the last round's bounds left it out."""
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                x, cluster = _vectors(row, dim), np.frombuffer(row["cluster"], "<i4")
                distance = np.frombuffer(row["distance"], "<i8").copy()
                for j in np.unique(cluster):
                    open_ = np.flatnonzero((cluster == j) & (distance < 0))
                    distance[open_] = squared(x[open_], centroids[j])
                ids = pa.array(np.frombuffer(row["ids"], "<i8"), mask=np.frombuffer(row["nulls"], bool))
                yield pa.RecordBatch.from_pydict({"id": ids, "cluster": pa.array(cluster), "distance": pa.array(distance), "centroid_sha256": pa.array(names).take(pa.array(cluster))})

    return run


def cluster(df: DataFrame, id: str, vector: str, dim: int = 64, scale: float = 1024.0, k: int = 8, rounds: int = 10, salt: str = "3") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row for every row of df with `dim` finite components.

    Start: the k rows with the smallest lower-case hex sha256 of "<salt>:<id>", rows with
    equal hashes by their vectors; rows without an id are last to start a cluster (by vector), but are
    clustered like others. With fewer than k rows there are as many centroids as rows. Each round
    assigns every row to the nearest centroid, ties to the smaller number, and moves
    non-empty centroids to floor(sum / count); the rows are assigned once more at the end. When no
    centroid moves, the rounds left would change nothing and are not run. Rows whose vector is
    null, of another length or with null or non-finite components are left out;
    repeated rows and ids count each; an empty table gives no rows. Other columns of df are
    not read. Components of 2^27 / scale or more are an error, as their
    distances would not fit a long; k * dim numbers and k * k distances fit a task.
    """
    spark = df.sparkSession
    kept = df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(usable(F.col("vector")) & (F.size("vector") == dim))
    draw = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    seeds: list[Row] = kept.select("vector", draw.alias("draw")).orderBy(F.col("draw").asc_nulls_last(), "vector").limit(k).collect()
    schema = "id long, cluster int, distance long, centroid_sha256 string"
    if not seeds:
        return spark.createDataFrame([], f"{schema}, cluster_inertia long, inertia long").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    centroids = np.floor(np.array([r["vector"] for r in seeds], np.float64) * scale)
    if np.abs(centroids).max() >= LARGEST:
        raise ValueError(f"components of {LARGEST / scale} or more give squared distances beyond 63 bits")
    centroids = centroids.astype(np.int64)
    top = f"{folder(spark)}/elkan-{uuid.uuid4().hex}"
    kept.mapInArrow(_start(dim, scale, centroids), _BLOCK).write.parquet(f"{top}/0")
    blocks = spark.read.schema(_BLOCK).parquet(f"{top}/0")
    for turn in range(1, rounds + 1):
        before, centroids = centroids, _means(blocks, centroids)
        if (before == centroids).all():
            break
        blocks.mapInArrow(_round(dim, before, centroids), _BLOCK).write.parquet(f"{top}/{turn}")
        blocks = spark.read.schema(_BLOCK).parquet(f"{top}/{turn}")
        drop(spark, f"{top}/{turn - 1}")
    found = blocks.select("ids", "nulls", "vectors", "width", "cluster", "distance").mapInArrow(_rows(dim, centroids), schema)
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    inertia = {r["cluster"]: int(r["total"]) for r in sums}
    totals = spark.createDataFrame([(c, t, sum(inertia.values())) for c, t in inertia.items()], "cluster int, cluster_inertia long, inertia long")
    return found.join(F.broadcast(totals), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
