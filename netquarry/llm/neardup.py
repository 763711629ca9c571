"""Embedding near-duplicates by int8 quantised tile products with error bounds.

Vectors are compared only within a label. Equal vectors of a label are one
distinct vector with a number of copies. Distinct vectors are dealt by a hash of
their id into blocks of about BLOCK rows, and every pair of blocks of a label is a
tile of work. In a tile each unit vector u is quantised to s q with int8 q and
the exact length e of what is lost; then

    |u . v - s_u s_v (q_u . q_v)| <= |s_u q_u| e_v + e_u |s_v q_v| + e_u e_v

so pairs whose quantised cosine plus this bound stays under the threshold cannot
link, and only the rest are computed in double precision. A tile returns each
vector's number of links and a spanning forest of its links, at most as many
rows as it read, never the pairs. Components follow from the forests.

Cases: vectors that are null, empty, zero, or with null or non-finite components
link with nothing, nor do rows with a null label or id; each is kept as a
component of its own. Vectors of different length link with nothing. Rows that
repeat an id count as vectors of that id. Extra columns are ignored; an empty
table gives no row.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, forest
from .shared import HOT, HOT_ROWS, cut
from .vectors import matrix, usable

BLOCK = 2048


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: int8 values (as float32, whose products are exact), scales, lengths of s q, lengths of what is lost."""
    s = np.maximum(np.abs(u).max(axis=1), 1e-300) / 127
    q = np.rint(u / s[:, None])
    back = q * s[:, None]
    exact = np.float32 if u.shape[1] * 127 * 127 < 2**24 else np.float64
    return q.astype(exact), s, np.sqrt((back * back).sum(axis=1)), np.sqrt(((u - back) ** 2).sum(axis=1))


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (i, j) of rows of x and y with cosine >= threshold; of one block only i < j."""
    nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    qx, sx, lx, ex = quantise(x / nx[:, None])
    qy, sy, ly, ey = (qx, sx, lx, ex) if same else quantise(y / ny[:, None])
    most = (qx @ qy.T) * sx[:, None] * sy[None, :]
    most += lx[:, None] * ey[None, :] + ex[:, None] * (ly + ey)[None, :]
    i, j = np.nonzero(most >= threshold - 1e-9)
    if same:
        i, j = i[i < j], j[i < j]
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 15):
        a, b = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
        keep[at : at + (1 << 15)] = (x[a] * y[b]).sum(axis=1) / (nx[a] * ny[b]) >= threshold
    return i[keep], j[keep]


def near_duplicates(vectors: DataFrame, key: str, vector: str, label: str, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id) for each row."""
    some = F.exists(F.col("x"), lambda v: v != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("x"))
    part: Column = usable(F.col("x")) & F.coalesce(some, F.lit(False)) & F.col("label").isNotNull() & F.col("id").isNotNull()
    kind = rows.schema["label"].dataType.simpleString()
    copies = rows.where(part).groupBy("label", "x").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # an id can stand at several vectors, so vectors have numbers of their own; ids are the vertices of components
    distinct = cut(copies.withColumns({"dim": F.size("x"), "number": F.monotonically_increasing_id()}))
    sizes = distinct.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    narrow = rows.schema["x"].dataType.elementType.simpleString() == "float"

    def gather(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        block = pickle.dumps((np.asarray(table["number"]), np.asarray(table["copies"]), matrix(table["x"], dim, "f4" if narrow else "f8")))
        return pa.table([table["label"].slice(0, 1), table["dim"].slice(0, 1), table["block"].slice(0, 1), table["blocks"].slice(0, 1), pa.array([block], pa.binary())], ["label", "dim", "block", "blocks", "data"])

    dealt = distinct.join(sizes, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("number"), "blocks").cast("int")).select("label", "dim", "block", "blocks", "number", "copies", "x")
    blocks = dealt.groupBy("label", "dim", "block").applyInArrow(gather, f"label {kind}, dim int, block int, blocks int, data binary")
    meets = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meets = meets.select("label", "dim", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "data")

    def compare(table: pa.Table) -> pa.Table:
        parts = [pickle.loads(table["data"][k].as_py()) for k in np.argsort(np.asarray(table["block"]))]
        same = table["lo"][0].as_py() == table["hi"][0].as_py()
        if len(parts) < 2 and not same:  # a block of the other number can be empty
            return pa.table([pa.array([], pa.int64())] * 3, ["number", "links", "root"])
        (ids, n, x), (more, m, y) = parts[0], parts[-1]
        i, j = tile_links(x.astype("f8"), y.astype("f8"), threshold, same)
        every, weight = (ids, n) if same else (np.concatenate([ids, more]), np.concatenate([n, m]))
        j = j if same else j + len(ids)
        links = np.bincount(i, weight[j], len(every)) + np.bincount(j, weight[i], len(every))
        root = every[forest(len(every), i, j)]
        hit = links > 0
        return pa.table([pa.array(every[hit]), pa.array(links[hit].astype(np.int64)), pa.array(root[hit])], ["number", "links", "root"])

    found = cut(meets.groupBy("label", "dim", "lo", "hi").applyInArrow(compare, "number long, links long, root long"))
    links = found.groupBy("number").agg(F.sum("links").alias("links"))
    ids = distinct.select("number", "rep")
    ends = found.select("number", "root").distinct().join(ids, "number").join(ids.select(F.col("number").alias("root"), F.col("rep").alias("other")), "root")
    components = connected_components(ends, "rep", "other").withColumnRenamed("vertex", "rep")
    marked = distinct.join(links, "number", "left").join(components, "rep", "left").select("label", "x", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    marked = cut(marked)
    # vectors with a large share of all rows, HOT at most, are joined by broadcast, so that their copies need not meet in one task
    n = distinct.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    often = marked.where(F.col("copies") >= max(HOT_ROWS, n / HOT))
    hot = F.broadcast(often.drop("copies"))
    mine = rows.where(part)
    yes = mine.join(F.broadcast(often.select("label", "x")), ["label", "x"], "left_anti").join(marked.drop("copies"), ["label", "x"], "left").unionByName(mine.join(hot, ["label", "x"])).select("id", "n_links", "component_id")
    no = rows.where(~part).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return yes.unionByName(no).withColumnRenamed("id", "vec_id")
