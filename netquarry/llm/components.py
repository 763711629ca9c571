"""Connected components of a link table by repeated contraction, all in DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, hot_values, join_hot


#: Links that one task takes as they are; more are contracted first.
FEW = 1 << 18


def _finished(links: DataFrame) -> DataFrame:
    """(v, root) of the vertices of at most FEW links (x, y), root the smallest reached, by one forest in one task."""
    kind = links.schema["x"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = [], []
        for batch in batches:
            x += batch.column(0).to_pylist()
            y += batch.column(1).to_pylist()
        if x:
            every = sorted({*x, *y})
            place = {v: k for k, v in enumerate(every)}
            root = forest(len(every), np.array([place[v] for v in x]), np.array([place[v] for v in y]))
            yield pa.RecordBatch.from_pydict({"v": every, "root": [every[k] for k in root]})

    return links.repartition(1).mapInArrow(run, f"v {kind}, root {kind}")


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, component) of every vertex that has a link; component is the smallest vertex reachable.

    In each round every label takes the lowest of itself and the labels linked to it,
    in an order drawn anew for the round, so that chains of falling labels are short
    whatever the ids; labels are followed once more (pointer jumping) and links are
    rewritten between the new labels, links within a label go. Rounds grow with the
    logarithm of the number of vertices. At the end each label is named by its
    smallest vertex. Once FEW links are left, one task finishes them. Labels that hold a large share of the links or vertices are joined by
    broadcast, so that no task gets all of a big component. Rows with a null end and
    links of a vertex to itself are left out; repeated and reversed links are one.
    """
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    live = cut(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    n, turn = live.count(), 0
    if n <= FEW:
        return cut(_finished(live)).select(F.col("v").alias("vertex"), F.col("root").alias("component"))
    labels = cut(live.select(F.explode(F.array("x", "y")).alias("vertex")).distinct().withColumn("component", F.col("vertex")))
    vertices = labels.count()
    while n > FEW:
        order = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("draw"), c.alias("p"))  # noqa: B023, E731
        ends = live.select(F.explode(F.array(F.struct(F.col("x").alias("v"), F.col("y").alias("u")), F.struct(F.col("y").alias("v"), F.col("x").alias("u")))).alias("e")).select("e.v", "e.u")
        hot = hot_values(ends.select("v"), 2 * n)
        hooks = cut(ends.groupBy("v").agg(F.min(order(F.col("u"))).alias("low")).select("v", F.least("low", order(F.col("v")))["p"].alias("p")))
        # p is a neighbour of v, so a hot p has a hot number of links
        hooks = cut(join_hot(hooks, hooks.select(F.col("v").alias("p"), F.col("p").alias("next")), "p", hot).select("v", F.col("next").alias("p")))
        labels = cut(join_hot(labels, hooks.withColumnRenamed("v", "component"), "component", hot_values(labels.select("component"), vertices), "left").select("vertex", F.coalesce("p", "component").alias("component")))
        one = join_hot(live, hooks.withColumnRenamed("v", "x"), "x", hot).select(F.col("p").alias("x"), "y")
        two = join_hot(one, hooks.select(F.col("v").alias("y"), F.col("p").alias("q")), "y", hot).select("x", F.col("q").alias("y")).where("x <> y")
        live = cut(two.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
        n, turn = live.count(), turn + 1
    if n:
        left = cut(_finished(live)).select(F.col("v").alias("component"), "root")
        labels = cut(join_hot(labels, left, "component", hot_values(labels.select("component"), vertices), "left").select("vertex", F.coalesce("root", "component").alias("component")))
    names = labels.groupBy("component").agg(F.min("vertex").alias("name"))
    return join_hot(labels, names, "component", hot_values(labels.select("component"), vertices)).select("vertex", F.col("name").alias("component"))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches by links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
