"""Elkan's clustering against plain Lloyd iterations in whole numbers."""

import hashlib
import math

import numpy as np

from netquarry.llm import elkan


def lloyd(rows, dim, scale, k, rounds):
    kept = [(i, [math.floor(scale * float(v)) for v in x]) for i, x in rows if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [x for _, x in seeds]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    nearest = lambda x: min((far(x, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        member = [nearest(x)[1] for _, x in kept]
        for j in range(len(centroids)):
            if mine := [x for (_, x), m in zip(kept, member) if m == j]:
                centroids[j] = [sum(column) // len(mine) for column in zip(*mine)]
    found = [(i, *nearest(x)[::-1]) for i, x in kept]
    total = lambda c=None: sum(d for _, j, d in found if c in (None, j))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, total(j), total(), sha[j]) for i, j, d in found), key=repr)


def test_equals_plain_rounds_with_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(elkan, "BLOCK", 37)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(9, 4))
    rows = [(i, [float(np.float32(v)) for v in centres[rng.integers(9)] + rng.normal(scale=0.4, size=4)]) for i in range(300)]
    rows += [(300 + i, [float(v) for v in rng.integers(-2, 3, 4)]) for i in range(120)]  # many ties at a scale of 1
    rows += [(1, rows[1][1]), (1, rows[2][1]), (-7, [0.5] * 4), (None, [0.25] * 4), (500, None), (501, [1.0] * 3), (502, [math.nan] * 4), (503, [math.inf] * 4), (504, [None, 1.0, 1.0, 1.0]), (505, [])]
    frame = spark.createDataFrame([(i, x, "clash", 1) for i, x in rows], "vec_id long, embedding array<double>, cluster string, id int").repartition(3)
    for scale, k, rounds in ((1024.0, 8, 10), (1.0, 8, 4), (1.0, 3, 0), (16.0, 600, 2)):
        found = elkan.cluster(frame, "vec_id", "embedding", dim=4, scale=scale, k=k, rounds=rounds)
        assert found.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted((tuple(r) for r in found.collect()), key=repr) == lloyd(rows, 4, scale, k, rounds)


def test_no_usable_vector_gives_no_rows(spark):
    frame = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    assert elkan.cluster(frame, "vec_id", "embedding", dim=4).collect() == []
    assert elkan.cluster(frame.limit(0), "vec_id", "embedding", dim=1).collect() == []
    assert [tuple(r)[:5] for r in elkan.cluster(frame, "vec_id", "embedding", dim=1).collect()] == [(2, 0, 0, 0, 0)]


def test_bounds_hold_and_skip_distances():
    rng = np.random.default_rng(9)
    centres = rng.integers(-3000, 3000, (8, 16))
    x = (centres[rng.integers(8, size=2000)] + rng.integers(-200, 200, (2000, 16))).astype(np.int32)
    before = x[rng.choice(2000, 8, replace=False)].astype(np.int64)
    cluster, distance, upper, lower = elkan.first_bounds(x, before)
    spent = 0
    for _ in range(8):
        now = np.stack([x[cluster == j].sum(0) // max(1, (cluster == j).sum()) if (cluster == j).any() else before[j] for j in range(8)]).astype(np.int64)
        cluster, distance, upper, lower, measured = elkan.moved_bounds(x, before, now, cluster, upper, lower)
        exact = np.stack([elkan.squared(x, c) for c in now], 1)
        assert (cluster == exact.argmin(1)).all()
        assert ((distance < 0) | (distance == exact.min(1))).all()
        assert (upper >= np.sqrt(exact.min(1))).all() and (lower <= np.sqrt(exact)).all()
        before, spent = now, spent + measured
    assert spent < 0.3 * 8 * 2000 * 8
