"""Top-k and near-duplicates of vectors against brute force."""

import math

import numpy as np

from netquarry.llm import neardup, topk
from netquarry.llm.neardup import quantise

from .test_jaccard import plain_components


def rows(seed, n=400, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    out = []
    for k in range(n):
        x = centres[rng.integers(12)] + rng.normal(scale=rng.choice([0.02, 0.2]), size=dim)
        out.append((k, [float(np.float32(v)) for v in x], int(rng.integers(3))))
    out += [(n, out[0][1], out[0][2]), (n + 1, out[0][1], out[0][2]), (n + 2, [v * 3 for v in out[1][1]], out[1][2]), (n + 3, [0.0] * dim, 1), (n + 4, None, 1), (n + 5, [math.nan] * dim, 1), (n + 6, [math.inf] + [0.0] * (dim - 1), 0), (n + 7, [None] + [1.0] * (dim - 1), 0), (n + 8, out[0][1], None), (n + 9, [1.0, 2.0], 1), (n + 10, [], 1)]
    return out


def usable(x):
    return x is not None and len(x) > 0 and all(v is not None and math.isfinite(v) for v in x)


def test_top_k_is_exact_with_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 64)
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "CHAIN", 3)
    data = rows(1)
    frame = spark.createDataFrame([(k, x, y, "clash") for k, x, y in data], "vec_id long, embedding array<float>, rank int, score string")
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(frame, "vec_id", "embedding", frame["vec_id"] % 20 == 0).collect()}
    whole = {k: [math.floor(256 * v) for v in map(np.float32, x)] for k, x, _ in data if usable(x)}
    want = {}
    for q in (k for k in whole if k % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), k) for k, v in whole.items() if k != q and len(v) == len(whole[q]))
        want |= {(q, i + 1): (k, -s) for i, (s, k) in enumerate(scored[:5])}
    assert found == want
    assert topk.top_k(frame.limit(0), "vec_id", "embedding", frame["vec_id"] % 20 == 0).collect() == []


def test_large_components_do_not_lose_digits(spark):
    data = [(0, [2.0**40, 1.0]), (1, [2.0**13, 3.0]), (2, [2.0**13, 4.0])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(frame, "vec_id", "embedding", frame["vec_id"] == 0, scale=1.0).orderBy("rank").collect()]
    assert got == [(2, 2**53 + 4), (1, 2**53 + 3)]


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 40)
    data = rows(2)
    frame = spark.createDataFrame([(k, x, y, 1) for k, x, y in data], "vec_id long, embedding array<float>, label int, n_links int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(frame, "vec_id", "embedding", "label").collect()}
    good = {k: (np.array([np.float32(v) for v in x], np.float64), y) for k, x, y in data if usable(x) and y is not None and any(x)}
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] / (np.linalg.norm(good[a][0]) * np.linalg.norm(good[b][0])) >= 0.93]
    component = plain_components([k for k, _, _ in data], links)
    assert found == {k: (sum(k in p for p in links), component[k]) for k, _, _ in data}
    assert len(links) > 100


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(3)
    u = rng.normal(size=(300, 24))
    u /= np.linalg.norm(u, axis=1)[:, None]
    q, s, length, lost = quantise(u)
    error = np.abs(u @ u.T - (q @ q.T) * s[:, None] * s[None, :])
    assert (error <= length[:, None] * lost[None, :] + lost[:, None] * (length + lost)[None, :] + 1e-12).all()


def test_one_id_at_two_vectors_counts_each_by_itself(spark):
    data = [(7, [1.0, 0.0], 1), (7, [0.0, 1.0], 1), (8, [1.0, 0.01], 1), (9, [1.0, -0.01], 1), (8, [1.0, 0.01], 1), (None, [1.0, 0.0], 1)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = sorted((tuple(r) for r in neardup.near_duplicates(frame, "vec_id", "embedding", "label").collect()), key=repr)
    assert got == sorted([(7, 3, 7), (7, 0, 7), (8, 3, 7), (8, 3, 7), (9, 3, 7), (None, 0, None)], key=repr)
    assert neardup.near_duplicates(frame.limit(0), "vec_id", "embedding", "label").collect() == []


def test_components_are_the_same_however_many_links_one_task_takes(spark, monkeypatch):
    from netquarry.llm import components

    rng = np.random.default_rng(6)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (160, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5, None), (3, 3)]
    frame = spark.createDataFrame(links, "a long, b long")
    want = plain_components({v for p in links if None not in p and p[0] != p[1] for v in p}, [p for p in links if None not in p])
    for few in (0, 20, 1 << 18):
        monkeypatch.setattr(components, "FEW", few)
        assert {r["vertex"]: r["component"] for r in components.connected_components(frame, "a", "b").collect()} == want
    assert components.connected_components(frame.limit(0), "a", "b").collect() == []
