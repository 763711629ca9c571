"""The Jaccard join against brute force, with copies, ties, nulls and clashing columns."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from netquarry.llm import jaccard
from netquarry.llm.components import connected_components
from netquarry.llm.textbytes import shingle_sets, utf8, words


def plain_words(text):
    return re.findall("[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_set(text, n):
    w = plain_words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def plain_components(keys, links):
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def brute(rows, n, percent):
    sets = {k: plain_set(t, n) for k, t in rows}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {k: len(s) for k, s in sets.items()}, plain_components(sets, links)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy).upper() if rng.random() < 0.2 else "\t".join(copy))
    base = [rng.choice(vocabulary) for _ in range(60)]  # a large group of near copies
    for k in range(70):
        copy = list(base)
        copy[rng.randrange(60)] = f"edit{k}"
        rows.append(" ".join(copy))
    rows += [None, "", "  \n", "one two", "ONE two ", "one", rows[0], rows[0], "ä Ä", "ä ä"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("n", "percent", "seed"), [(4, 85, 1), (5, 80, 2)])
def test_join_equals_brute_force(spark, n, percent, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(k, t, "clash", 1) for k, t in rows], "doc_id long, text string, component string, size int")
    found = {r["key"]: (r["size"], r["component"]) for r in jaccard.join(docs, "doc_id", "text", n, percent).collect()}
    sizes, component = brute(rows, n, percent)
    assert found == {k: (sizes[k], component[k]) for k, _ in rows}


def test_large_lists_and_clusters_are_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 8)
    monkeypatch.setattr(jaccard, "TILE_SIZE", 400)
    monkeypatch.setattr(jaccard, "HEAVY", 1.0)  # no n-gram is salted, so long lists alone have pivots
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["key"]: (r["size"], r["component"]) for r in jaccard.join(docs, "doc_id", "text", 5, 80).collect()}
    sizes, component = brute(rows, 5, 80)
    assert found == {k: (sizes[k], component[k]) for k, _ in rows}


def test_empty_table_and_repeated_keys(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join(docs, "doc_id", "text").collect() == []
    docs = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (9, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")
    assert sorted((r["key"] or 0, r["component"] or 0) for r in jaccard.join(docs, "doc_id", "text").collect())[1:] == [(5, 5), (5, 5), (9, 5)]


def test_words_and_shingles_are_those_of_the_rules():
    texts = ["A b\tc\nD e", "", " x ", "ÄB äb", "a" * 3_000_000 + " b c d", "one two three"]
    data, offsets = utf8(pa.array(texts))
    _, _, hashes, first = words(data, offsets)
    assert [b - a for a, b in zip(first, first[1:])] == [len(plain_words(t)) for t in texts]
    assert hashes[first[0] + 1] == hashes[first[4] + 1] and hashes[first[0]] != hashes[first[4]]
    assert [len(s) for s in shingle_sets(data, offsets, 4)] == [len(plain_set(t, 4)) for t in texts]
    many = " ".join(np.random.default_rng(1).choice(["p", "q", "rr"], 400_000))
    data, offsets = utf8(pa.array([many, many + " z"]))
    one, two = shingle_sets(data, offsets, 4)
    assert len(one) == len(plain_set(many, 4)) and len(np.setdiff1d(two, one)) == 1


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 200 + k) for k in range(30)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    rng.shuffle(links)
    found = {r["vertex"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    keys = {k for a, b in links if a != b for k in (a, b)}
    assert found == plain_components(keys, [p for p in links])
