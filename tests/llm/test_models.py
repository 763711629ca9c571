"""Trained operators: held-out accuracy, gradients, exact base scores and defined results for odd rows."""

import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netquarry.llm import hpylm, langid, quality, shared, toxicity
from netquarry.llm.textbytes import distinct, utf8

RNG = np.random.default_rng(4)
STEMS = {"en": ["the", "ing", "er", "th", "wh", "ou"], "de": ["sch", "ung", "ü", "keit", "der", "tz"], "es": ["ción", "mente", "ñ", "os", "ll", "que"]}


def prose(lang, n, rng=RNG):
    return " ".join("".join(rng.choice(STEMS[lang], rng.integers(1, 4))) for _ in range(n))


def test_language_is_found_on_held_out_texts(spark):
    rows = [(k, prose(lang, int(RNG.integers(5, 60))), lang) for k, lang in enumerate(list(STEMS) * 60)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    samples = langid.sample_windows(docs.where("doc_id < 120"), "lang", "text", per_lang=100, windows=3)
    net = langid.train(samples, steps=150)
    odd = spark.createDataFrame([(900, None, None, "x"), (901, "", None, "x"), (902, "12 34!", None, "x"), (903, prose("de", 9000), None, "x")], docs.schema)
    found = {r["key"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs.unionByName(odd), net, "doc_id", "text").collect()}
    assert np.mean([found[k][0] == lang for k, _, lang in rows[120:]]) > 0.95
    assert found[900] == found[901] == found[902] == ("und", 0.0) and found[903][0] == "de"
    assert {r["lang_pred"] for r in langid.identify(docs, None, "doc_id", "text").collect()} == {"und"}
    assert langid.identify(docs.limit(0), net, "doc_id", "text").collect() == []


def test_backpropagation_through_time_matches_differences():
    net = langid.train([("a", b"abcdef"), ("b", b"xyzxyz")], hidden=3, steps=1)
    for k in "xuvc":
        setattr(net, k, getattr(net, k).astype(np.float64))
    w = np.array([[97, 98], [120, 121], [99, 122]])

    def loss():
        return sum(-math.log(p) for p in net.probabilities(net.states(w))[:, 0, :].ravel())

    states = net.states(w)
    d = net.probabilities(states)
    d[:, 0, :] -= 1
    gx, gu = langid._backward(net, w, states, np.matmul(net.v.T, d))
    for grad, name, at in ((gu, "u", (0, 4, 1)), (gu, "u", (1, 7, 2)), (gx, "x", (0, 1, 97)), (gx, "x", (1, 8, 122))):
        value = getattr(net, name)
        value[at] += 1e-2
        up = loss()
        value[at] -= 2e-2
        down = loss()
        value[at] += 1e-2
        assert abs((up - down) / 2e-2 - grad[at]) < 2e-2 * max(1, abs(grad[at]))


def test_toxic_misspellings_are_found(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(300):
        text = prose("en", int(rng.integers(8, 80)), rng).split()
        if k % 3 == 0:
            text[int(rng.integers(len(text)))] = "idiot" + rng.choice(["", "s", "ic", "isch", "!"]) if k % 2 else "sc" + "um" * int(rng.integers(1, 3))
        rows.append((k, " ".join(text), int(k % 3 == 0)))
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows] + [(900, None, "x"), (901, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows if k < 200], "doc_id long, toxic int")
    model = toxicity.train(*toxicity.sample_labelled(docs, labels, "doc_id", "text", "toxic", zeros=200, ones=200))
    found = {r["key"]: r for r in toxicity.score(docs, model, "doc_id", "text").collect()}
    assert np.mean([found[k]["predicted"] == y for k, _, y in rows[200:]]) > 0.93
    assert found[900]["predicted"] == found[901]["predicted"] == 0 and 0 < found[900]["score"] < 1
    kept = {r["doc_id"] for r in toxicity.keep_clean(docs, model, "text").collect()}
    assert kept == {k for k, r in found.items() if not r["predicted"]}
    assert {r["score"] for r in toxicity.score(docs, None, "doc_id", "text").collect()} == {0.0}


def test_long_labelled_texts_leave_no_row_out(spark):
    rng = np.random.default_rng(12)
    rows = []
    for k in range(60):
        text = prose("en", 4000 if k % 10 < 2 else 30, rng).split()
        if k % 2:
            text[:: len(text) // 4] = ["idiot"] * len(text[:: len(text) // 4])
        rows.append((k, " ".join(text), k % 2))
    rows.append((60, "x" * 300_000, 0))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    whole, _ = toxicity.sample_labelled(docs, labels, "doc_id", "text", "toxic", 100, 100)
    assert sorted(whole) == sorted(t for _, t, _ in rows)
    texts, ys = toxicity.sample_labelled(docs, labels, "doc_id", "text", "toxic", 100, 100, most_bytes=100_000)
    assert (ys.count(0), ys.count(1)) == (31, 30) and 80_000 < sum(len(t.encode()) for t in texts) <= 100_000
    assert {t for _, t, _ in rows if len(t) < 1000} <= set(texts)
    inner = {w for t in texts if len(t) > 1000 for w in t.split() if len(w) <= 64}
    assert inner <= {w for _, t, _ in rows for w in t.split()}
    model = toxicity.train(texts, ys)
    found = {r["key"]: r["predicted"] for r in toxicity.score(docs, model, "doc_id", "text").collect()}
    assert np.mean([found[k] == y for k, _, y in rows]) > 0.93
    # of one class only there is nothing to tell apart: no model, score 0, nothing rejected
    odd = docs.where("doc_id % 2 = 1")
    texts, ys = toxicity.sample_labelled(odd, labels, "doc_id", "text", "toxic", 100, 100)
    assert (len(texts), set(ys)) == (30, {1}) and toxicity.train(texts, ys) is None
    assert {r["score"] for r in toxicity.score(odd, None, "doc_id", "text").collect()} == {0.0}
    assert toxicity.keep_clean(odd, None, "text").count() == 30


def test_copies_of_a_page_and_many_labels_leave_languages_their_texts(spark):
    rng = np.random.default_rng(3)
    rows = [("xx", "one page " * 40)] * 5000 + [("xx", prose("en", 40, rng)) for _ in range(60)] + [("yy", prose("de", 40, rng)) for _ in range(300)] + [(f"l{k:04}", f"word{k} here") for k in range(1200)]
    found = langid.sample_windows(spark.createDataFrame(rows, "lang string, text string"), "lang", "text", per_lang=500, windows=4, most_langs=50)
    by = {lang: [w for name, w in found if name == lang] for lang, _ in found}
    assert len(by) == 50 and len(by["xx"]) == 4 * 61 and len(by["yy"]) == 4 * 300
    assert sorted(set(by) - {"xx", "yy"}) == [f"l{k:04}" for k in range(48)]
    none = spark.createDataFrame([(None, "a"), ("xx", None), ("yy", "")], "lang string, text string")
    assert langid.sample_windows(none, "lang", "text", 5, 2) == []


def test_quality_keeps_good_and_shrinks_sparse_sites(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(400):
        bad = k % 4 == 0
        text = " ".join(["is"] * 40) if bad and k % 8 == 0 else prose("en", 40, rng)
        rows.append((k, text.replace(" ", "%%% ") if bad and k % 8 else text, int(not bad), "rare" if k == 399 else f"s{k % 5}"))
    docs = spark.createDataFrame([(k, t, s, 0.5) for k, t, _, s in rows] + [(900, None, None, None), (901, "", "s0", None)], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(k, y) for k, _, y, _ in rows if k % 2 == 0], "doc_id long, quality int")
    model = quality.train(docs, labels, "doc_id", "text", "quality")
    judged = {r["doc_id"]: r for r in quality.judge(docs.drop("score"), model, "text", F.col("source"), F.lit("p")).collect()}
    assert np.mean([judged[k]["kept"] == bool(y) for k, _, y, _ in rows]) > 0.97
    assert abs(judged[399]["host_mean"] - 0.75) < 0.2 and judged[900]["log_ratio"] == 0
    kept = quality.keep_good(docs, model, "text", F.col("source"), F.lit("p"))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in judged.items() if r["kept"]}
    assert quality.keep_good(docs.limit(0), None, "text", F.col("source"), F.lit("p")).collect() == []


def test_language_model_base_is_exact_and_pairs_help(spark):
    rng = np.random.default_rng(7)
    pairs = {"a": "b", "b": "c", "c": "d", "d": "a", "the": "cat", "cat": "sat", "sat": "the"}
    texts = []
    for _ in range(200):
        w = [str(rng.choice(list(pairs)))]
        while len(w) < 30:
            w.append(pairs[w[-1]] if rng.random() < 0.9 and w[-1] in pairs else f"w{int(rng.integers(80))}" if rng.random() < 0.3 else str(rng.choice(list(pairs))))
        texts.append(" ".join(w).upper() if rng.random() < 0.5 else "\n".join(w))
    texts += [None, "", "unseen words only", texts[0]]
    docs = spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(texts)], "doc_id long, text string, score double")
    found = {r["key"]: r for r in hpylm.score(docs, "doc_id", "text", F.col("doc_id") % 5 != 0).collect()}
    tokens = lambda t: [*re.findall("[^\x20\x09-\x0D]+", (t or "").lower()), None]
    seen = Counter(x for k, t in enumerate(texts) if k % 5 for x in tokens(t))
    total, distinct = sum(seen.values()), len(seen)
    assert len(found) == len(texts)
    for k, t in enumerate(texts):
        r = found[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens(t)), sum(seen[x] > 0 for x in tokens(t)), total)
        assert math.isclose(r["base_score"], sum(math.log10((seen[x] + 1) / (total + distinct + 1)) for x in tokens(t)), rel_tol=1e-9)
    held = [k for k in range(0, 200, 5)]
    assert sum(found[k]["score"] for k in held) > 0.75 * sum(found[k]["base_score"] for k in held)


def test_hot_words_have_one_restaurant_over_all_parts(spark, monkeypatch):
    monkeypatch.setattr(hpylm, "PART_TOKENS", 64)
    texts = [(f"b{k} the {'cat' if k % 3 else 'dog'}", True) for k in range(300)] + [(f"z{k} the cat", False) for k in range(40)]
    docs = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "doc_id long, text string, train boolean")
    scores = [r["score"] for r in hpylm.score(docs, "doc_id", "text", F.col("train")).collect() if r["key"] >= 300]
    # new words before it leave the restaurant of "the" alone to say how likely "cat" is, whatever part they fall into
    assert len(scores) == 40 and np.ptp(scores) < 1e-9


def test_language_model_leaves_only_what_its_last_pass_reads(spark):
    folders = lambda: set(Path(shared.folder(spark).removeprefix("file:")).glob("cut-*"))
    before, texts = folders(), [f"the cat number {k % 7} sat {k} times" for k in range(200)]
    out = hpylm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", F.col("doc_id") % 5 != 0)
    assert len(folders() - before) == 1  # of six
    assert out.count() == out.where("score < 0").count() == 200
    rng = np.random.default_rng(2)
    rows = np.sort(rng.choice(2500, 2000, replace=False)).astype(np.uint16)
    sums = [rows, *(np.rint(-rng.random(2000) * 40 * hpylm.UNIT) for _ in range(2)), rng.integers(0, 9, 2000)]
    blob = hpylm._sums(*sums)
    assert all((a == b).all() for a, b in zip(hpylm._of_sums(blob), sums))
    assert len(blob) < 14 * 2000  # 22 bytes a row as doubles


def test_stirling_numbers_and_tables():
    d = 0.6
    s = np.exp(hpylm.stirling(d))
    assert np.allclose(s[3, 1:4], [(1 - d) * (2 - d), 3 * (1 - d), 1])
    draws = hpylm.sample_tables(np.random.default_rng(1), hpylm.stirling(d), d, np.full(20_000, 3), np.full(20_000, 2.0), np.full(20_000, 0.3))
    weight = np.array([s[3, t] * 0.3**t * np.prod([2.0 + d * i for i in range(t)]) for t in (1, 2, 3)])
    assert np.allclose(np.bincount(draws, minlength=4)[1:] / 20_000, weight / weight.sum(), atol=0.02)


def test_features_of_whole_texts():
    data, offsets = utf8(pa.array(["", "a a a a", "AB%% cd"]))
    x = quality.features(data, offsets) ** 2
    assert x[0].sum() == 0 and abs(x[1][3] - 0.75) < 1e-9 and abs(x[2][0] - 2 / 7) < 1e-9


def test_distinct_numbers_with_and_without_room_for_places():
    rng = np.random.default_rng(6)
    few = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    alike = (few[:, None] << np.uint64(1) | np.arange(2, dtype=np.uint64)).ravel()  # apart in the lowest bit only
    for x in (few[:0], few[:1], few, rng.choice(few, 3000), rng.choice(few >> np.uint64(30), 3000), rng.choice(alike, 3000)):
        assert all((a == b).all() for a, b in zip(distinct(x), np.unique(x, return_inverse=True)))
