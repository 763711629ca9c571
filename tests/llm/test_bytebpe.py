"""Byte-level BPE against the tiktoken library on the same ranks."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from netquarry.llm import bytebpe

VOCABULARY = bytebpe.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={})
ENCODER = bytebpe.Encoder(VOCABULARY, bytebpe.PerfectHash(list(VOCABULARY.ranks)))


def test_perfect_hash_is_minimal_and_perfect():
    keys = list(VOCABULARY.ranks)
    assert sorted(ENCODER.hashed.find(keys).tolist()) == list(range(len(keys)))
    assert bytebpe.PerfectHash([]).find([b"x"]).tolist() == [-1]
    with pytest.raises(ValueError, match="repeat"):
        bytebpe.PerfectHash([b"a", b"a"])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("'' \t\n  strevmlld019.,!éßあ中🙂​́")), max_size=80))
def test_ids_equal_the_library(text):
    assert ENCODER.encode([text])[0].tolist() == LIBRARY.encode_ordinary(text)


def test_single_words_merge_like_the_library():
    rng = random.Random(3)
    for _ in range(400):
        word = "".join(rng.choices("aeiounrstlé", k=rng.randint(1, 40)))
        assert list(bytebpe.merge(word.encode(), VOCABULARY.ranks)) == LIBRARY.encode_ordinary(word)


def test_whole_texts_in_frames(spark, monkeypatch):
    monkeypatch.setattr(bytebpe, "PIECE", 50)
    rng = random.Random(5)
    words = ["that's", "Straße", "x" * 90, "12345", "!!", "\n\n", "  ", "\t", "naïve", "<|endoftext|>", "'ll", "中文字"]
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(0, 60))) for _ in range(120)] + ["", None, " " * 5000, "ab" * 4000, "a b " * 30000]
    rows = [(k % 100 if k % 7 else None, t, 5, "clash") for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, key int, ids string")
    found = bytebpe.encode(frame, "doc_id", "text", VOCABULARY).withColumn("back", bytebpe.decode(bytebpe.F.col("ids"), VOCABULARY)).collect()
    got = sorted(((r["key"], list(r["ids"]), bytes(r["back"])) for r in found), key=repr)
    assert got == sorted(((k, LIBRARY.encode_ordinary(t or ""), (t or "").encode()) for k, t, _, _ in rows), key=repr)
    assert bytebpe.encode(frame.limit(0), "doc_id", "text", VOCABULARY).collect() == []


def test_decoding_defines_nulls_and_unknown_ranks(spark):
    frame = spark.createDataFrame([(1, None), (2, []), (3, [10, 20])], "k int, ids array<int>")
    got = {r["k"]: r["b"] for r in frame.select("k", bytebpe.decode(frame["ids"], VOCABULARY).alias("b")).collect()}
    assert got == {1: None, 2: b"", 3: LIBRARY.decode_bytes([10, 20])}
    with pytest.raises(Exception, match="not in the vocabulary"):
        spark.createDataFrame([([999_999],)], "ids array<int>").select(bytebpe.decode(bytebpe.F.col("ids"), VOCABULARY)).collect()


def test_the_registered_query_digests_every_document(spark):
    from netquarry.llm import queries

    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, folder, "documents").collect()}
    found = {r["doc_id"]: r for r in queries.op12_byte_bpe(spark, folder).collect()}
    assert set(found) == set(docs)
    for k, text in docs.items():
        ids = LIBRARY.encode_ordinary(text)
        assert (found[k]["n_tokens"], found[k]["ids_sha256"], found[k]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
