"""Packing against direct tokenisation: every id once, gapless windows, little padding."""

from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from netquarry.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def packed(spark, rows, size=64, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, part int").repartition(parts)
    return packing.pack(docs, "doc_id", "text", PATH, size=size).collect()


def test_every_id_lies_in_one_piece_and_windows_have_no_gap(spark):
    rng = np.random.default_rng(0)
    words = ["the", " river", " Straße", "\n\n", " 42", " été", "   ", "x" * 30, "'s", " don't", "<|endoftext|>", " 漢字"]
    rows = [(i, "".join(rng.choice(words, int(rng.integers(0, 200)))), "clash", 1) for i in range(200)] + [(200, None, "", 0), (201, "", "", 0), (202, " river" * 3000, "", 0)]
    found = packed(spark, rows)
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for p in found:
        by_doc[p["key"]].append(p)
        by_window[p["sequence_id"]].append(p)
    for key, text, _, _ in rows:
        want = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by_doc[key], key=lambda p: p["start"])
        assert b"".join(bytes(p["ids"]) for p in pieces) == want.tobytes()
        assert [p["start"] for p in pieces] == [0, *np.cumsum([p["length"] for p in pieces])[:-1]]
        assert {p["doc_tokens"] for p in pieces} == {len(want)}
    total = 0
    for pieces in by_window.values():
        pieces.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in pieces] == [0, *np.cumsum([p["length"] for p in pieces])[:-1]]
        assert sum(p["length"] for p in pieces) <= 64
        total += sum(p["length"] for p in pieces)
    assert total / (64 * len(by_window)) > 0.9


def test_repeated_rows_and_an_empty_table(spark):
    found = packed(spark, [(1, "same text", "", 0)] * 5)
    assert sum(p["length"] for p in found) == 5 * 3
    assert packed(spark, []) == []


def test_end_markers_ties_and_long_texts_keep_the_ids_of_the_library(spark):
    tokenizer = Tokenizer.from_file(PATH)
    assert tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    rng = np.random.default_rng(3)
    bits = ["a", " b", "  ", "\n", "\t", "é", "\u3000", "\xa0", "'s", "42", "<|endoftext|>", " <|endoftext|>", "!", "漢", " \n\n "]
    encode = packing.Encoder(PATH)
    for _ in range(300):
        text = "".join(rng.choice(bits, int(rng.integers(0, 60))))
        assert "".join(packing.parts(text)) == text
        assert encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    found = packed(spark, [(k, "x" * 16, "", 0) for k in range(40)], parts=1)  # ties: equal lengths
    assert sorted(p["key"] for p in found if p["start"] == 0) == list(range(40))
    assert sum(p["length"] for p in found) == sum({p["key"]: p["doc_tokens"] for p in found}.values())


def test_a_run_of_blanks_is_encoded(spark):
    found = packed(spark, [(1, " " * 1_000_000, "", 0), (2, "\n" * 1_000_000 + "x", "", 0)], size=1024, parts=1)
    for key in (1, 2):
        pieces = [p for p in found if p["key"] == key]
        assert sum(p["length"] for p in pieces) == pieces[0]["doc_tokens"]


def test_parts_are_encoded_together():
    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    library, asked = encode.tokenizer, []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **options)

    encode.tokenizer = Counted()
    texts = [" ".join(f"w{n * k % 997}é," for n in range(500)) for k in range(1, 5)] + ["", " ", "a  b", " a", "a ", "a\n b\tc", "x\u00a0 y", "<|endoftext|> a<|endoftext|>", "z" * 200 + " " + "z" * 200]
    assert [packing.parts(t) for t in texts] == [packing._CUT.split(t) for t in texts]
    assert [list(ids) for ids in encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(asked) < 40 and max(map(len, encode.known)) <= packing.SHORT
    assert [list(ids) for ids in encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_an_encoder_remembers_no_more_parts_than_a_worker_can_hold():
    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for at in range(0, 300_000, 50_000):
        encode([" ".join(f"w{k}" for k in range(at, at + 50_000))])
    assert len(encode.known) <= 1 << 18


def test_an_encoder_remembers_what_comes_twice_and_marks_end_a_part(monkeypatch):
    library = Tokenizer.from_file(PATH)
    encode = packing.Encoder(PATH)
    texts = [" ".join(f"once{k}" for k in range(5000)), "twice, twice. 3.14 a.b,c é. .. 'x.'s x's. .\n a"]
    assert packing.parts(" twice, 3.14 é.") == [" twice", ",", " 3", ".14", " é."]
    assert [ids.tolist() for ids in encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(encode.known) < 50  # every first one was remembered before
    encode(texts)
    assert len(encode.known) > 5000
    # all parts of one hash: the bytes tell them apart
    monkeypatch.setattr(packing, "hashes", lambda data, s, e: np.zeros(len(s), np.uint64))
    encode = packing.Encoder(PATH)
    for _ in range(2):
        assert [ids.tolist() for ids in encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert encode([]) == [] and [len(x) for x in encode(["", "a", ""])] == [0, 1, 0]
