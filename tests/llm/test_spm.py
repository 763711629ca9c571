"""Encoding against the sentencepiece library (bpe) and a brute-force search (unigram), and exact round trips."""

from itertools import combinations

import public_tokenizers
import pytest
import sentencepiece

from netquarry.llm import spm

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["a  b\n c", "  lead", "tail ", "x\ty", "é漢🙂z", "", " ", "<s> a", "hello<0x0A> worldwide straßenbahn", "unbelievable" * 9, "x" * 500, " " * 70, "internationalization of der Übergang, l'été\r\n", None, "tail "]


def test_bpe_ids_are_those_of_the_library_and_decode_back(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    model = spm.Pieces.load(PATH)
    rows = spark.createDataFrame([(k % 7, k, t, "clash") for k, t in enumerate(TEXTS)], "conv_id long, turn int, text string, ids string")
    found = spm.encode(rows, ["conv_id", "turn"], "text", model)
    got = {r["turn"]: r for r in found.withColumn("decoded", spm.decode(found, "ids", model)).collect()}
    assert len(got) == len(TEXTS)
    for k, text in enumerate(TEXTS):
        assert got[k]["ids"] == library.encode(text or ""), text
        assert got[k]["decoded"] == (text or "")
    assert spm.encode(rows.limit(0), ["turn"], "text", model).collect() == []


def test_unigram_paths_have_the_best_score(spark):
    pieces = ["<unk>"] + [f"<0x{b:02X}>" for b in range(256)] + ["▁", "a", "b", "ab", "▁a", "ba", "aba", "bab"]
    scores = [0.0] * 257 + [-2.0, -3.0, -3.1, -4.0, -3.5, -4.4, -5.0, -6.3]
    model = spm.Pieces(pieces, scores, 1, "unigram")
    table = {p: s for p, _, s in model.plain()}
    floor = min(table.values()) - spm.UNKNOWN_PENALTY
    words = ["abab", "babab", "aabbaa", "acab", "b", "ab" * 20]
    found = spm.encode(spark.createDataFrame([(w,) for w in words], "text string"), ["text"], "text", model)
    for r in found.collect():
        word = "▁" + r["text"]
        got = sum(scores[k] if not 1 <= k < 257 else floor for k in r["ids"])
        if len(word) < 12:
            paths = [[0, *c, len(word)] for n in range(len(word)) for c in combinations(range(1, len(word)), n)]
            totals = [sum(table.get(word[a:b], floor if b - a == 1 else -1e9) for a, b in zip(p, p[1:])) for p in paths]
            assert abs(got - max(totals)) < 1e-9
        assert "".join(chr(k - 1) if 1 <= k < 257 else pieces[k] for k in r["ids"]) == word


def test_a_key_named_ids_and_models_of_other_kinds(spark, tmp_path):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = spm.Pieces.load(path)
    frame = spark.createDataFrame([(1, "one two"), (2, None)], "ids long, text string")
    found = spm.encode(frame, ["ids"], "text", model)
    assert found.columns == ["key_ids", "ids"]
    assert {r["key_ids"]: r["t"] for r in found.select("key_ids", spm.decode(found, "ids", model).alias("t")).collect()} == {1: "one two", 2: ""}
    with open(path, "rb") as file:
        raw = file.read()
    assert model.kind == "bpe"
    trained = spm._fields(raw)[2]
    trainer = raw.index(trained) + trained.index(b"\x18\x02")  # the model type, bpe
    for kind, byte in ((None, b"\x03"), ("unigram", b"\x01")):
        other = tmp_path / f"{kind}.model"
        other.write_bytes(raw[: trainer + 1] + byte + raw[trainer + 2 :])
        if kind:
            assert spm.Pieces.load(str(other)).kind == kind
        else:
            with pytest.raises(ValueError, match="no bpe or unigram"):
                spm.Pieces.load(str(other))
