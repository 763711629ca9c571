"""SentencePiece encoding and decoding as a relational lattice.

Encoding: a text's blanks become U+2581, one more stands before it, and it is
split into words where U+2581 follows another character (no piece has it later
than at its start). Every distinct word is explode()d into substrings no longer
than the longest piece, which an equi-join to the piece table turns into lattice
edges; the edges are grouped by word and a higher-order aggregate() folds them to
the word's pieces:

* `unigram` models: Viterbi. Position by position, the best score and the edge
  that gave it.
* `bpe` models: their scores rank merges and a best sum of them is not what such a
  model means, so the fold takes the best-scored edge that joins two neighbouring
  segments, the leftmost of equals, until none is left.

Characters without a piece become byte pieces. The words' ids are joined back to
their places. Words over LONG characters, whose fold would grow with the cube of
their length, are merged by the same rule in a task with a heap (`bpe`), or by
the same Viterbi in a task.

Decoding: each id's bytes from the piece table, joined and read as UTF-8.

Cases: null and empty texts have no pieces and decode to the empty text. Repeated
rows and keys are encoded each. Extra columns are ignored; the key columns may
have any names. An empty table gives no row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

BLANK = "▁"
LONG = 32
UNKNOWN_PENALTY = 10.0


@dataclass
class Pieces:
    """A piece table: pieces[id] with its score, the id of the byte piece 0, and the model's kind."""

    pieces: list[str]
    scores: list[float]
    byte_base: int
    kind: str

    @classmethod
    def load(cls, path: str) -> Pieces:
        """The table of a `bpe` or `unigram` model file with byte fallback and without normalisation; control, unknown and byte pieces are no lattice edges. Other files are an error."""
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            fields = _fields(file.read())
        kind = {1: "unigram", 2: "bpe"}.get(_fields(fields.get(2, b"")).get(3, 1))
        if kind is None or _fields(fields.get(3, b"")).get(2):
            raise ValueError(f"{path} is no bpe or unigram model, or normalises texts")
        if model.piece_to_id("<0x00>") == model.unk_id():
            raise ValueError(f"{path} has no byte pieces")
        n = model.get_piece_size()
        return cls([model.id_to_piece(k) for k in range(n)], [model.get_score(k) for k in range(n)], model.piece_to_id("<0x00>"), kind)

    def plain(self) -> list[tuple[str, int, float]]:
        special = set(range(self.byte_base, self.byte_base + 256)) | set(range(self.byte_base))
        return [(p, k, s) for k, (p, s) in enumerate(zip(self.pieces, self.scores)) if k not in special]


def _fields(data: bytes) -> dict[int, int | bytes]:
    """The last value of each field of a protocol buffer message."""
    out: dict[int, int | bytes] = {}
    at = 0

    def varint() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            value, shift, at = value | (data[at] & 127) << shift, shift + 7, at + 1
            if data[at - 1] < 128:
                return value

    while at < len(data):
        tag = varint()
        size = {1: 8, 5: 4}.get(tag & 7)
        if tag & 7 == 0:
            out[tag >> 3] = varint()
            continue
        size = varint() if size is None else size
        out[tag >> 3] = data[at : at + size]
        at += size
    return out


def _words(text: Column) -> Column:
    return F.split(F.concat(F.lit(BLANK), F.translate(text, " ", BLANK)), f"(?<=[^{BLANK}])(?={BLANK})")


def _place(n: Column, longest: int, s: Column, e: Column) -> Column:
    """The place, from 1, of the span (s, e) among all spans up to `longest` of a word of n characters, ordered by s and e."""
    full = F.greatest(n - longest, F.lit(0))  # starts that have all lengths
    more = F.greatest(s - full, F.lit(0))
    return F.least(s, full) * longest + more * F.least(n, F.lit(longest)) - (more * (more - 1) / 2).cast("int") + (e - s)


def _merged(edges: Column, n: Column, longest: int) -> Column:
    """Cut positions left by merging from single characters."""

    def step(cuts: Column, _: Column) -> Column:
        def pair(k: Column) -> Column:
            s, e = F.element_at(cuts, k), F.element_at(cuts, k + 2)
            score = F.when(e - s <= longest, F.element_at(edges, _place(n, longest, s, e))["score"])
            return F.struct(score.alias("score"), (-s).alias("left"), e.alias("e"))

        pairs = F.transform(F.filter(F.sequence(F.lit(1), F.size(cuts)), lambda k: k <= F.size(cuts) - 2), pair)
        best = F.array_max(F.filter(pairs, lambda x: x["score"].isNotNull()))
        # in an array of one, so that it is found once and not for every cut
        return F.transform(F.array(best), lambda b: F.when(b.isNull(), cuts).otherwise(F.filter(cuts, lambda c: (c <= -b["left"]) | (c >= b["e"]))))[0]

    return F.when(n >= 2, F.aggregate(F.sequence(F.lit(1), n - 1), F.sequence(F.lit(0), n), step)).otherwise(F.sequence(F.lit(0), n))


def _viterbi(edges: Column, n: Column, longest: int, floor: float) -> Column:
    """Cut positions of the path with the best sum of scores; a character without a piece costs `floor`."""

    def step(best: Column, at: Column) -> Column:
        starts = F.sequence(F.greatest(at - longest, F.lit(0)), at - 1)
        known = F.transform(starts, lambda s: F.struct((F.element_at(best, s + 1)["score"] + F.element_at(edges, _place(n, longest, s, at))["score"]).alias("score"), s.alias("back")))
        other = F.struct((F.element_at(best, at)["score"] + floor).alias("score"), (at - 1).alias("back"))
        return F.concat(best, F.array(F.array_max(F.concat(F.filter(known, lambda x: x["score"].isNotNull()), F.array(other)))))

    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back")))
    path = F.aggregate(F.sequence(F.lit(1), n), start, step)
    walk = lambda cuts, _: F.when(cuts[0] > 0, F.concat(F.array(F.element_at(path, cuts[0] + 1)["back"]), cuts)).otherwise(cuts)
    return F.aggregate(F.sequence(F.lit(1), n), F.array(n), walk)


def _ids(word: Column, edges: Column, n: Column, cuts: Column, longest: int, byte_base: int) -> Column:
    def one(k: Column) -> Column:
        s, e = F.element_at(cuts, k), F.element_at(cuts, k + 1)
        held = F.element_at(edges, _place(n, longest, s, e))["id"]
        digits = F.hex(F.encode(F.substring(word, s + 1, e - s), "utf-8"))
        raw = F.transform(F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2)), lambda at: F.conv(F.substring(digits, at, F.lit(2)), 16, 10).cast("int") + byte_base)
        return F.when(held.isNotNull(), F.array(held)).otherwise(raw)

    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), one))


def _long_words(table: dict[str, tuple[int, float]], kind: str, byte_base: int, longest: int, floor: float) -> object:
    def merge(word: str) -> list[tuple[int, int]]:
        n = len(word)
        left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        end = list(range(1, n + 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int) -> None:
            if a >= 0 and right[a] < n and (hit := table.get(word[a : end[right[a]]])):
                heapq.heappush(heap, (-hit[1], a, right[a], end[right[a]]))

        for a in range(n):
            offer(a)
        while heap:
            _, a, b, e = heapq.heappop(heap)
            if alive[a] and b < n and alive[b] and right[a] == b and end[b] == e:
                alive[b], end[a], right[a] = False, e, right[b]
                if right[b] < n:
                    left[right[b]] = a
                offer(a)
                offer(left[a])
        return [(a, end[a]) for a in range(n) if alive[a]]

    def viterbi(word: str) -> list[tuple[int, int]]:
        best = [(0.0, 0)]
        for at in range(1, len(word) + 1):
            options = [(best[at - 1][0] + floor, at - 1)]
            options += [(best[s][0] + table[word[s:at]][1], s) for s in range(max(0, at - longest), at) if word[s:at] in table]
            best.append(max(options))
        out, at = [], len(word)
        while at:
            out.append((best[at][1], at))
            at = best[at][1]
        return out[::-1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cuts = merge if kind == "bpe" else viterbi
        for frame in frames:
            ids = []
            for word in frame["word"]:
                ids.append([k for s, e in cuts(word) for k in ([table[word[s:e]][0]] if word[s:e] in table else [b + byte_base for b in word[s:e].encode()])])
            yield pd.DataFrame({"word": frame["word"], "ids": ids})

    return run


def encode(texts: DataFrame, keys: list[str], text: str, model: Pieces) -> DataFrame:
    """The key columns of each row and its ids, array<int>. Key columns may have any names; one named `ids` comes back as `key_ids`."""
    spark = texts.sparkSession
    plain = model.plain()
    longest = max(len(p) for p, _, _ in plain)
    floor = min(s for _, _, s in plain) - UNKNOWN_PENALTY
    pieces = F.broadcast(spark.createDataFrame(plain, "piece string, id int, score double"))  # as many rows as the model has pieces
    rows = cut(texts.select(F.monotonically_increasing_id().alias("row"), F.struct(*keys).alias("keys"), F.col(text).alias("text")))
    places = rows.where(F.length("text") > 0).select("row", F.posexplode(_words(F.col("text"))).alias("place", "word"))
    distinct = places.select("word").distinct().withColumn("n", F.length("word"))
    short = distinct.where(F.col("n") <= LONG)
    starts = short.select("word", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s"))
    spans = starts.select("word", "n", "s", F.explode(F.sequence(F.col("s") + 1, F.least(F.col("n"), F.col("s") + longest))).alias("e"))
    edges = spans.withColumn("piece", F.substring("word", F.col("s") + 1, F.col("e") - F.col("s"))).join(pieces, "piece", "left")
    # every span, in order, so that the fold finds an edge by its place; a span that is no piece has a null id
    lattice = edges.groupBy("word", "n").agg(F.array_sort(F.collect_list(F.struct("s", "e", "score", "id"))).alias("edges"))
    cuts = _merged(F.col("edges"), F.col("n"), longest) if model.kind == "bpe" else _viterbi(F.col("edges"), F.col("n"), longest, floor)
    folded = lattice.withColumn("cuts", cuts).select("word", _ids(F.col("word"), F.col("edges"), F.col("n"), F.col("cuts"), longest, model.byte_base).alias("ids"))
    table = {p: (k, s) for p, k, s in plain}
    long = distinct.where(F.col("n") > LONG).select("word").mapInPandas(_long_words(table, model.kind, model.byte_base, longest, floor), "word string, ids array<int>")
    words = cut(folded.unionByName(long))
    found = places.join(words, "word").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "ids"))).alias("w"))
    whole = found.select("row", F.flatten(F.transform("w", lambda x: x["ids"])).alias("ids"))
    named = [F.col("keys")[k].alias(f"key_{k}" if k == "ids" else k) for k in keys]
    return rows.select("row", "keys").join(whole, "row", "left").select(*named, F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def decode(encoded: DataFrame, ids: str, model: Pieces) -> Column:
    """The text of a column of ids."""
    base = model.byte_base
    digits = [f"{k - base:02X}" if base <= k < base + 256 else "" if k < base else p.encode().hex() for k, p in enumerate(model.pieces)]
    table = F.split(F.lit(",".join(digits)), ",")  # constant, folded once
    joined = F.array_join(F.transform(F.col(ids), lambda k: F.element_at(table, k + 1)), "")
    spaced = F.translate(F.decode(F.unhex(joined), "utf-8"), BLANK, " ")
    return F.when(F.size(ids) > 0, F.substring(spaced, 2, 2**31 - 2)).otherwise("")
