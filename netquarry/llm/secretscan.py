"""Secret scans: fixed patterns plus zstandard novelty primed with dictionaries.

Three patterns are always reported, leftmost and non-overlapping for each kind:
`assign` (a credential name, a separator and a value of 12 or more characters),
`access` (an access key id of 18 or more) and `hex` (16 or more hex digits).

Novelty: a candidate is a long string without spaces that stands within
REACH characters of a sensitive word, before or after it and across line breaks,
or in a private key's PEM block, or with no letter or digit between behind a
reported candidate; those inside the spans above are left to them. A zstandard compressor is primed with a dictionary of identifiers and
common words. A candidate is measured in pieces of PIECE characters; a piece's
marginal bytes are what PROSE and the surrounding text (CONTEXT characters either
side, without any candidate-like string, so that keys, neighbours and copies do
not hide each other) cost more with the piece behind them. Names and words repeat
parts of the dictionary or of their surroundings and are cheap; a candidate is
reported as `novel` if a piece costs NOVEL or more of the bits of as many random
characters of the candidate's own alphabet. Without digits, its long runs of
letters are measured, save camel-case names of HUMP or more letters a word. A
long word unknown to the dictionary can cost as much as a random one.

Cases: null and empty texts have no spans. Texts of any length are searched
whole; memory is bounded by a batch. Each row is searched alone, so repeated rows
give the same spans; extra columns are carried by redact() and otherwise ignored.
Offsets are code points, end exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbytes import slices

KINDS = ("assign", "access", "hex", "novel")
REACH = 40
CONTEXT = 512
NOVEL = 1.0
SHORTEST = 16
PIECE = 32
HUMP = 5.5
SLICE_BYTES = 4 << 20

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
SENSITIVE = re.compile(r"password|passwd|pwd|secret|token|api.?key|credential|bearer|private|auth|signature|access.?key", re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~-]{%d,}" % SHORTEST)
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----(.*?)(?:-----END \1-----|\Z)", re.DOTALL)
PEM_LINE = re.compile(r"^[A-Za-z0-9+/]+=*(?=[\x20\t\r]*$)", re.MULTILINE)
ALNUM, DIGIT = re.compile(r"[A-Za-z0-9]"), re.compile(r"[0-9]")
LETTERS = re.compile(r"[A-Za-z]{%d,}" % SHORTEST)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
LETTER = re.compile(r"[A-Za-z]")
CLASSES = ((re.compile(r"[a-z]"), 26), (re.compile(r"[A-Z]"), 26), (re.compile(r"[0-9]"), 10), (re.compile(r"[+/_=~-]"), 2))
_HINTS = ("passw", "secret", "token", "api", "pwd", "credential", "bearer", "private", "auth", "signature", "access")

IDENTIFIERS = " ".join(
    f"{a}_{b} {a.title()}{b.title()} {a.upper()}_{b.upper()}"
    for a in "get set user session client server config request response database account service auth private public access refresh default".split()
    for b in "key token secret password name value id path url type data list count string index header file index code".split()
) + " ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 https://www.example.com/index.html import return class function const export"

WORDS = (
    "about above abstract accept access account action active address administration after again agent allow alpha always amount analysis another answer "
    "apply approach archive argument around array article assert assign async attempt attribute audio average background backup balance bandwidth base "
    "batch because before behavior being below benchmark besteffort between binary block body border both bottom branch broker browser buffer build bundle "
    "business button bytes cache call cannot capability capture case catalog category center certificate chain change channel character check child choose "
    "class clean click clock close cloud cluster color column command comment commit common communication community company compact compare compile "
    "complete component compress compute concept condition config connect connection constant construct consumer contact container content context control "
    "convert copy core correct cost could country course cover create credential current custom cycle daily damage database date debug decision decode "
    "decrypt define delete delivery density deploy depth describe design destination detail detect develop device dialog dictionary different digest direct "
    "directory disable discover dispatch display distance distribution document does domain download draw driver duplicate duration dynamic each early edit "
    "education effect element empty enable encode encrypt engine enough ensure enter entity entry environment error establish even event every example "
    "except exception exchange execute exist expect experience export express extend external extract factory failed failure family fast feature fetch "
    "field filter final find finish first fixed flag float flow flush folder follow force foreign form format forward found fragment frame free friend from "
    "front full future gateway general generate global good government graph great group growth handle handler handshake hardware hash have health height "
    "hello help hidden high history home host hour house http human icon idea identity image implement import important include increase independent "
    "infrastructure initial inner input insert inside install instance instead instruction integer interest interface internal international interrupt "
    "interval into invalid inventory invoice issue item iterator java join journal json keep kernel keyboard kind know kubelet kubepods label language "
    "large last latency later launch layer layout leader learn left length letter level library license life light limit line linear link linux listen live "
    "load local location lock logger login logout long lookup loop machine main make manager manifest many map margin market master match material matrix "
    "maximum mean measure media member memory menu merge message meta method metric middle minimum missing mobile mode model modify module moment money "
    "monitor month more most mount mouse move multiple music mutable native nature need nested network never next node normal notification nothing notice "
    "number object observe office offline offset online only open operation operator option oracle order organization origin other outer output over "
    "overflow owner package packet padding page panel parallel parameter parent parse partition party pass patch pattern payload payment people percent "
    "perform period permission person phone picture pixel place plan platform player please plugin point policy pool popular port position possible post "
    "power prefix prepare present preserve preview previous price primary principal print priority privilege problem process product production profile "
    "program progress project promise property protocol provide provider proxy public publish purchase push quality quantity query question queue quick "
    "random range rate reader ready really reason receive received recent record recover redirect reduce reference region register regular reject related "
    "relation release reload remote remove render repeat replace replica report repository represent require research reserve reset resize resolve resource "
    "restart restore restrict restricted result retry return review right role rollback root rotate round route router runtime safe sample sandbox save "
    "scale schedule schema school science scope score screen script scroll scrollbar search second section secure security segment select self sender "
    "sensor separate sequence serial series service setting setup several shadow shape share shell shift short should show shutdown side signal simple "
    "single size skip sleep slot small snapshot social socket soft software solution some sort sound source space spawn special speed split stack staff "
    "stage standard start state statement static station status step still stop storage store story stream street strict strong structure student style "
    "submit subscribe success such suffix summary supply support surface suspend switch symbol sync syntax system table target task team technology "
    "template temporary terminal test text than that their them theme then there these they thing think this thread threshold through throw ticket time "
    "timeout timestamp title today together toggle tool topic total touch trace track trade traffic train transaction transfer transform transition "
    "translate transport travel tree trigger true trust tunnel type under understand union unique unit universal unknown unlock until update upgrade upload "
    "usage valid validate value variable vector vendor verify version vertical video view virtual visible visit volume wait warning watch water wave "
    "website week weight welcome well were what wheel when where which while white whole wide width will window wireless with within without word work "
    "worker world would wrap write writer wrong year young your zone ness less ment able ible ation ization ingly ously ously istic ification ability "
    "iveness logical graphy meter counter over under inter trans super mis dis anti "
)
# Plain text whose letters set the price of a letter, however short the text around a candidate is.
PROSE = (
    "It was nearly nine when Jack and Zoe left the quay, having fixed both broken oars; we joked that every voyage so far began with a quarrel. "
    "On 4 March 1987, 26 boats of 30 came home, and by 5 o'clock the wind blew from the north again. Who would go out now? Perhaps Xavier, or Vic. "
    "Look up how much rope we keep: about 150 yards, half of it old. Give me those dull hooks, the pump, a cup of milk and some figs, please! "
)


def base_spans(text: str, lower: str) -> list[tuple[int, str]]:
    """(start, end, kind rank) of the fixed patterns."""
    found = []
    if "passw" in lower or "secret" in lower or "token" in lower or "api" in lower:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def alphabet(value: str) -> int:
    """How many characters value's kind of string is drawn from: hex digits of one case, or the classes it holds."""
    if HEX_ONLY.fullmatch(value):
        return 16 if LETTER.search(value) else 10
    return sum(n for kind, n in CLASSES if kind.search(value))


class Novelty:
    def __init__(self) -> None:
        primer = zstandard.ZstdCompressionDict((WORDS + IDENTIFIERS).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        parameters = zstandard.ZstdCompressionParameters.from_level(19, source_size=4 * CONTEXT, dict_size=len(WORDS + IDENTIFIERS), window_log=15, write_content_size=False)
        self.compressor = zstandard.ZstdCompressor(dict_data=primer, compression_params=parameters)

    def size(self, text: str) -> int:
        return len(self.compressor.compress((PROSE + text).encode("utf-8", "replace")))

    def novel(self, around: str, value: str) -> bool:
        """Whether any PIECE of value costs NOVEL or more of what a random string over its alphabet does."""
        plain, bits = self.size(around), max(1.0, math.log2(alphabet(value)))
        starts = [*range(0, len(value) - PIECE, PIECE), max(0, len(value) - PIECE)]
        for piece in dict.fromkeys(value[k : k + PIECE] for k in starts):  # each distinct piece once
            if 8 * (self.size(around + piece) - plain) >= NOVEL * bits * len(piece):
                return True
        return False

    def spans(self, text: str, taken: list[tuple]) -> list[tuple]:
        words = [m.span() for m in SENSITIVE.finditer(text)]
        if not words:
            return []
        blocks = [m.span(2) for m in PEM.finditer(text)]
        near = merged([(max(0, s - REACH), e + REACH) for s, e in words] + blocks)
        covered = merged([(s, e) for s, e, _ in taken])
        rest = at = None
        found: list[tuple] = []
        for m in CANDIDATE.finditer(text):
            chained = bool(found) and m.start() - found[-1][1] <= REACH and not ALNUM.search(text, found[-1][1], m.start())
            if not chained and not touching(near, m.start(), m.end()):
                continue
            for s, e in values(text, m.start(), m.end()):
                if any(a <= s and e <= b for a, b in touching(covered, s, e)):
                    continue
                if rest is None:
                    rest, at = without_candidates(text)
                k = at(m.start())
                if self.novel(rest[max(0, k - CONTEXT) : k + CONTEXT], text[s:e]):
                    found.append((s, e, 3))
        for s, e in blocks:  # a key's short last line belongs to it
            if any(s <= x[0] < e for x in found):
                seen = {x[0] for x in found}
                found += [(*m.span(), 3) for m in PEM_LINE.finditer(text, s, e) if m.start() not in seen]
        return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def touching(spans: list[tuple[int, int]], s: int, e: int) -> list[tuple[int, int]]:
    """Those of disjoint sorted spans that touch s:e."""
    k = bisect_left(spans, s, key=lambda x: x[1])
    upto = bisect_right(spans, e, key=lambda x: x[0])
    return spans[k:upto]


def values(text: str, s: int, e: int) -> list[tuple[int, int]]:
    """What to measure of a candidate: behind a sensitive name and its separator; without digits, its parts that are no names in camel case."""
    value = text[s:e]
    digits = DIGIT.search(value)
    for word in SENSITIVE.finditer(value):
        if not (digits and digits.start() < word.end()) and (not digits or value[word.end() : word.end() + 1] in tuple("+/_=~-")):
            s = e - len(value) + word.end()
    if digits:
        return [(s, e)] if e - s >= SHORTEST else []
    parts = [m.span() for m in LETTERS.finditer(text, s, e)]
    return [(x, y) for x, y in parts if len(humps := CAMEL.split(text[x:y])) == 1 or (y - x) / len(humps) < HUMP]


def without_candidates(text: str) -> tuple[str, Callable[[int], int]]:
    """text with each candidate-like string, sensitive or not, taken out; and the place there of an offset of text."""
    kept, begins, places, upto, n = [], [], [], 0, 0
    for m in CANDIDATE.finditer(text):
        kept.append(text[upto : m.start()])
        n += m.start() - upto
        upto = m.end()
        begins.append(m.start())
        places.append(n)
    kept.append(text[upto:])
    return "".join(kept), lambda s: places[bisect_right(begins, s) - 1]


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
SPANS = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def _found(texts: pa.Array) -> pa.Array:
    novelty, out = Novelty(), []
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    for lo, hi in slices(np.concatenate([[0], np.cumsum(sizes)]), SLICE_BYTES):
        for text in texts[lo:hi].to_pylist():
            spans: list[tuple] = []
            if text:
                lower = text.lower()
                spans = base_spans(text, lower)
                if any(h in lower for h in _HINTS):
                    spans = sorted(spans + novelty.spans(text, spans), key=lambda s: (s[0], s[2]))
            out.append([{"kind": KINDS[k], "start": s, "end": e, "value": text[s:e]} for s, e, k in spans])
    return pa.array(out, _SPAN)


def scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, spans) with every span's kind, offsets and value, ordered by start and kind."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), _found(batch.column(1))], ["key", "spans"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(search, f"key long, spans {SPANS}")


def digest(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str, mask: str = "[REDACTED]") -> DataFrame:
    """docs with every span of text replaced; overlapping spans become one mask."""
    names = docs.columns
    at = names.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            given = texts.to_pylist()
            changed = []
            for value, spans in zip(given, _found(texts).to_pylist()):
                if spans:
                    parts, upto = [], 0
                    for s in spans:
                        if s["start"] >= upto:
                            parts += [value[upto : s["start"]], mask]
                        upto = max(upto, s["end"])
                    value = "".join([*parts, value[upto:]])
                changed.append(value)
            columns = list(batch.columns)
            columns[at] = pa.array(changed, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(clean, docs.schema)
