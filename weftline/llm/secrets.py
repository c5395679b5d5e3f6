"""Secret scans: patterns, and a guess-cost programme for values in credential context.

The guess cost of a value is the least, over all ways to cut it into spans, of the sum of
the spans' log10 guesses, where a span is a known word, a date, a repeat, a keyboard walk
or brute force. Values that stand where a credential is expected and take at least
``least`` (log10) guesses are reported beside the pattern matches.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import blocks, bounded, extended

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
#: Words after which a credential may follow, and how (the method's context).
CONTEXT = re.compile(
    r"""(?ai:(?<![A-Za-z0-9])(pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credentials?|bearer|authorization))"""
    r"""["']?(?:\x20?(?:=>|->|:=|[:=])\x20*|\x20(?:is|was)\x20(?=["'`]|[^\s"'`]*[0-9]))["'`]?((?:(?:Bearer|Basic)\x20)?(?:[\x21\x23-\x26\x28-\x5F\x61-\x7E]{8,}|(?=[^\s"'`]*[0-9])[^\s"'`]{8,}))"""
)
#: Keys and tokens that stand beside their name; letters and digits, as prose hardly has them.
BESIDE = re.compile(r"""(?ai:(?<![A-Za-z0-9])(token|(?:api|access|private|secret)[_ -]?key))["']?\x20["'`]?((?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{16,})""")
#: A password in the address of a host.
ADDRESS = re.compile(r"""://([^\s:/@"'`<>]{1,64}):([^\s/@"'`<>]{8,})@(?=[A-Za-z0-9\[])""")
CONTEXT_HINTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"bearer", b"authorization", b"://")
#: A path of a file system: names of words, with numbers after them.
NAME = r"[._-]*(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[._-]+(?:[A-Z]?[a-z]+|[A-Z]+))*[0-9._-]*"
PATH = re.compile(rf"(?:~|\.{{1,2}}|[A-Za-z]:)?(?:[/\\]{NAME}){{2,}}[/\\]?")
LEAST = 10.0
KINDS = ("assign", "access", "hex", "guess")

#: The commonest words in guessable values, by rank (fixed values); a dictionary goes on from there.
WORDS = (
    "password welcome admin letmein login master dragon monkey football baseball superman batman shadow sunshine princess iloveyou hello freedom whatever trustno secret "
    "summer winter spring autumn monday friday january march april july october december love money change default test user root pass guest qwerty access system "
    "server service example token database public private company office house orange purple silver golden flower cookie coffee chocolate michael jessica ashley daniel "
    "charlie thomas robert jordan hunter ranger killer soccer hockey tiger eagle falcon mustang corvette ferrari star wars matrix computer internet google ninja magic"
).split()


@cache
def ranks(path: str | None = None) -> dict[str, int]:
    """Words of at least four letters, lower case, and their ranks: ``WORDS``, then those of a tokenizer's vocabulary file.

    A vocabulary lists its pieces from common to rare; pieces that begin a word and hold
    ASCII letters only are taken as words.
    """
    words = list(WORDS)
    if path:
        with open(path, encoding="utf-8") as f:
            pieces = json.load(f)["model"]["vocab"]
        words += (p[1:].lower() for p in sorted(pieces, key=pieces.get) if p.startswith("\u0120") and len(p) > 4 and p.isprintable() and p[1:].isascii() and p[1:].isalpha())
    return {w: i + 1 for i, w in enumerate(dict.fromkeys(words))}


LONGEST = 20  # letters of a word
RUN = 64  # in longer repeats and walks, spans begin in the first and end in the last half as many places: a cut inside only adds a span
LEET = str.maketrans("013457@$!", "oieastasi")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./"))
PLACE = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")


def _adjacent(a: str, b: str) -> bool:
    x, y = (PLACE.get(SHIFTED.get(c, c.lower())) for c in (a, b))
    return x is not None and y is not None and x != y and abs(x[0] - y[0]) <= 1 and abs(x[1] - y[1]) <= 1


def brute_per_char(value: str) -> float:
    """log10 of the number of characters that brute force has to try at each place."""
    size = sum(n for n, found in ((26, any(c.islower() for c in value)), (26, any(c.isupper() for c in value)), (10, any(c.isdigit() for c in value)), (33, any(not c.isalnum() for c in value))) if found)
    return math.log10(max(size, 10))


def _within(start: int, end: int, least: int) -> Iterator[tuple[int, int]]:
    """Spans (i, j) of at least ``least`` characters in a run."""
    whole = end - start <= RUN
    for i in range(start, end if whole else start + RUN // 2):
        for j in range(i + least if whole else end - RUN // 2 + 1, end + 1):
            yield i, j


def spans(value: str, dictionary: str | None = None) -> Iterator[tuple[int, int, str, float]]:
    """(start, end, kind, log10 guesses) of all known words, dates, repeats and keyboard walks, those inside longer ones too."""
    rank = ranks(dictionary)
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    for i in range(n if len(low) == n else 0):
        for j in range(i + 4, min(n, i + LONGEST) + 1):
            for form, extra in ((low[i:j], 0.0), (plain[i:j], 0.5)):
                if form in rank:
                    cased = 0.3 if value[i:j] != low[i:j] else 0.0
                    yield i, j, "word", math.log10(rank[form] + 1) + extra + cased
                    break
    for i in range(n):
        if value[i].isdigit():
            for j in range(i + 4, min(n, i + 10) + 1):
                if DATE.fullmatch(value, i, j):
                    yield i, j, "date", math.log10(365 * 120 if j - i > 4 else 120)
    for unit in (1, 2, 3, 4):
        start = 0
        for k in range(unit, n + 1):
            if k == n or value[k] != value[k - unit]:
                least = max(2 * unit, 3)
                if k - start >= least:
                    for i, j in _within(start, k, least):
                        yield i, j, "repeat", unit * brute_per_char(value[i : i + unit]) + math.log10((j - i) // unit + 1)
                start = k - unit + 1
    start = 0
    for k in range(1, n + 1):
        if k == n or not _adjacent(value[k - 1], value[k]):
            for i, j in _within(start, k, 3):
                yield i, j, "walk", math.log10(47 * (j - i)) + 0.25 * (j - i)
            start = k


def guess_cost(value: str, dictionary: str | None = None) -> tuple[float, list[tuple[int, int, str]]]:
    """Least log10 guesses of a value over all ways to cut it into ``spans`` and brute force, and the segmentation that has it.

    Linear in the value's length.
    """
    per_char = brute_per_char(value)
    ending: dict[int, list[tuple[int, str, float]]] = {}
    for i, j, kind, cost in spans(value, dictionary):
        ending.setdefault(j, []).append((i, kind, cost + 0.3))  # each span more has to be guessed to be there
    cost, back = [0.0], [(0, "")]
    for j in range(1, len(value) + 1):
        best, how = cost[j - 1] + per_char, (j - 1, "brute")
        for i, kind, c in ending.get(j, ()):
            if cost[i] + c < best:
                best, how = cost[i] + c, (i, kind)
        cost.append(best)
        back.append(how)
    out, j = [], len(value)
    while j:
        i, kind = back[j]
        if kind == "brute" and out and out[-1][2] == "brute":
            out[-1] = (i, out[-1][1], "brute")
        else:
            out.append((i, j, kind))
        j = i
    return cost[-1], out[::-1]


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    value_start: int
    value_end: int
    cost: float | None


def scan(text: str, least: float = LEAST, dictionary: str | None = None) -> list[Span]:
    """All secrets of a text, by start and kind. Places are code points, ends exclusive."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    out: list[Span] = []
    if any(h in raw for h in ASSIGN_HINTS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                out.append(Span("assign", *m.span(), *m.span(2), guess_cost(m[2], dictionary)[0]))
    if "AKIA" in text:
        out += (Span("access", *m.span(), *m.span(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16)
    out += (Span("hex", *m.span(), *m.span(), None) for m in HEX.finditer(text))
    if any(h in raw for h in CONTEXT_HINTS):
        taken = [(s.value_start, s.value_end) for s in out]
        for m in (*CONTEXT.finditer(text), *BESIDE.finditer(text), *ADDRESS.finditer(text)):
            start, end = m.span(2)
            if m.re is CONTEXT and m[2].startswith(("Bearer ", "Basic ")):
                start = text.index(" ", start) + 1
            while end > start and text[end - 1] in ".,;:!?)]}>" and m.re is not ADDRESS:
                end -= 1
            if end - start < 8 or any(s <= start and end <= e for s, e in taken) or PATH.fullmatch(text, start, end):
                continue  # a base value holds all of it; a longer one is reported beside the base value
            taken.append((start, end))
            cost = guess_cost(text[start:end], dictionary)[0]
            if cost >= least:
                out.append(Span("guess", start, end, start, end, cost))
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def redact(text: str, found: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each secret's value replaced; overlapping values are replaced as one."""
    parts, at = [], 0
    for start, end in sorted((s.value_start, s.value_end) for s in found):
        if start >= at:
            parts += (text[at:start], mark)
        at = max(at, end)
    return "".join(parts) + text[at:]


SPANS = "array<struct<kind:string,start:long,end:long,value_start:long,value_end:long,cost:double>>"
_KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64()), ("value_end", pa.int64()), ("cost", pa.float64())]))


def find(df: DataFrame, text_col: str = "text", least: float = LEAST, rewrite: bool = False, dictionary: str | None = None) -> DataFrame:
    """``df`` with a column ``secrets``: the spans of each whole text.

    Null and empty texts have none. With ``rewrite`` the text column is redacted too (null
    stays null). ``dictionary`` is the path of a tokenizer's vocabulary whose words count as
    guessable, on all machines. Very long texts are scanned whole. Other columns are passed on as they are; a column of ``df`` named ``secrets``
    is replaced. One row per input row; a narrow map.
    """
    kept = df.drop("secrets")
    names = kept.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text_col):
            many = block.column(at).to_pylist()
            found = [scan(t, least, dictionary) if t else [] for t in many]
            cols = list(block.columns)
            if rewrite:
                cols[at] = pa.array([redact(t, f) if f else t for t, f in zip(many, found)], pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array([[s._asdict() for s in f] for f in found], _KIND)], [*names, "secrets"])

    return bounded(kept).mapInArrow(run, extended(kept, "secrets", SPANS))


def digests(found: DataFrame) -> DataFrame:
    """Numbers of base spans by kind, digest of the base spans, and all spans as text."""
    base = F.filter("secrets", lambda s: s["kind"] != "guess")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *map(count, KINDS[:3]), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"))
