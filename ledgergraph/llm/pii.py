"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give base spans, which always stay.  The field adds spans they do not
cover: around every digit, at sign or bracketed "at" a region of tokens is
segmented jointly into entities of bounded length and single outside tokens.  An
entity's score is a weighted sum of features of its whole span and its type (digit
grouping, separators, checksum, neighbours), and dynamic programming over segment
ends finds the best boundaries and types together.  Weights maximise the
conditional likelihood (semi-Markov forward-backward) of generated sentences with
known spans, so no document teaches the model.

A segment must hold a trigger and at most ``MAX_CHARS`` characters; no segment
crosses a region's border, so regions decide independently.  Decoding goes from token
to token and keeps, of a region of any length, two numbers a token and the segments
that end ahead; a span's score depends on its shape alone and is remembered by it.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.workspace import small_batches

KINDS = ("email", "ip", "card", "phone")
MAX_CHARS = 64
MAX_TOKENS = 24
#: Digits and groups of digits in a segment that starts like a number.
MAX_DIGITS = 19
MAX_GROUPS = 6
MIN_DIGITS = 7
#: Generated sentences and passes of training.
SENTENCES = 360
EPOCHS = 12

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match starts at the head of a digit run or not at all, so later starts need no try
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9]+|@|[(\[](?:at|AT|At)[)\]]")
_TOKEN = re.compile(r"[^\W0-9_]+|[0-9]+|\s+|.", re.S)
_AT = re.compile(r"@|\s?[(\[](?:at|AT|At)[)\]]\s?")
_DOT = re.compile(r"\.|\s?[(\[](?:dot|DOT|Dot)[)\]]\s?")
_NUMERIC = re.compile(r"[0-9+(][0-9 ().+\[\]-]*[0-9]\Z")
_MAIL_LIKE = re.compile(
    r"[A-Za-z0-9._%+-]+(?:@|\s?[(\[](?:at|AT|At)[)\]]\s?)[A-Za-z0-9-]+(?:(?:\.|\s?[(\[](?:dot|DOT|Dot)[)\]]\s?)[A-Za-z0-9-]+)+\Z"
)

Span = tuple[int, int, str]


#: Every second digit doubled, and its digits added.
_DOUBLED = str.maketrans("0123456789", "0246813579")


def luhn(digits: str) -> bool:
    return sum(map(int, digits[-1::-2])) % 10 == -sum(map(int, digits[-2::-2].translate(_DOUBLED))) % 10


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """What the address pattern finds from the left, looking only around at signs."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done, "email"
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and then kind."""
    found = list(_emails(text))
    if any(c in text for c in "0123456789"):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            d = _digits(m[0]) if m.end() - m.start() >= 12 else ""
            if 12 <= len(d) <= 19 and luhn(d):
                found.append((*m.span(), "card"))
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _char_class(c: str) -> str:
    if not c:
        return "edge"
    return "space" if c.isspace() else "letter" if c.isalpha() else "digit" if c.isdigit() else c


#: What a score depends on: digits in groups, marks, neighbours' classes, and whether the
#: span is like an address, passes Luhn, has four octets, and begins with a plus.
Shape = tuple[tuple[int, ...], str, str, str, bool, bool, bool, bool]

_NO_MARKS = str.maketrans("", "", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


@lru_cache(maxsize=1 << 14)
def _marks(rest: str) -> str:
    return "".join(sorted(set(rest)))


_GROUPS = re.compile(r"[0-9]+").findall


def shape(span: str, left: str, right: str, mail: bool) -> Shape:
    groups = _GROUPS(span)
    lengths = tuple(map(len, groups))
    return (
        lengths,
        _marks(span.translate(_NO_MARKS)),
        _char_class(left),
        _char_class(right),
        mail,
        12 <= sum(lengths) <= 19 and luhn("".join(groups)),
        len(groups) == 4 and all(int(g[:4]) <= 255 for g in groups),
        span[0] == "+",
    )


@lru_cache(maxsize=1 << 14)
def features(of: Shape, kind: str) -> tuple[str, ...]:
    """Names of a shape's features for one type."""
    groups, marks, left, right, mail, checks, octets, plus = of
    n = sum(groups)
    out = (
        "bias",
        f"n={min(n, 20)}",
        f"groups={'-'.join(map(str, groups)) if len(groups) <= 5 else 'many'}",
        f"marks={marks}",
        f"left={left}",
        f"right={right}",
        f"mail={mail}",
        f"luhn={checks}",
        f"octets={octets}",
        f"plus={plus}",
        f"long={n >= 9}",
    )
    return tuple(f"{kind}|{f}" for f in out)


class Region:
    """Tokens around triggers and the candidate segments among them."""

    def __init__(self, text: str, begin: int, end: int):
        self.text = text
        self.start, self.end = array("q"), array("q")
        for m in _TOKEN.finditer(text, begin, end):
            self.start.append(m.start())
            self.end.append(m.end())

    def starting(self, i: int) -> Iterator[tuple[int, tuple[str, ...], Shape]]:
        """Last token, possible types and shape of the candidates from token ``i``."""
        text, a = self.text, self.start[i]
        c, before = text[a], text[a - 1] if a else ""
        if c.isspace() or (c.isalnum() and before.isalnum()):
            return
        number = c in "0123456789+("
        at = _AT.search(text, a, a + MAX_CHARS)
        groups = n = 0
        for j in range(i, min(i + MAX_TOKENS, len(self.start))):
            first, b = self.start[j], self.end[j]
            if b - a > MAX_CHARS or not (number or at):
                return
            if number and "0" <= text[first] <= "9":
                groups, n = groups + 1, n + b - first
            number = number and groups <= MAX_GROUPS and n <= MAX_DIGITS
            after = text[b] if b < len(text) else ""
            figures = number and (groups == 4 or n >= MIN_DIGITS)
            if not (figures or at) or not text[b - 1].isalnum() or after.isalnum():
                continue
            span = text[a:b]
            mail = at is not None and b > at.start() and bool(_MAIL_LIKE.match(span))
            if figures and _NUMERIC.match(span):
                yield j, KINDS[1:], shape(span, before, after, mail)
            elif mail:
                yield j, KINDS[:1], shape(span, before, after, mail)

    def candidates(self) -> list[tuple[int, int, str, Shape]]:
        """All of them: first and last token, type, shape."""
        return [(i, j, kind, of) for i in range(len(self.start)) for j, kinds, of in self.starting(i) for kind in kinds]

    def span(self, i: int, j: int, kind: str) -> Span:
        return self.start[i], self.end[j], kind


def regions(text: str) -> Iterator[Region]:
    """Regions that hold every segment with a trigger, apart from each other."""
    begin = end = -1
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - MAX_CHARS), min(len(text), m.end() + MAX_CHARS)
        if begin < 0:
            begin, end = a, b
        elif a <= end:
            end = b
        else:
            yield Region(text, begin, end)
            begin, end = a, b
    if begin >= 0:
        yield Region(text, begin, end)


#: Shapes whose scores a field remembers before it starts anew.
REMEMBERED = 1 << 16


class SemiMarkovField:
    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self._known: dict[tuple[Shape, tuple[str, ...]], tuple[float, ...]] = {}

    def score(self, of: Shape, kind: str) -> float:
        w = self.weights
        return sum(w.get(f, 0.0) for f in features(of, kind))

    def _scores(self, of: Shape, kinds: tuple[str, ...]) -> tuple[float, ...]:
        known = self._known.get((of, kinds))
        if known is None:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            known = self._known[of, kinds] = tuple(self.score(of, kind) for kind in kinds)
        return known

    def decode(self, region: Region) -> list[Span]:
        """The best segmentation's entities; a tie prefers fewer."""
        n = len(region.start)
        best, back = array("d", bytes(8 * (n + 1))), array("q", [-1]) * (n + 1)
        kept: list[tuple[int, int, str]] = []
        ending: dict[int, list[tuple[float, int, str]]] = {}
        for i in range(n):
            for j, kinds, of in region.starting(i):
                for kind, value in zip(kinds, self._scores(of, kinds), strict=True):
                    if value > 0:  # outside tokens score 0, so no other can be in the best
                        ending.setdefault(j, []).append((value, i, kind))
            best[i + 1] = best[i]
            for value, first, kind in ending.pop(i, ()):
                if best[first] + value > best[i + 1]:
                    best[i + 1], back[i + 1] = best[first] + value, len(kept)
                    kept.append((first, i, kind))
        out, j = [], n
        while j > 0:
            if back[j] < 0:
                j -= 1
                continue
            out.append(region.span(*kept[back[j]]))
            j = kept[back[j]][0]
        return out[::-1]

    def expectations(self, region: Region, cands: list[tuple[int, int, str, Shape]]) -> np.ndarray:
        """Probability of each candidate segment (forward-backward over segment ends)."""
        scores = [self.score(of, kind) for _, _, kind, of in cands]
        n = len(region.start)
        ending: dict[int, list[int]] = {}
        starting: dict[int, list[int]] = {}
        for k, c in enumerate(cands):
            ending.setdefault(c[1] + 1, []).append(k)
            starting.setdefault(c[0], []).append(k)
        ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            ahead[j] = _logsum([ahead[j - 1], *(ahead[cands[k][0]] + scores[k] for k in ending.get(j, ()))])
        for i in range(n - 1, -1, -1):
            behind[i] = _logsum([behind[i + 1], *(behind[cands[k][1] + 1] + scores[k] for k in starting.get(i, ()))])
        return np.array(
            [math.exp(ahead[c[0]] + scores[k] + behind[c[1] + 1] - ahead[n]) for k, c in enumerate(cands)]
        )


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def generated_sentences(n: int = SENTENCES) -> Iterator[tuple[str, set[Span]]]:
    """Sentences with entities in plain and disguised forms, and with numbers that
    are no entities; the same at every call."""
    rng = random.Random(11)

    def digits(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def word() -> str:
        return "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8)))

    def card() -> str:
        body = rng.choice("3456") + digits(14)
        return next(body + d for d in "0123456789" if luhn(body + d))

    def entity() -> tuple[str, str]:
        kind = rng.choice(KINDS)
        if kind == "email":
            at = rng.choice(["@", "@", " (at) ", " [at] ", "[at]"])
            dot = "." if at == "@" else rng.choice([".", " (dot) ", " [dot] ", "[dot]"])
            return kind, f"{word()}{rng.choice(['', '.' + digits(2)])}{at}{word()}{rng.choice(['', digits(1)])}{dot}com"
        if kind == "ip":
            dot = rng.choice([".", ".", "[.]"])
            return kind, dot.join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == "card":
            c = card()
            return kind, rng.choice([c, " ".join(c[i : i + 4] for i in (0, 4, 8, 12)), ".".join(c[i : i + 4] for i in (0, 4, 8, 12))])
        a, b, c = rng.choice("23456789") + digits(2), digits(3), digits(4)
        return kind, rng.choice([f"+1 ({a}) {b}-{c}", f"+{rng.randint(2, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"])

    def other() -> str:
        bad = card()
        bad = bad[:-1] + str((int(bad[-1]) + rng.randint(1, 9)) % 10)
        return rng.choice(
            [
                f"20{digits(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.20{digits(2)}",
                f"{rng.randint(1, 23)}:{digits(2)}", f"${digits(1)},{digits(3)}.{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}",
                f"19{digits(2)}", f"#{digits(9)}", bad, f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", digits(rng.randint(4, 11)),
                f"{rng.randint(256, 999)}.{rng.randint(256, 999)}.{digits(1)}.{digits(2)}", f"{digits(3)}a{digits(2)}e{digits(7)}",
                f"0.{digits(5)}", f"{digits(3)}-{digits(3)}", f"{digits(4)} {digits(4)}", f"({digits(4)})", f"{digits(2)}x{digits(4)}",
                f"{digits(4)}-{digits(4)}-{digits(4)}", f"@{word()}", f"{word()}@{word()}",
            ]
        )

    for _ in range(n):
        text, spans = word().capitalize(), set()
        for _ in range(rng.randint(1, 3)):
            text += " " + " ".join(word() for _ in range(rng.randint(6, 9))) + " "
            if rng.random() < 0.55:
                kind, shown = entity()
                spans.add((len(text), len(text) + len(shown), kind))
            else:
                shown = other()
            text += shown
            text += rng.choice(["", ".", ",", "\n"])
        yield text, spans


@lru_cache(maxsize=1)
def trained() -> SemiMarkovField:
    """Fit by AdaGrad on the conditional log-likelihood with a small L2 penalty."""
    data = [(r, r.candidates(), spans) for text, spans in generated_sentences() for r in regions(text)]
    field = SemiMarkovField({})
    squares: dict[str, float] = {}
    for _ in range(EPOCHS):
        for region, cands, spans in data:
            slope: dict[str, float] = {}
            gold = [region.span(i, j, kind) in spans for i, j, kind, _ in cands]
            for p, hit, (_, _, kind, of) in zip(field.expectations(region, cands), gold, cands, strict=True):
                for f in features(of, kind):
                    slope[f] = slope.get(f, 0.0) + hit - p
            for f, g in slope.items():
                g -= 1e-3 * field.weights.get(f, 0.0)
                squares[f] = squares.get(f, 1e-8) + g * g
                field.weights[f] = field.weights.get(f, 0.0) + 0.5 * g / math.sqrt(squares[f])
    return field


def find_spans(text: str, field: SemiMarkovField) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: those and the field's that overlap none of them."""
    base = base_spans(text)
    starts = [s[0] for s in base]
    reach = list(accumulate((s[1] for s in base), max))
    added = []
    for region in regions(text):
        for span in field.decode(region):
            before = bisect_left(starts, span[1])
            if not before or reach[before - 1] <= span[0]:
                added.append(span)
    return base, sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[2]))) if added else base


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _scan(weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = SemiMarkovField(weights)
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            base_all, all_all = [], []
            for value in batch.column(1):
                base, every = find_spans(value.as_py() or "", field)
                for i, kind in enumerate(KINDS):
                    counts[i].append(sum(s[2] == kind for s in base))
                base_all.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                all_all.append(_joined(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base_all, pa.string()), pa.array(all_all, pa.string())],
                ["key", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return run


def personal_data(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, n_email, n_ip, n_card, n_phone, base_sha256, spans`` per row.

    The counts and the digest are of base spans; ``spans`` lists all as
    ``kind:start:end`` in code points, end exclusive, by start and kind.  Null is
    empty and has no spans.  Other columns are not read; rows are independent, so
    repeated rows have equal results; an empty table gives no rows.
    """
    small_batches(spark)
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType)])
    for kind in KINDS:
        schema = schema.add(f"n_{kind}", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string")
    return (
        docs.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
        .mapInArrow(_scan(trained().weights), schema)
        .withColumnRenamed("key", key)
    )


def mask(text: str, field: SemiMarkovField | None = None) -> str:
    """The text with every span replaced by its kind in angle brackets."""
    out, done = [], 0
    for a, b, kind in find_spans(text, field or trained())[1]:
        if a >= done:
            out += [text[done:a], f"<{kind}>"]
            done = b
    return "".join([*out, text[done:]])
