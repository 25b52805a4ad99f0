r"""Secrets by fixed patterns and by the names that literals are assigned to.

The patterns give base spans, which always stay.  Beside them a lexer looks at every
mark of assignment (``=``, ``:``, ``:=``, ``=>``, element and attribute syntax, flags,
calls with a name and a literal, passwords in addresses) and reads a name to its left
and an expression to its right: literals with their places, names of other constants,
and joins of both.  These pairs are the assignments of a text.

Constants are propagated: a name on the right stands for the literals last assigned to
it before (or, if none was, first after), through any number of names.  The literals
that reach a target are joined and scored: how sensitive the words of the target's name
are, and whether the value looks like a secret and not like a place-holder, a word or a
path.  Over :data:`THRESHOLD`, each of these literals is a span of kind ``assign``,
wherever it stands, unless base spans cover it whole.

Texts are handled as UTF-8 bytes, whose ASCII patterns match as those of characters do;
spans are turned to code points at the end.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from ..functions.workspace import small_batches

KINDS = ("assign", "access", "hex")
#: Least score of a literal that is a secret.
THRESHOLD = 2.5
#: Bytes of the longest name that can be a target.
MAX_NAME = 96

Span = tuple[int, int, str]

_ASSIGN = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_KEYWORDS = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
# a maximal run of 32 or more, which is what the runs of any length leave after dropping
_HEX = re.compile(rb"[0-9a-f]{32,}")


def base_spans(raw: bytes, low: bytes) -> list[Span]:
    """Spans of the fixed patterns in bytes, by start and then kind."""
    found = []
    if any(k in low for k in _KEYWORDS):
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(raw) if len(m[1]) >= 8]
    found += [(*m.span(), "access") for m in _ACCESS.finditer(raw) if len(m[0]) >= 16]
    found += [(*m.span(), "hex") for m in _HEX.finditer(raw)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# -- names -----------------------------------------------------------------------------

_WORDS = re.compile(rb"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Words, or two words in a row, that make a name sensitive, and how much.
_SENSITIVE = {
    ("password",): 2.0, ("passwd",): 2.0, ("passwort",): 2.0, ("pwd",): 2.0, ("passphrase",): 2.0, ("passcode",): 2.0, ("pass",): 1.6,
    ("pw",): 1.6, ("secret",): 2.0, ("secrets",): 1.6, ("token",): 1.8, ("credential",): 1.8, ("credentials",): 1.8, ("apikey",): 2.0,
    ("api", "key"): 2.0, ("access", "key"): 2.0, ("private", "key"): 2.0, ("secret", "key"): 2.0, ("encryption", "key"): 2.0,
    ("signing", "key"): 2.0, ("auth", "key"): 2.0, ("account", "key"): 2.0, ("shared", "key"): 2.0, ("master", "key"): 2.0,
    ("license", "key"): 1.6, ("authorization",): 1.8, ("bearer",): 1.8, ("jwt",): 1.8, ("auth",): 1.4, ("pin",): 0.9, ("salt",): 1.2,
    ("webhook",): 1.0, ("dsn",): 1.0, ("key",): 0.6, ("signature",): 0.6,
}
#: Words that say the value is about a secret and not one: at the end, or anywhere.
_ABOUT = frozenset(
    "count counts length len size limit type types name names id ids url uri path file field fields hint policy expiry expires expiration "
    "ttl timeout label placeholder prompt regex pattern index format header headers class enabled required version algorithm alg method "
    "scope scopes issuer audience endpoint env variable var column table style color status state usage rotation manager store provider "
    "strength min max attempts age".split()
)
_OTHER = frozenset("public primary foreign sort max min num has is no next prev previous partition cache row hot foreignkey total per".split())


@lru_cache(maxsize=1 << 14)
def sensitivity(name: bytes) -> float:
    """How much the words of a name say that its value is a secret; 0: not at all."""
    if len(name) > MAX_NAME:
        return 0.0
    parts = [w.decode().lower() for w in _WORDS.findall(name) if not w.isdigit()]
    if not parts or parts[-1] in _ABOUT or _OTHER & set(parts):
        return 0.0
    return max(_SENSITIVE.get(p, 0.0) for p in [*((w,) for w in parts), *pairwise(parts)])


# -- literals --------------------------------------------------------------------------

_PLACEHOLDER = re.compile(
    rb"(?i)change.?me|example|sample|dummy|place.?holder|your[-_ ]|insert[-_ ]|replace[-_ ]|x{4,}|\*{3,}|\.{3}|<[^>]*>|\$\{|\$\(|\{\{|%\(|%s|#\{"
    rb"|todo|^tbd|^none$|^null$|^nil$|^undefined$|^true$|^false$|redacted|masked|hidden|^test$|^string$|^str$|^varchar"
)
_LETTERS = re.compile(rb"[A-Za-z\x80-\xff]+\Z")
_PATH = re.compile(rb"(?:[A-Za-z]:)?[\\/.~]|[a-z][a-z0-9+.-]*://")
_CALL_LIKE = re.compile(rb"[A-Za-z_][\w.]*\(")


def _entropy(value: bytes) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def likeness(value: bytes, quoted: bool) -> float:
    """How much a literal looks like a secret; below -9: it cannot be one."""
    n = len(value)
    if n < 6 or len(set(value)) < 4 or _PLACEHOLDER.search(value) or _CALL_LIKE.match(value):
        return -10.0
    score = 0.7 if quoted else 0.0
    score += 0.5 * (n >= 8) + 0.4 * (n >= 16) + 0.3 * (n >= 32)
    digits = sum(0x30 <= c <= 0x39 for c in value)
    if digits == n:
        score -= 0.7 if n < 12 else 0.2
    elif digits:
        score += 0.8
    elif _LETTERS.match(value):
        # a lone word: mixed cases inside tell a key from a word
        inner = value[1:]
        score += 0.5 if inner != inner.lower() and inner != inner.upper() else (-0.2 if quoted else -1.0)
    blanks = value.count(b" ")
    if blanks:
        score -= 0.4 if blanks < 4 and digits else 1.5
    if not value.isalnum() and not blanks:
        score += 0.3
    if _PATH.match(value):
        score -= 1.2
    return score + 0.4 * (_entropy(value) >= 3.2)


# -- lexing ----------------------------------------------------------------------------

#: What lies between a name and a value; a longer mark is read whole.
_MARK = re.compile(rb"=>|:=|=|:|->")
_NAME_LEFT = re.compile(rb"([A-Za-z_$@%][\w$.\x2d]*|[A-Za-z_$@]?[\w.$>-]*\[[\"']?[\w.-]+[\"']?)[\"'`\]]*(?:\x20*\x3a\x20*[A-Za-z_][\w.<>\[\]]*)?[\x20\t]*\Z")
_BLANK = re.compile(rb"[\x20\t]*")
_STRING = re.compile(rb"[rbufRBUF@]{0,2}(?:\"\"\"(.*?)\"\"\"|'''(.*?)'''|\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\\n]|\\.)*)`)", re.S)
_NAME = re.compile(rb"[A-Za-z_$][\w$]*(?:(?:\.|->|::)[A-Za-z_$][\w$]*)*")
_REFERENCE = re.compile(rb"\$\{([A-Za-z_][\w.]*)\}|\$\(([A-Za-z_][\w.]*)\)|%([A-Za-z_]\w*)%|\#\{([A-Za-z_][\w.]*)\}|\{([A-Za-z_][\w.]*)\}")
_JOIN = re.compile(rb"[\x20\t]*(?:\+|\.\.|\.(?=[\x20\t]*[\"'$])|&(?!&)|\|\|)[\x20\t]*(?:\\?\r?\n[\x20\t]*)?")
_BARE = re.compile(rb"[^\s\"'`,;<>(){}\[\]|&]+")
_ELEMENT = re.compile(rb"<([A-Za-z][\w.:-]*)(?:[\x20\t][^<>\n]*)?>([^<>\n]+)</")
_ATTRIBUTES = re.compile(rb"(?:key|name)\x20*=\x20*([\"'])([\w.:/-]+)\1\x20+value\x20*=\x20*([\"'])([^\"'\n]*)\3", re.I)
_NAMED_ARGUMENT = re.compile(rb"\(\s*([\"'])([\w.:-]+)\1\s*,\s*([\"'])((?:[^\"'\\\n]|\\.)*)\3")
_SETTER = re.compile(rb"\bset_?([A-Za-z]\w*)\(\s*([\"'])((?:[^\"'\\\n]|\\.)*)\2\s*\)")
_FLAG = re.compile(rb"(?<![\w-])--?([A-Za-z][\w-]*)[\x20\t]+([\"']?)([^\s\"'-][^\s\"']*)\2")
_ADDRESS = re.compile(rb"://[^\s/:@\"'<>]*:([^\s/@\"'<>]+)@")
_SCHEME = re.compile(rb"(?:Bearer|Basic|Token|bearer|basic|token)\x20+")
_ENV_NAME = re.compile(rb"[A-Z][A-Z0-9_]*\Z")

#: The whole value of a line ``NAME=value``.
_LINE_VALUE = re.compile(rb"[^\s\"'`$%#{(][^\s\"'`]*")
_LINE_NAME = re.compile(rb"\s*(?:export\x20+|set\x20+|ENV\x20+)?[A-Za-z_][\w.-]*\Z")

#: A literal: its bytes' bounds, whether it is quoted, and a bare word that may as well
#: name a constant; or the name of a constant.
Literal = tuple[int, int, bool, bytes]
Part = Literal | bytes


class Assignment:
    __slots__ = ("at", "name", "parts")

    def __init__(self, at: int, name: bytes, parts: list[Part]):
        self.at, self.name, self.parts = at, name, parts


def _quoted(raw: bytes, pos: int) -> tuple[list[Part], int] | None:
    """A string literal's parts: its text, cut at the constants it names."""
    m = _STRING.match(raw, pos)
    if not m:
        return None
    a, b = m.span(m.lastindex)
    parts: list[Part] = []
    at = a
    for r in _REFERENCE.finditer(raw, a, b):
        if r.start() > at:
            parts.append((at, r.start(), True, b""))
        parts.append(next(x for x in r.groups() if x))
        at = r.end()
    if at < b or a == b:
        parts.append((at, b, True, b""))
    return parts, m.end()


def _arguments(raw: bytes, pos: int) -> tuple[list[Part], int]:
    """The strings and names of a call's arguments up to its bracket or the line's end;
    a string in the form of an environment name asks for a value and is none."""
    parts: list[Part] = []
    depth = 1
    while pos < len(raw) and depth and raw[pos] != 0x0A:
        found = _quoted(raw, pos) if raw[pos] in b"\"'`" else None
        if found:
            lits, pos = found
            parts += [p for p in lits if isinstance(p, bytes) or not _ENV_NAME.match(raw[p[0] : p[1]])]
            continue
        m = _NAME.match(raw, pos)
        if m:
            if raw[m.end() : m.end() + 1] != b"(":
                parts.append(m[0])
            pos = m.end()
            continue
        depth += (raw[pos] == 0x28) - (raw[pos] == 0x29)
        pos += 1
    return parts, pos


def _expression(raw: bytes, pos: int) -> tuple[list[Part], int]:
    """Parts of the value at ``pos``, and where it ends."""
    parts: list[Part] = []
    while True:
        found = _quoted(raw, pos)
        if found:
            parts += found[0]
            pos = found[1]
        else:
            m = _NAME.match(raw, pos)
            bare = _BARE.match(raw, pos)
            if m and raw[m.end() : m.end() + 1] == b"(":
                more, pos = _arguments(raw, m.end() + 1)
                parts += more
            elif bare and bare[0].startswith((b"${", b"%", b"#{")) or raw[pos : pos + 2] in (b"${", b"$(", b"#{"):
                r = _REFERENCE.match(raw, pos)
                if not r:
                    return parts, pos
                parts.append(next(x for x in r.groups() if x))
                pos = r.end()
            elif m and bare and m.end() == bare.end():
                parts.append((pos, m.end(), False, m[0]))
                pos = m.end()
            elif m and bare and _JOIN.match(raw, m.end()):
                parts.append(m[0])
                pos = m.end()
            elif bare:
                parts.append((pos, bare.end(), False, b""))
                pos = bare.end()
            else:
                return parts, pos
        m = _JOIN.match(raw, pos)
        if not m or m.end() == pos:
            return parts, pos
        pos = m.end()


def assignments(raw: bytes) -> list[Assignment]:
    """The text's name-literal pairs, in order."""
    out: list[Assignment] = []
    pos = 0
    while m := _MARK.search(raw, pos):
        pos = m.end()
        begin = max(0, m.start() - MAX_NAME)
        line = raw[max(begin, raw.rfind(b"\n", begin, m.start()) + 1) : m.start()]
        left = _NAME_LEFT.search(line)
        if not left or raw[pos : pos + 1] in (b"=", b"/", b":"):
            pos += raw[pos : pos + 1] in (b"=", b":")
            continue
        value = _BLANK.match(raw, pos).end()
        whole = _LINE_VALUE.match(raw, pos) if m[0] == b"=" and _LINE_NAME.match(line) else None
        if whole and not _NAME.fullmatch(whole[0]) and not _CALL_LIKE.match(whole[0]):
            parts, end = [(*whole.span(), False, b"")], whole.end()
        else:
            scheme = _SCHEME.match(raw, value)
            parts, end = _expression(raw, scheme.end() if scheme else value)
        if parts:
            out.append(Assignment(m.start(), left[1], parts))
            first = parts[0]
            # a bare value may itself be the name of the next pair, as in {a: b = "c"}
            pos = value if len(parts) == 1 and not isinstance(first, bytes) and first[3] else end
    if b"</" in raw:
        out += [Assignment(m.start(), m[1], [(*m.span(2), True, b"")]) for m in _ELEMENT.finditer(raw)]
    if b"value" in raw or b"VALUE" in raw:
        out += [Assignment(m.start(), m[2], [(*m.span(4), True, b"")]) for m in _ATTRIBUTES.finditer(raw)]
    if b"(" in raw:
        out += [Assignment(m.start(), m[2], [(*m.span(4), True, b"")]) for m in _NAMED_ARGUMENT.finditer(raw)]
        out += [Assignment(m.start(), m[1], [(*m.span(3), True, b"")]) for m in _SETTER.finditer(raw)]
    if b"--" in raw or b" -" in raw:
        out += [Assignment(m.start(), m[1], [(*m.span(3), bool(m[2]), b"")]) for m in _FLAG.finditer(raw)]
    if b"://" in raw:
        out += [Assignment(m.start(), b"password", [(*m.span(1), True, b"")]) for m in _ADDRESS.finditer(raw)]
    return sorted(out, key=lambda x: x.at)


def _last_name(name: bytes) -> bytes:
    return re.split(rb"\.|->|::|\[", name.rstrip(b"\"'`]"))[-1].strip(b"\"'`$@%-")


class Constants:
    """Which literals a name stands for at a place of the text."""

    def __init__(self, pairs: list[Assignment]):
        self.by_name: dict[bytes, list[Assignment]] = {}
        for p in pairs:
            self.by_name.setdefault(_last_name(p.name), []).append(p)

    def definition(self, name: bytes, at: int) -> Assignment | None:
        """The last assignment before ``at``, else the first one after it."""
        known = self.by_name.get(_last_name(name))
        if not known:
            return None
        i = bisect_left(known, at, key=lambda p: p.at)
        return known[i - 1] if i else next((p for p in known if p.at > at), None)

    def literals(self, pair: Assignment) -> list[Literal]:
        """All literals that reach a target, in the order of their joining."""
        out: list[Literal] = []
        seen, stack = {id(pair)}, [(p, pair.at) for p in reversed(pair.parts)]
        while stack:
            part, at = stack.pop()
            name = part if isinstance(part, bytes) else part[3]
            found = self.definition(name, at) if name else None
            if found is None or found is pair:
                if not isinstance(part, bytes):
                    out.append(part)
            elif id(found) not in seen:
                seen.add(id(found))
                stack += [(p, found.at) for p in reversed(found.parts)]
        return out


def assigned_secrets(raw: bytes) -> list[Span]:
    """Literals that reach a sensitive name and look like secrets, by start."""
    pairs = assignments(raw)
    targets = [(p, s) for p in pairs if (s := sensitivity(_last_name(p.name)) or 0.9 * sensitivity(p.name)) > 0]
    if not targets:
        return []
    constants = Constants(pairs)
    found: set[tuple[int, int]] = set()
    for pair, weight in targets:
        literals = constants.literals(pair)
        value = b"".join(raw[p[0] : p[1]] for p in literals)
        if value and weight + likeness(value, any(p[2] for p in literals)) >= THRESHOLD:
            found |= {p[:2] for p in literals if p[1] > p[0]}
    return [(a, b, "assign") for a, b in sorted(found)]


def _uncovered(spans: list[Span], base: list[Span]) -> list[Span]:
    """Spans that the union of ``base`` (by start) does not cover whole."""
    merged: list[list[int]] = []
    for a, b, _ in base:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts = [m[0] for m in merged]
    return [s for s in spans if not (i := bisect_right(starts, s[0])) or merged[i - 1][1] < s[1]]


def find_secrets(raw: bytes) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, of UTF-8 bytes: in code points, by start and kind."""
    low = raw.lower()
    base = base_spans(raw, low)
    found = _uncovered(assigned_secrets(raw), base) if _worth_lexing(low) else []
    every = sorted([*base, *found], key=lambda s: (s[0], KINDS.index(s[2]), s[1])) if found else base
    if raw.isascii() or not every:
        return base, every
    edges = sorted({x for a, b, _ in every for x in (a, b)})
    points, done, count = {}, 0, 0
    for x in edges:
        count += len(raw[done:x].decode("utf-8"))
        points[x], done = count, x
    shown = lambda spans: [(points[a], points[b], k) for a, b, k in spans]
    return shown(base), shown(every)


#: Every sensitive name holds one of these, and every address with a password the last.
_HINTS = (b"pass", b"pwd", b"pw", b"secret", b"token", b"credential", b"key", b"auth", b"bearer", b"jwt", b"pin", b"salt", b"webhook", b"dsn", b"signature", b"://")


def _worth_lexing(low: bytes) -> bool:
    """Whether a text can hold a target at all: a hint, and a mark of assignment."""
    return any(h in low for h in _HINTS) and any(m in low for m in (b"=", b":", b"</", b"(", b"-"))


def redact(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets; spans that
    touch or overlap go as one, by the kind of the first."""
    out, done = [], 0
    for a, b, kind in find_secrets(text.encode())[1]:
        if a >= done:
            out += [text[done:a], f"<{kind}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = W.utf8(batch.column(1))
        counts: list[list[int]] = [[] for _ in KINDS]
        base_all, all_all = [], []
        for a, b in pairwise(offsets.tolist()):
            base, every = find_secrets(data[a:b].tobytes())
            for i, kind in enumerate(KINDS):
                counts[i].append(sum(s[2] == kind for s in base))
            base_all.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            all_all.append(_joined(every))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base_all, pa.string()), pa.array(all_all, pa.string())],
            ["key", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
        )


def secret_scan(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, n_assign, n_access, n_hex, base_sha256, spans`` per row.

    The counts and the digest are of base spans; ``spans`` lists all as
    ``kind:start:end`` in code points, end exclusive, by start and kind.  An added span
    is the literal without its quotes.  Null is empty and has no spans.  Other columns
    are not read; rows are independent, so repeated rows have equal results; an empty
    table gives no rows.
    """
    small_batches(spark)
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType)])
    for kind in KINDS:
        schema = schema.add(f"n_{kind}", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string")
    return docs.select(F.col(key).alias("key"), F.col(text_col).alias("text")).mapInArrow(_scan, schema).withColumnRenamed("key", key)
