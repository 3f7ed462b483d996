"""Secret scans: fixed patterns, and assignment-aware lexing of names and literals.

The lexer reads ``name = literal`` pairs of source and configuration syntax (``=``, ``:``, ``:=``, ``=>``; quoted or
bare), remembers constants by name, follows names and ``+`` back to the literals they stand for, and scores each
literal by how sensitive the name is that it ends up under and by how random it looks.

Literals, names and concatenations may be of any length; a constant made of others refers to them.

Defined cases: a null or empty text has no spans; spans are code points, end exclusive; texts of any length are
scanned whole, one at a time; repeated rows are scanned one by one; an empty table gives an empty table; other columns
pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words of a name that make its value sensitive, with their weight.
SENSITIVE = {
    "apikey": 3, "auth": 1, "bearer": 2, "credential": 3, "credentials": 3, "key": 1, "pass": 2, "passphrase": 3,
    "passwd": 3, "password": 3, "private": 1, "pwd": 3, "secret": 3, "signature": 1, "token": 3, "access": 1, "api": 1,
}
#: Literals that stand in for a secret.
PLACEHOLDERS = {"changeme", "example", "none", "null", "placeholder", "redacted", "true", "false", "undefined", "your"}
MIN_SCORE = 5.0
#: First characters of a literal that are looked at for stand-ins.
HEAD = 16
_CLASSES = (lambda c: "a" <= c <= "z", lambda c: "A" <= c <= "Z", lambda c: "0" <= c <= "9", lambda c: not (c.isascii() and c.isalnum()))
_SEP = re.compile(r"[ \t]*(?::=|=>|[:=])[ \t]*")
_NAME_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-"
#: Quoted literals and bare names, of any length; possessive, so that a match takes time in proportion to its length.
_TERM = re.compile(r"\"((?:[^\"\\\n]|\\.)*+)\"|'((?:[^'\\\n]|\\.)*+)'|([A-Za-z_][A-Za-z0-9_.]*+)(?![\-/+=])")
_BARE = re.compile(r"[A-Za-z0-9+/_.=-]++")
_PLUS = re.compile(r"[ \t]*\+[ \t]*")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping within a kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def name_weight(name: str) -> float:
    parts = [w.lower() for w in _WORDS.findall(name)]
    return sum(SENSITIVE.get(w, 0) for w in parts)


class Value:
    """A literal (its span) or a concatenation (its parts, each a Value shared by all that refer to it)."""

    __slots__ = ("start", "end", "parts", "marks", "told")

    def __init__(self, start: int = 0, end: int = 0, parts: tuple[Value, ...] = ()):
        self.start, self.end, self.parts = start, end, parts
        #: Number of each character (all scaled alike where they are huge) and the first characters, once asked for.
        self.marks: tuple[dict[str, float], str] | None = None
        self.told = False


class Literals:
    """Character counts and spans of the values of one text, those of a value computed once."""

    def __init__(self, text: str):
        self.text = text
        self.last = (0, 0, Counter())

    def _leaf(self, start: int, end: int) -> tuple[dict[str, float], str]:
        """Literals that end alike, as the values of a=b=c do, are counted from each other."""
        at, to, counts = self.last
        if to == end and at <= start:
            counts = counts.copy()
            counts.subtract(self.text[at:start])
            counts = +counts
        else:
            counts = Counter(self.text[start:end])
        self.last = (start, end, counts)
        return counts, self.text[start : min(end, start + HEAD)]

    def marks(self, value: Value) -> tuple[dict[str, float], str]:
        todo = [value]
        while todo:
            v = todo[-1]
            if v.marks is not None:
                todo.pop()
            elif not v.parts:
                v.marks = self._leaf(v.start, v.end)
            elif wanted := [p for p in v.parts if p.marks is None]:
                todo += wanted
            else:
                counts: dict[str, float] = {}
                head = ""
                for p in v.parts:
                    for c, n in p.marks[0].items():
                        counts[c] = counts.get(c, 0) + n
                    if len(head) < HEAD:
                        head = (head + p.marks[1])[:HEAD]
                if sum(counts.values()) > 1e100:
                    counts = {c: n / 1e50 for c, n in counts.items()}
                v.marks = counts, head
        return value.marks

    def weight(self, value: Value) -> float:
        return marks_weight(*self.marks(value))

    def spans(self, value: Value) -> list[tuple[int, int]]:
        """Spans of the literals a value stands for, without those told before."""
        out, todo = [], [value]
        while todo:
            v = todo.pop()
            if v.told:
                continue
            v.told = True
            todo += v.parts
            if not v.parts and v.end > v.start:
                out.append((v.start, v.end))
        return out


def marks_weight(counts: dict[str, float], head: str) -> float:
    """Length and character entropy of a literal; nothing for a stand-in."""
    n, low = sum(counts.values()), head.lower()
    if n < 6 or any(low.startswith(p) for p in PLACEHOLDERS) or head[:1] in "<{$" or len(counts) < 4:
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values() if c / n > 0)
    mixed = sum(any(f(c) for c in counts) for f in _CLASSES)
    return min(entropy, 4.0) / 2 + min(n, 32) / 16 + (mixed - 1) / 2


def literal_weight(value: str) -> float:
    return marks_weight(Counter(value), value[:HEAD])


def _name_before(text: str, lo: int, hi: int) -> str:
    """The name, perhaps in quotes or brackets, that ends at ``hi``; nothing before ``lo`` belongs to it."""
    near = text[lo:hi].removesuffix("\n").removesuffix("]")
    if near[-1:] in ("'", '"'):
        near = near[:-1]
    return near[len(near.rstrip(_NAME_CHARS)) :].lstrip("0123456789.-")


def assigned_literals(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, directly or through constants."""
    known: dict[str, Value] = {}
    held = Literals(text)
    out = set()
    done = bare_from = bare_to = 0
    for m in _SEP.finditer(text):
        name, done = _name_before(text, done, m.start()), m.end()
        if not name:
            continue
        values: list[Value] = []
        at = m.end()
        while True:
            if t := _TERM.match(text, at):
                k, end = t.lastindex, t.end()
                if k != 3:
                    values.append(Value(t.start(k), t.end(k)))
                elif found := known.get(t[3]) or known.get(t[3].rsplit(".", 1)[-1]):
                    values.append(found)
                elif any(c.isdigit() for c in t[3]):
                    values.append(Value(at, end))
            else:
                if not bare_from <= at < bare_to:
                    if not (t := _BARE.match(text, at)):
                        break
                    bare_from, bare_to = t.span()
                end = bare_to
                values.append(Value(at, end))
            at = end
            if not (plus := _PLUS.match(text, at)):
                break
            at = plus.end()
        if not values:
            continue
        value = values[0] if len(values) == 1 else Value(parts=tuple(values))
        known[name] = known[name.rsplit(".", 1)[-1]] = value
        weight = name_weight(name)
        if weight >= 2 and weight + (own := held.weight(value)) >= MIN_SCORE and (own or value.parts):
            out.update(held.spans(value))
    return sorted(out)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of one text."""
    base = base_spans(text)
    if "=" not in text and ":" not in text:
        return base, base
    return base, sorted({*base, *((s, 3, e) for s, e in assigned_literals(text))})


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mask: str = "[SECRET]") -> str:
    """The text with every span, overlaps taken together, replaced by the mask."""
    out, at = [], 0
    end = -1
    for s, _, e in spans:
        if s > end:
            if end >= 0:
                out.append(mask)
                at = end
            out.append(text[at:s])
        end = max(end, e)
    if end >= 0:
        out.append(mask)
        at = end
    return "".join([*out, text[at:]])


def secret_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add base_spans and spans (kind:start:end, comma-joined), n_assign, n_access, n_hex, n_spans and redacted_text."""
    added = [("base_spans", T.StringType()), ("spans", T.StringType()), *((f"n_{k}", T.LongType()) for k in (*KINDS[:3], "spans")), ("redacted_text", T.StringType())]
    kept = [f for f in docs.schema.fields if f.name not in {n for n, _ in added}]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in added)])

    def judged(t):
        if t is None:
            return "", "", 0, 0, 0, 0, None
        base, spans = scan(t)
        counts = Counter(k for _, k, _ in base)
        return joined(base), joined(spans), counts[0], counts[1], counts[2], len(spans), redact(t, spans) if spans else t

    def run(batches):
        for whole in batches:
            for at in range(0, max(1, len(whole)), 1024):
                b = whole.iloc[at : at + 1024]
                rows = [judged(t) for t in b[text]]
                yield b[[f.name for f in kept]].assign(**{n: pd.Series([r[k] for r in rows], index=b.index, dtype=object) for k, (n, _) in enumerate(added)})

    return docs.mapInPandas(run, schema)
