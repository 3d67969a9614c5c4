"""Secret scans: fixed patterns, and assignment-aware lexing of source and configuration text.

The lexer reads name-literal pairs: a name, one of = : := =>, and an expression of quoted strings, bare words
and names joined by +.  A name on the right stands for the literals that were assigned to it before, so that
a constant is followed to where a sensitive name takes it.  The literals behind a sensitive name are scored
by the name and by their own make-up, and those that score enough are reported where they stand: all of them, however
many.  Work and memory grow with the text alone.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, the least length of what they must match, and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "lexed")

# Words that make a name sensitive, with their weight.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "privatekey": 1.0, "accesskey": 1.0, "signingkey": 1.0,
    "encryptionkey": 1.0,
}
#: A literal is reported at this product of the name's weight and its own strength.
THRESHOLD = 0.45

_BEFORE_SECRETS = ("passw", "secret", "token", "api")
_BEFORE_LEXING = ("pass", "pwd", "secret", "token", "key", "cred", "auth", "bearer")
# A name is a whole run of name characters (without those in front that begin no name), and no run is given back in part:
# every character of a text is looked at a bounded number of times, however long its words are.
_ATOM = r"""(?>"[^"\n]*"|'[^'\n]*'|[A-Za-z_$][\w$.]*)"""
_PAIR = re.compile(rf"""(?<![\w$.-])[0-9.-]*+([A-Za-z_$][\w$.-]*+)["']?\]?[ \t]*+(?>:=|=>|=|:)[ \t]*+({_ATOM}(?:[ \t]*+\+[ \t]*+{_ATOM})*(?![\w+/=-])|[^\s"',;<>]++)""", re.ASCII)
_PARTS = re.compile(_ATOM, re.ASCII)
_PLACEHOLDER = re.compile(r"\s|[<>{}$]|%[sd(]|\*{3}|x{4}|example|changeme|your", re.IGNORECASE)
_NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", re.ASCII)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns, unsorted.  The lower-case copy only tells whether it is worth looking."""
    found = []
    low = text.lower()
    if (":" in text or "=" in text) and any(w in low for w in _BEFORE_SECRETS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def name_weight(name: str) -> float:
    """How sensitive a name is: its words, and neighbouring words together (api key, private key)."""
    words = [w.lower() for w in _NAME_WORDS.findall(name)]
    return max((SENSITIVE.get(w, 0.0) for w in [*words, *(a + b for a, b in zip(words, words[1:]))]), default=0.0)


def strength(literals: Sequence[str]) -> float:
    """0 to 1: entropy a character and length of literals joined; placeholders and plain words are weak."""
    total = _NOTHING
    for x in literals:
        total = _added(total, _make_up(x))
    return _strength(total)


#: Length, shares of characters, and whether any literal is a placeholder: what the strength of a value depends on.
MakeUp = tuple[float, dict[str, float], bool]
_NOTHING: MakeUp = (0.0, {}, False)
#: Lengths above it are alike (a constant joined with itself over and over).
_LONG = 1e15


def _make_up(literal: str) -> MakeUp:
    n = len(literal)
    return float(n), {c: k / n for c, k in Counter(literal).items()}, bool(_PLACEHOLDER.search(literal))


def _added(a: MakeUp, b: MakeUp) -> MakeUp:
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return (b if b[0] else a)[:2] + (a[2] or b[2],)
    shares = {c: x * a[0] / n for c, x in a[1].items()}
    for c, x in b[1].items():
        shares[c] = shares.get(c, 0.0) + x * b[0] / n
    return min(n, _LONG), shares, a[2] or b[2]


def _strength(made: MakeUp) -> float:
    n, shares, weak = made
    if n < 6 or weak:
        return 0.0
    bits = -sum(x * math.log2(x) for x in shares.values() if x > 0)
    seen = "".join(shares)
    classes = sum(bool(re.search(p, seen)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    return min(1.0, bits / 4) * min(1.0, n / 10) * (1.0 if classes > 1 else 0.4)


class _Value:
    """What a name was given: spans of literals, and values of other names, which are shared and never copied."""

    __slots__ = ("made", "parts", "told")

    def __init__(self, parts: list[tuple[int, int] | _Value]) -> None:
        self.parts, self.made, self.told = parts, None, False

    def make_up(self, text: str) -> MakeUp:
        """Made once for each value, from below: no recursion, whatever the depth."""
        todo = [self]
        while todo:
            value = todo[-1]
            below = [p for p in value.parts if isinstance(p, _Value) and p.made is None]
            if below:
                todo += below
                continue
            todo.pop()
            if value.made is None:
                total = _NOTHING
                for p in value.parts:
                    total = _added(total, p.made if isinstance(p, _Value) else _make_up(text[p[0] : p[1]]))
                value.made = total
        return self.made

    def tell(self, found: set[tuple[int, int]]) -> None:
        """All literals into `found`; values told before are in it."""
        todo = [self]
        while todo:
            value = todo.pop()
            if not value.told:
                value.told = True
                for p in value.parts:
                    todo.append(p) if isinstance(p, _Value) else found.add(p)


def lexed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of literals that a sensitive name takes, directly or through constants, unsorted."""
    low = text.lower()
    if not ("=" in text or ":" in text) or not any(w in low for w in _BEFORE_LEXING):
        return []
    constants: dict[str, _Value] = {}
    found: set[tuple[int, int]] = set()
    for pair in _PAIR.finditer(text):
        name, value, begin = pair[1], pair[2], pair.start(2)
        parts: list[tuple[int, int] | _Value] = []
        for part in _PARTS.finditer(value) if _PARTS.match(value) else ():
            a, b = begin + part.start(), begin + part.end()
            if part[0][0] in "\"'":
                parts.append((a + 1, b - 1))
            elif (known := constants.get(part[0])) and known.parts:
                parts.append(known)
        if not parts and not re.search(r"[\"'(){}]", value):
            parts = [(begin, pair.end(2))]
        constants[name] = given = _Value(parts)
        if parts and (weight := name_weight(name)) and weight * _strength(given.make_up(text)) >= THRESHOLD:
            given.tell(found)
    return [("lexed", a, b) for a, b in found if b > a]


def secret_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) by start and then kind: code points, end exclusive.  Lexed literals within a
    base span are already told by that."""
    if not text:
        return []
    base = sorted(base_spans(text), key=lambda x: x[1])
    begins, ends = [a for _, a, _ in base], list(accumulate((b for *_, b in base), max))
    more = [x for x in lexed_spans(text) if not ((k := bisect_right(begins, x[1])) and ends[k - 1] >= x[2])]
    return sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """`docs` with a column of spans: array<struct<kind, start, end>>, sorted; empty for null and empty texts.

    All rows stay, repeated ones too; a column named `spans_col` is replaced.
    """

    @F.arrow_udf("array<struct<kind: string, start: bigint, end: bigint>>")
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("kind", "start", "end"), s)) for s in secret_spans(x.as_py())] for x in texts], _SPANS)

    return docs.withColumn(spans_col, spans(F.col(text_col)))


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def number(spans: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """`docs` with every secret in `text_col` replaced by `mask`; overlapping spans count as one.  Null stays null."""

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts:
            text = x.as_py()
            at, parts = 0, []
            for _, a, b in secret_spans(text):
                if a >= at:
                    parts += [text[at:a], mask]
                at = max(at, b)
            out.append(text if not parts else "".join(parts) + text[at:])
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, masked(F.col(text_col)))
