"""Secrets by assignment-aware lexing of source and configuration text.

Base patterns are applied to every whole text and always stay. The lexer adds
literals that they miss:

1. A text that names a sensitive word anywhere is cut into tokens: strings with their
   escapes, dotted and dashed names, numbers, operators, line ends.
2. Name-literal pairs are read from assignments (``=``, ``:=``, ``=>``, ``:``, also with a type before
   the sign, subscripts and quoted keys), attributes, bare values of configuration lines,
   command-line options (``--name value``) and calls that take a name and a value
   (``put("name", "value")``).
3. Constants are propagated in reading order: a value is made of literals, of names
   assigned before and of both joined (``+`` or side by side). Values are linked to what they
   are made of, never written out, so work stays in proportion to the text.
4. The target's name is split into words (camel case, dashes, dots). A name is as sensitive as
   its last telling word, so ``token_count`` or ``password_file`` are not. The value is scored by length,
   kinds and variety of characters; place holders and prose score below any name. The literals of
   a pair that reaches THRESHOLD are spans, without their quotes, wherever they are written.

Defined results: null and empty texts have no spans; repeated rows give a row
each; an empty table gives an empty table; other columns stay, whatever their names (``out`` apart).
A task holds the tokens of one text at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import PIECE_BYTES, blocks_of

KINDS = ("assign", "access", "hex")
THRESHOLD = 4

# Base patterns (fixed by the query's contract); a run too short for {n,} fails at each of its places.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED = 12

# Last words of names and how sensitive they make the name.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "pass": 2, "secret": 3, "secrets": 3, "credential": 3, "credentials": 3,
    "token": 2, "tokens": 2, "apikey": 3, "apitoken": 3, "authtoken": 3, "accesskey": 3, "secretkey": 3, "privatekey": 3,
    "authorization": 2, "auth": 1, "bearer": 2, "cookie": 1, "signature": 1, "pin": 1,
}
# Words that make a key a secret one when they stand before "key".
KEYS = frozenset("api access secret private signing encryption master auth account storage deploy ssh service shared".split())
STEM = re.compile("passw|passphrase|pwd|pass|secret|credential|token|key|auth|bearer|cookie|signature|pin", re.ASCII | re.IGNORECASE)
PLACE_HOLDER = re.compile(
    r"""change.?me|your[_ -]|example|placeholder|redacted|dummy|todo|xxx|\*\*\*|\.\.\.|<[^<>]*>|\$\{|\{\{|%\(|\$\(|^\$\w+$|^%\w+%$
        |^(?:null|none|nil|true|false|undefined|default|test|string|secret|password|token)$""", re.IGNORECASE | re.VERBOSE)
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

TOKEN = re.compile(r'''
    (?P<open>[rbuf]{0,2}["`] | (?<!\w)[rbuf]{0,2}')
  | (?P<option>(?<!\S)--[A-Za-z][\w-]*)
  | (?P<name>[A-Za-z_$][\w$]*(?:(?:\.|->|::|-)[A-Za-z_$][\w$]*)*)
  | (?P<number>[0-9][\w.]*)
  | (?P<sign>===|==|!=|<=|>=|=>|:=|::|\+=|[=:+,;()\[\]{}<>])
  | (?P<line>\n)
  | (?P<other>[^\s])''', re.VERBOSE | re.DOTALL | re.ASCII)
BODY = {q: re.compile(p) for q, p in (('"', r'(?:[^"\\\n]|\\.)*+'), ("'", r"(?:[^'\\\n]|\\.)*+"), ("`", r"[^`\n]*+"))}
# The rest of a configuration line: one word without quotes, perhaps with a comment after it.
BARE = re.compile(r"[ \t]*+([^\s\"'`,;]++)(?=[ \t]*+(?:\r?\n|\Z)|[ \t]++[#;])")
ARGUMENT = re.compile(r"[ \t]++([^\s\"'`-][^\s\"'`]*+)")
# What may stand before the name on such a line, or on one of a shell script.
LINE_START = frozenset({"export", "set", "setx", "ENV", "ARG", "-"})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Base spans (start, end, kind): leftmost, non-overlapping within a kind, failing matches dropped."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def name_score(name: str) -> int:
    """How sensitive a name is: 0 (not) to 3, by its last word."""
    words = [w.lower() for w in WORDS.findall(name)]
    while words and words[-1].isdigit():
        words.pop()
    if not words:
        return 0
    if words[-1] == "key":
        return 3 if len(words) > 1 and words[-2] in KEYS else 0
    if words[-1] == "string" and words[-2:-1] == ["connection"]:
        return 2
    return SENSITIVE.get(words[-1], 0)


class Value:
    """A literal (``span``) or what is joined from other values; length, kinds and variety of characters in all."""

    __slots__ = ("length", "kinds", "chars", "span", "parts", "odd", "told")

    def __init__(self, text: str = "", span: tuple[int, int] | None = None, parts: tuple = ()):
        self.span, self.parts, self.told = span, parts, False
        if span:
            self.length = len(text)
            self.kinds = (bool(re.search("[a-z]", text)) | bool(re.search("[A-Z]", text)) << 1 | bool(re.search("[0-9]", text)) << 2
                          | bool(re.search(r"[^\w\s]", text)) << 3 | bool(re.search(r"\s", text)) << 4)
            self.chars = 0
            for c in set(text):
                self.chars |= 1 << (ord(c) & 127)
            self.odd = bool(PLACE_HOLDER.search(text)) or bool(re.match(r"(?:https?://[^@]*$|/|\./|[A-Za-z]:\\)", text))
        else:
            self.length, self.kinds, self.chars, self.odd = 0, 0, 0, False
            for p in parts:
                self.length += p.length
                self.kinds |= p.kinds
                self.chars |= p.chars
                self.odd |= p.odd

    def score(self) -> int:
        """How much it looks like a secret: -9 (place holder) to 4."""
        if self.odd or self.length < 6:
            return -9
        several = bin(self.kinds & 15).count("1")
        out = (self.length >= 8) + (self.length >= 20) + (several >= 2) + (several >= 3)
        out -= 3 * bool(self.kinds & 16)  # white space: prose
        variety = bin(self.chars).count("1")
        return out - 2 * (variety < 4) - (several == 1 and self.length < 20)

    def tell(self, spans: set[tuple[int, int]]) -> None:
        """Add the spans of all literals it is made of; each value is gone through once."""
        left = [self]
        while left:
            v = left.pop()
            if not v.told:
                v.told = True
                if v.span:
                    spans.add(v.span)
                left.extend(v.parts)


def _tokens(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, end); of strings what stands between the quotes."""
    out, at, blocked = [], 0, dict.fromkeys(BODY, 0)
    triple = True
    while m := TOKEN.search(text, at):
        at = m.end()
        if m.lastgroup != "open":
            out.append((m.lastgroup, m[0], m.start(), at))
            continue
        quote = text[at - 1]
        if triple and text.startswith('"""', at - 1):
            close = text.find('"""', at + 2)
            triple = close >= 0
            if triple:
                out.append(("text", text[at + 2:close], at + 2, close))
                at = close + 3
                continue
        if at > blocked[quote]:
            end = BODY[quote].match(text, at).end()
            if text[end:end + 1] == quote:
                out.append(("text", text[at:end], at, end))
                at = end + 1
                continue
            blocked[quote] = end  # nothing up to there closes a string
        out.append(("other", quote, at - 1, at))
    return out


def _expression(tokens: list, i: int, known: dict[str, Value]) -> tuple[Value | None, int]:
    """Value of the terms from token i on, joined by ``+`` or side by side, and the token after them."""
    parts, n, whole = [], len(tokens), True
    while i < n:
        kind, word, start, end = tokens[i]
        if kind == "text":
            parts.append(Value(word, (start, end)))
        elif kind == "name":
            called = i + 1 < n and tokens[i + 1][1] in ("(", "[")
            found = None if called else known.get(word)
            if found is None:
                whole = False
            else:
                parts.append(found)
            if called:
                return (Value(parts=tuple(parts)) if parts else None), i + 1
        elif kind == "number":
            whole = False
        else:
            break
        i += 1
        if i < n and tokens[i][1] == "+":
            i += 1
            while i < n and tokens[i][0] == "line":
                i += 1
        elif not (i < n and kind == "text" and tokens[i][0] == "text"):
            break
    if not parts:
        return None, i
    return (parts[0] if len(parts) == 1 and whole else Value(parts=tuple(parts))), i


def _target(tokens: list, i: int) -> str:
    """Name that stands just before token i: a name, a quoted key, a subscript with a quoted key; a type between is passed."""
    if i < 1:
        return ""
    kind, word = tokens[i - 1][:2]
    if kind in ("name", "text", "option"):
        if kind == "name" and i >= 3 and tokens[i - 2][1] == ":" and tokens[i - 3][0] == "name" and tokens[i][1] == "=":
            return tokens[i - 3][1]  # name: Type = value
        return word
    if word == "]" and i >= 3 and tokens[i - 2][0] in ("text", "name"):
        return tokens[i - 2][1]
    return ""


def _starts_line(tokens: list, i: int) -> bool:
    """Whether token i is the first of its line but for words of LINE_START."""
    while i > 0 and tokens[i - 1][1] in LINE_START:
        i -= 1
    return i == 0 or tokens[i - 1][0] == "line"


def pairs(text: str) -> Iterator[tuple[str, Value]]:
    """(target name, value) of every pair of the text in reading order, constants propagated."""
    tokens, known = _tokens(text), {}
    for i, (kind, word, _, end) in enumerate(tokens):
        value, target = None, ""
        if word in ("=", ":=", "=>", ":", "+=") and kind == "sign":
            target = _target(tokens, i)
            if not target:
                continue
            value, _ = _expression(tokens, i + 1, known)
            if tokens[i - 1][0] == "name" and word in ("=", ":") and _starts_line(tokens, i - 1):
                bare = BARE.match(text, end)
                if bare and bare[1] not in known and "(" not in bare[1]:
                    value = Value(bare[1], bare.span(1))
            if value is not None and tokens[i - 1][0] == "name":
                if word == "+=" and target in known:
                    value = Value(parts=(known[target], value))
                known[target] = value
            elif tokens[i - 1][0] == "name" and word == "=":
                known.pop(target, None)  # it holds something else now
        elif kind == "option" and i + 1 < len(tokens):
            target, argument = word, ARGUMENT.match(text, end)
            if tokens[i + 1][0] == "text":
                value = Value(tokens[i + 1][1], tokens[i + 1][2:])
            elif argument:
                value = known.get(argument[1]) or Value(argument[1], argument.span(1))
        elif word == "," and i >= 2 and tokens[i - 1][0] == "text" and tokens[i - 2][1] == "(":
            target = tokens[i - 1][1]
            value, after = _expression(tokens, i + 1, known)
            if value is not None and after < len(tokens) and tokens[after][1] not in (")", ","):
                value = None
        if value is not None:
            yield target, value


def assigned_literals(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that sensitive names are given."""
    if not STEM.search(text):
        return []
    spans: set[tuple[int, int]] = set()
    for target, value in pairs(text):
        sensitive = name_score(target)
        if sensitive and sensitive + value.score() >= THRESHOLD:
            value.tell(spans)
    return sorted(s for s in spans if s[0] < s[1])


def find_spans(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of a text; added ones touch no base span."""
    if not text:
        return [], []
    base = base_spans(text)
    reach, furthest = [], 0
    for _, e, _ in base:
        furthest = max(furthest, e)
        reach.append(furthest)
    starts = [s for s, _, _ in base]
    added = []
    for s, e in assigned_literals(text):
        before = bisect_right(starts, e - 1)
        if not (before and reach[before - 1] > s):
            added.append((s, e, "assign"))
    return base, sorted(base + added, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


SCHEMA = "n_assign long, n_access long, n_hex long, base string, spans string"


def scan_secrets(docs: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with a struct: base counts, base spans and all spans as kind:start:end (code points, end exclusive)."""
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for piece, in blocks_of(PIECE_BYTES, texts):
                for text in piece.to_pylist():
                    base, spans = find_spans(text)
                    rows.append((*(sum(s[2] == k for s in base) for k in KINDS), _joined(base), _joined(spans)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.StructArray.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()] * 2, strict=True)],
                ["n_assign", "n_access", "n_hex", "base", "spans"])

    find.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(out, F.arrow_udf(find, SCHEMA)(F.col(text_col)))
