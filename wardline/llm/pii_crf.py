"""Personal data by a linear-chain conditional random field over word shapes.

The field labels white-space tokens O, email, ip, card or phone. Its features
are word shapes (letter runs, digit runs with length classes, other characters),
those of the neighbours, and two checks (Luhn, octets at most 255). It is
trained from the small labelled table SEED_ROWS by gradient ascent with
forward-backward sums, and decoded by Viterbi in numpy batches. A token without
a digit or an @ can only be O, in training too; such tokens part a text into
runs that are decoded independently, which is exact.

Base patterns are applied to every whole text and always stay; the field adds
spans that touch no base span.

Defined results: null and empty texts have no spans; repeated rows give a row
each; an empty table gives an empty table; other columns are ignored. Searching
takes time in proportion to the text, also for long runs without a gap.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
MARGIN = 2.0
EPOCHS, RATE, DECAY = 120, 0.15, 0.01

# The labelled table: text with [kind text] around personal data.
SEED_ROWS = (
    "write to [email ana.perez@mail.example.org] before noon",
    "from [email bob_77@host9.example.com], sent twice",
    "([email x.y+news@sub.example.co.uk])",
    "contact: [email info@example.net].",
    "addresses [email a@b.io] and [email c.d@e.example]",
    "ping @maria or @team42 in the channel",
    "meet @ 5 pm near gate 7",
    "login from [ip 10.20.30.40] at 12:45",
    "hosts [ip 192.168.1.254], [ip 8.8.4.4]",
    "server [ip 172.16.254.1]: up",
    "version 4.12.7 was replaced by 5.0.1 in 2019",
    "section 3.2.1.999 of the 300.400.500.600 report",
    "license version 2.0 or CC BY-NC 4.0.",
    "card [card 4539578763621486] expired",
    "paid with [card 4532 0151 1283 0366] yesterday",
    "number [card 6011-0009-9013-9424].",
    "card [card 378282246310005] on file",
    "order 4539578763621487 was shipped",
    "serial 1234567890123456 and 9999888877776666",
    "call [phone +1 (555) 010-4477] today",
    "phone [phone +44 20 7946 0958] or fax",
    "tel [phone (212) 555-0187] ext 4",
    "mobile [phone 555-867-5309], evenings",
    "cell [phone 415-555-0132]",
    "reach me at [phone (030) 555-7788] please",
    "[phone +49 30 901820] is the office",
    "in 1999 there were 250 people and 3,000 birds",
    "pages 12-14 and 2020-2021 cover it",
    "date 2021-03-14 or 14/03/2021 at 09:30",
    "token = 6df57b16f87eabefefcab67b433efd90636bb6bd",
    "key \"ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e\" leaked",
    "price 19.99 or 1.250.000 in total, 45% off",
    "chapter 7 verse 12 line 300",
    "item 555-12 and model 8-4-2",
    "score 3-2 after 90 minutes (2019)",
)
_MARK = re.compile(r"\[(email|ip|card|phone) ([^\]]*)\]")

TOKEN = re.compile(r"\S+")
LIVE = re.compile(r"[0-9@]")
LIVE_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
_EDGE = "()[]{}<>\"'.,;:!?#%&*$"

# Base patterns (fixed by the query's contract), written so that no search is repeated over a run.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Base spans by kind: leftmost, non-overlapping, failing matches dropped."""
    out = {k: [] for k in KINDS}
    free = 0
    at = text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            start = at
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out["email"].append((start, m.end()))
                free = m.end()
        # the characters before the next @ are looked at once more at most
        at = text.find("@", max(at + 1, free))
    for m in DOTTED.finditer(text):
        parts, pos = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = pos + sum(map(len, four)) + 3
            if all(map(_small, four)):
                out["ip"].append((pos, end))
            pos = end + 1
    for m in CARD.finditer(text):
        digits = _only_digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out["phone"].append(m.span())
    return out


@lru_cache(maxsize=1 << 16)
def shape(token: str) -> str:
    """Letter runs as a, digit runs as d with a length class, other characters as they are; long shapes are one class."""
    if len(token) > 64:
        return "long"
    core = token.strip(_EDGE)
    s = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: "d%d" % min(len(m[0]), 5) if len(m[0]) < 13 else "dd", core))
    if "@" not in s and s.count("a") > 2 and "d" in s:
        s = "mixed"
    if s.startswith("d") and "(" not in s and token.startswith("("):
        s = "(" + s
    return s[:24]


@lru_cache(maxsize=1 << 16)
def _features(before: str, token: str, after: str) -> tuple[str, ...]:
    """Feature names of a token between two neighbours (empty: edge of a run)."""
    s, core = shape(token), token.strip(_EDGE)
    out = ["bias", "s=" + s, "p=" + shape(before), "n=" + shape(after),
           "kind=" + re.sub(r"\d", "", s), "+" if core.startswith("+") else "no+"]
    if re.fullmatch(r"[^@\s]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", core) and len(core) <= 64:
        out.append("mail")
    parts = core.split(".") if len(core) <= 64 else []
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
        out.append("octets" if all(map(_small, parts)) else "not octets")
    digits = _only_digits(core) if len(core) <= 64 else ""
    if 13 <= len(digits) <= 19:
        out.append("luhn" if luhn(digits) else "not luhn")
    return tuple(out)


def _runs(text: str) -> list[list[tuple[int, int]]]:
    """Spans of tokens with a digit or an @, in runs that no other token parts."""
    runs: list[list[tuple[int, int]]] = []
    for m in LIVE_TOKEN.finditer(text):
        if runs and text[runs[-1][-1][1]:m.start()].isspace():
            runs[-1].append(m.span())
        else:
            runs.append([m.span()])
    return runs


class Field:
    """Weights of the field: feature by label, label by label, and at the ends of a run."""

    def __init__(self, names: dict[str, int]):
        k = len(LABELS)
        self.names = names
        self.emit = np.zeros((len(names), k))
        self.move = np.zeros((k, k))
        self.ends = np.zeros((2, k))

    def scores(self, tokens: list[str]) -> np.ndarray:
        out = np.zeros((len(tokens), len(LABELS)))
        for i, t in enumerate(tokens):
            found = _features(tokens[i - 1] if i else "", t, tokens[i + 1] if i + 1 < len(tokens) else "")
            out[i] = self.emit[[self.names[f] for f in found if f in self.names]].sum(axis=0)
        return out


def _seed() -> list[tuple[list[str], list[int]]]:
    """Runs of live tokens of the labelled table with their labels."""
    out = []
    for row in SEED_ROWS:
        marks, plain, at = [], "", 0
        for m in _MARK.finditer(row):
            plain += row[at:m.start()]
            marks.append((len(plain), len(plain) + len(m[2]), LABELS.index(m[1])))
            plain, at = plain + m[2], m.end()
        plain += row[at:]
        for run in _runs(plain):
            labels = [next((k for a, b, k in marks if s < b and e > a), 0) for s, e in run]
            out.append(([plain[s:e] for s, e in run], labels))
    return out


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


@lru_cache(maxsize=1)
def train() -> Field:
    """Fit the field to the labelled table (maximum likelihood with weight decay)."""
    seed = _seed()
    names = {f: i for i, f in enumerate(sorted({
        f for tokens, _ in seed for i, t in enumerate(tokens)
        for f in _features(tokens[i - 1] if i else "", t, tokens[i + 1] if i + 1 < len(tokens) else "")}))}
    field, k = Field(names), len(LABELS)
    for _ in range(EPOCHS):
        emit, move, ends = -DECAY * field.emit, -DECAY * field.move, -DECAY * field.ends
        for tokens, gold in seed:
            s, n = field.scores(tokens), len(tokens)
            fwd, bwd = np.zeros((n, k)), np.zeros((n, k))
            fwd[0] = field.ends[0] + s[0]
            for i in range(1, n):
                fwd[i] = s[i] + _log_sum(fwd[i - 1][:, None] + field.move, 0)
            bwd[-1] = field.ends[1]
            for i in range(n - 2, -1, -1):
                bwd[i] = _log_sum(field.move + (s[i + 1] + bwd[i + 1])[None], 1)
            total = _log_sum(fwd[-1] + field.ends[1], 0)
            missing = -np.exp(fwd + bwd - total)
            missing[np.arange(n), gold] += 1
            for i, t in enumerate(tokens):
                found = _features(tokens[i - 1] if i else "", t, tokens[i + 1] if i + 1 < n else "")
                for f in found:
                    emit[names[f]] += missing[i]
                if i:
                    move -= np.exp(fwd[i - 1][:, None] + field.move + (s[i] + bwd[i])[None] - total)
                    move[gold[i - 1], gold[i]] += 1
            ends[0] += missing[0]
            ends[1] += missing[-1]
        field.emit += RATE * emit
        field.move += RATE * move
        field.ends += RATE * ends
    return field


def viterbi(field: Field, scores: list[np.ndarray]) -> list[np.ndarray]:
    """Best labels of each run; runs of like length are decoded together."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    by_length = defaultdict(list)
    for i, s in enumerate(scores):
        by_length[len(s)].append(i)
    for n, members in by_length.items():
        s = np.stack([scores[i] for i in members])
        best, back = field.ends[0] + s[:, 0], np.zeros((n, len(members), len(LABELS)), np.int8)
        for t in range(1, n):
            step = best[:, :, None] + field.move
            back[t] = step.argmax(axis=1)
            best = step.max(axis=1) + s[:, t]
        at = (best + field.ends[1]).argmax(axis=1)
        path = np.zeros((len(members), n), np.int64)
        for t in range(n - 1, -1, -1):
            path[:, t] = at
            at = back[t][np.arange(len(members)), at]
        for i, p in zip(members, path, strict=True):
            out[i] = p
    return out


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    while end > start and text[end - 1] in _EDGE:
        end -= 1
    while start < end and text[start] in _EDGE and not (text[start] == "(" and ")" in text[start:end]):
        start += 1
    return start, end


def _plausible(kind: str, span: str) -> bool:
    """The digits of a card or phone found by the field must be as many as such a number has."""
    digits = _only_digits(span)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 7 <= len(digits) <= 15


def find_batch(texts: list[str | None], field: Field) -> list[tuple[dict, list[tuple[str, int, int]]]]:
    """(base spans by kind, all spans in order) of each text."""
    base = [base_spans(t) if t and LIVE.search(t) else {k: [] for k in KINDS} for t in texts]
    runs = [(i, run) for i, t in enumerate(texts) if t and LIVE.search(t) for run in _runs(t)]
    scores = [field.scores([texts[i][s:e] for s, e in run]) for i, run in runs]
    added: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    taken = [sorted(s for spans in b.values() for s in spans) for b in base]
    reach = [list(accumulate((e for _, e in spans), max)) for spans in taken]  # furthest end so far
    for (i, run), score, labels in zip(runs, scores, viterbi(field, scores), strict=True):
        edges = np.flatnonzero(np.diff(labels)) + 1
        for part in np.split(np.arange(len(labels)), edges):
            kind = LABELS[labels[part[0]]]
            gain = (score[part, labels[part[0]]] - score[part, 0]).sum()
            if kind == "O" or gain < MARGIN:
                continue
            whole = _trim(texts[i], run[part[0]][0], run[part[-1]][1])
            # several numbers side by side are spans of their own
            spans = [whole] if _plausible(kind, texts[i][slice(*whole)]) else [_trim(texts[i], *run[j]) for j in part]
            for s, e in spans:
                before = bisect_left(taken[i], (e,))
                touched = before and reach[i][before - 1] > s
                if e > s and not touched and _plausible(kind, texts[i][s:e]):
                    added[i].append((kind, s, e))
    out = []
    for b, more in zip(base, added, strict=True):
        spans = [(k, s, e) for k in KINDS for s, e in sorted(b[k] + [(s, e) for kind, s, e in more if kind == k])]
        out.append((b, spans))
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string"
_ROWS = 500


def find_personal_data(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with a struct: base counts, base spans and all spans (code points, end exclusive)."""
    shared = docs.sparkSession.sparkContext.broadcast(train())

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for at in range(0, len(texts), _ROWS):
                for b, spans in find_batch(texts.slice(at, _ROWS).to_pylist(), shared.value):
                    flat = [(k, s, e) for k in KINDS for s, e in b[k]]
                    rows.append((*(len(b[k]) for k in KINDS), _joined(flat), _joined(spans)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.StructArray.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()] * 2, strict=True)],
                ["n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    find.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(out, F.arrow_udf(find, SCHEMA)(F.col(text_col)))

