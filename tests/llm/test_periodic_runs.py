"""Periodic runs against a quadratic search, and the grammar's extensions against letter-by-letter ones."""

import random
import re

import numpy as np
import pyarrow as pa
from helpers import empty, table

from wardline.llm import periodic_runs as P


def brute(words, least=24, repeats=3):
    found, n = {}, len(words)
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > s and i - s + q >= max(least, repeats * q):
                found.setdefault((s, i - s + q), q)
            i += i == s
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_words(rnd):
    out, letters = [], "abcdef"[:rnd.randint(2, 5)]
    for _ in range(rnd.randint(0, 6)):
        base = [rnd.choice(letters) for _ in range(rnd.randint(1, 9))]
        out += base * rnd.randint(1, 9) + base[:rnd.randint(0, len(base))] if rnd.random() < 0.5 else base
    return out


def test_runs_against_a_quadratic_search():
    rnd = random.Random(1)
    for least, repeats in ((24, 3), (6, 2), (4, 3), (1, 2)):
        for _ in range(120):
            docs = [some_words(rnd) for _ in range(rnd.randint(1, 12))]
            texts = [rnd.choice(["", " "]) + rnd.choice([" ", "\n", "\t \x0b", "\r\n"]).join(d) + rnd.choice(["", "\x0c"]) for d in docs]
            for d, got in zip(docs, P.runs_of(pa.array(texts), least, repeats).to_pylist(), strict=True):
                want = brute(d, least, repeats)
                assert [(r["start"], r["length"], r["period"]) for r in got["runs"]] == want
                assert got["n_words"] == len(d) and got["collapsed"] == collapsed(d, want)


def test_extensions_on_the_grammar():
    rnd = random.Random(2)
    for n, k in ((2, 1), (40, 1), (200, 2), (400, 3), (400, 30)):
        t = np.array([100] + [rnd.randrange(k) for _ in range(n)] * rnd.randint(1, 3) + [101])
        i = np.array([rnd.randrange(1, len(t) - 1) for _ in range(500)])
        j = np.array([rnd.randrange(1, len(t)) for _ in range(500)])
        i, j = np.minimum(i, j), np.maximum(i, j)
        i, j = i[i < j], j[i < j]
        grammar = P.Grammar(t)
        assert len(np.unique(grammar.levels[-1])) == len(grammar.levels[-1])
        on, before = grammar.extend(i, j), grammar.extend(i, j, back=True)
        for a, b, x, y in zip(i, j, on, before, strict=True):
            want = 0
            while t[a + want] == t[b + want]:
                want += 1
            assert x == want
            want = 0
            while t[a - 1 - want] == t[b - 1 - want]:
                want += 1
            assert y == want


def test_queries_in_several_pieces(monkeypatch):
    text = "a b " * 400 + "x " + "a a c " * 100
    whole = P.runs_of(pa.array([text, text]), 24, 3)
    monkeypatch.setattr(P, "QUERIES_AT_ONCE", 7)
    assert P.runs_of(pa.array([text, text]), 24, 3) == whole


def test_frames(spark):
    texts = [None, "", " \n", "a", "a " * 23, "a " * 24, "one two " * 12, "É é " * 30, "word " * 100_000,
             "p q r " * 9 + "x " + "s t " * 20, "a b " * 24, " ".join(map(str, range(30_000))) + " z" * 30]
    rows = list(enumerate(texts)) + [(6, texts[6]), (None, texts[5])]
    for clashes in (False, True):
        docs = table(spark, rows, clashes)
        got = P.periodic_runs(docs).collect()
        assert len(got) == len(rows) and got[0].asDict().keys() == {*docs.columns, "periodic"}
        for r in got:
            words = re.findall("[^\x20\x09-\x0d]+", r.text or "")
            if len(words) < 1000:
                want = brute(words)
                assert [tuple(x) for x in r.periodic.runs] == want and r.periodic.collapsed == collapsed(words, want)
            assert r.periodic.n_words == len(words)
            assert not clashes or r.n == "x"
    by_id = {r.doc_id: r.periodic for r in got}
    assert [tuple(x) for x in by_id[8].runs] == [(0, 100_000, 1)] and by_id[8].collapsed == "word"
    assert [tuple(x) for x in by_id[11].runs] == [(30_000, 30, 1)]
    assert by_id[4].runs == [] and [tuple(x) for x in by_id[5].runs] == [(0, 24, 1)]
    assert P.periodic_runs(empty(spark)).count() == 0
