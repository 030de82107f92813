"""Language identification by a byte convolutional network in numpy.

A text is cut into windows of WINDOW bytes (the last one padded), whole texts
always. Bytes are embedded, filters of several widths slide over a window, each
filter keeps its maximum, and a softmax over these gives the window's
languages. A text's score is the softmax of its windows' mean log-probability.

Training takes a bounded sample: at most SAMPLE_PER_LANG documents of each
language, those of smallest id hash, and of each the first, middle and last
window. Applying the network is table look-ups, two bytes at a time.

Defined results: a text that is null or has no letter is ``und`` with score 0,
and so is every text when there is no labelled row; with a single language
every text with a letter is of that language; repeated rows give a row each;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import string_buffers

WINDOW = 256
SAMPLE_PER_LANG = 1_500
DIM = 8
FILTERS = 16
WIDTHS = (2, 3, 4)
STEPS, BATCH, RATE = 450, 128, 0.01
WINDOWS_AT_ONCE = 64
PAD = max(WIDTHS) - 1
UNDETERMINED = "und"
LANG_ID_SEED = 7


def _alphabet() -> np.ndarray:
    """Byte classes, numbered from 0: case folded (Latin-1 supplement too), digits as one, other ASCII a gap (0)."""
    b = np.arange(256)
    out = np.where(b >= 0x80, b, 0)
    out[(b >= 0x80) & (b <= 0x9F)] += 0x20
    letters = (b >= 97) & (b <= 122)
    out[letters] = b[letters]
    out[65:91] = b[97:123]
    out[48:58] = 48
    return np.unique(out, return_inverse=True)[1].astype(np.uint8)


ALPHABET = _alphabet()
CLASSES = int(ALPHABET.max()) + 1


@dataclass
class Network:
    langs: list[str]
    tables: list[list[np.ndarray]]  # per width, per offset: (CLASSES, FILTERS)
    bias: list[np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray

    def paired(self) -> Network:
        """The same network with look-ups of two bytes at a time, for fast application."""
        def pair(first, second):
            return (first[:, None] + second[None]).reshape(CLASSES * CLASSES, -1)
        t2, t3, t4 = self.tables
        self.heads = np.concatenate([pair(*t2), pair(*t3[:2]), pair(*t4[:2])], axis=1)
        self.tail3, self.tail4, self.all_bias = t3[2], pair(*t4[2:]), np.concatenate(self.bias)
        return self

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities of each window (rows of byte classes); needs ``paired()``."""
        pairs = x[:, :-1].astype(np.intp) * CLASSES + x[:, 1:]
        acc = np.take(self.heads, pairs[:, :WINDOW], axis=0)
        acc[:, :, FILTERS:2 * FILTERS] += np.take(self.tail3, x[:, 2:WINDOW + 2], axis=0)
        acc[:, :, 2 * FILTERS:] += np.take(self.tail4, pairs[:, 2:WINDOW + 2], axis=0)
        return _log_softmax(np.maximum(acc.max(axis=1) + self.all_bias, 0) @ self.dense + self.dense_bias)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _pooled(x: np.ndarray, tables, bias):
    """Each filter's maximum over a window (after bias and ReLU) and its place, by width."""
    values, where = [], []
    for per_offset, b in zip(tables, bias, strict=True):
        acc = np.take(per_offset[0], x[:, :WINDOW], axis=0)
        for j in range(1, len(per_offset)):
            acc += np.take(per_offset[j], x[:, j:j + WINDOW], axis=0)
        where.append(acc.argmax(axis=1))
        values.append(np.maximum(acc.max(axis=1) + b, 0))
    return np.concatenate(values, axis=1), where


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], seed: int = LANG_ID_SEED) -> Network:
    """Train by Adam on windows ``x`` (byte classes) with language indices ``y``."""
    rng = np.random.default_rng(seed)
    p = {"emb": rng.normal(0, 0.5, (CLASSES, DIM)).astype(np.float32)}
    for k in WIDTHS:
        p[f"w{k}"] = rng.normal(0, 1 / np.sqrt(k * DIM), (k, DIM, FILTERS)).astype(np.float32)
        p[f"b{k}"] = np.zeros(FILTERS, np.float32)
    p["dense"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32)
    p["dense_bias"] = np.zeros(len(langs), np.float32)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    # rows are drawn so that languages weigh alike
    by_lang = [np.flatnonzero(y == c) for c in range(len(langs))]

    def tables():
        return [[p["emb"] @ p[f"w{k}"][j] for j in range(k)] for k in WIDTHS]

    for step in range(1, STEPS + 1):
        rows = np.array([rng.choice(by_lang[c]) for c in rng.integers(0, len(langs), BATCH)])
        xb, yb = x[rows], y[rows]
        pooled, where = _pooled(xb, tables(), [p[f"b{k}"] for k in WIDTHS])
        dz = np.exp(_log_softmax(pooled @ p["dense"] + p["dense_bias"]))
        dz[np.arange(BATCH), yb] -= 1
        dz /= BATCH
        g = {"dense": pooled.T @ dz, "dense_bias": dz.sum(axis=0), "emb": np.zeros_like(p["emb"])}
        dp = (dz @ p["dense"].T) * (pooled > 0)
        for i, k in enumerate(WIDTHS):
            d = dp[:, i * FILTERS:(i + 1) * FILTERS]
            g[f"b{k}"], g[f"w{k}"] = d.sum(axis=0), np.zeros_like(p[f"w{k}"])
            for j in range(k):  # only the place of each maximum has a gradient
                byte = np.take_along_axis(xb, where[i] + j, axis=1)
                g[f"w{k}"][j] = np.einsum("bfd,bf->df", p["emb"][byte], d)
                np.add.at(g["emb"], byte, d[:, :, None] * p[f"w{k}"][j].T[None])
        for name, a in p.items():
            m[name] = 0.9 * m[name] + 0.1 * g[name]
            v[name] = 0.999 * v[name] + 0.001 * g[name] ** 2
            a -= RATE * (m[name] / (1 - 0.9 ** step)) / (np.sqrt(v[name] / (1 - 0.999 ** step)) + 1e-8)
    return Network(langs, tables(), [p[f"b{k}"] for k in WIDTHS], p["dense"], p["dense_bias"])


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all rows as (windows, WINDOW + PAD) byte classes, and the row of each."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    rows = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = offsets[rows] + nth * WINDOW
    length = np.minimum(offsets[rows + 1] - begin, WINDOW)
    at = begin[:, None] + np.arange(WINDOW + PAD)
    inside = np.arange(WINDOW + PAD) < length[:, None]
    return np.where(inside, ALPHABET[data[np.minimum(at, len(data) - 1)]], 0).astype(np.uint8), rows


def predict_batch(texts: pa.Array, net: Network) -> tuple[np.ndarray, np.ndarray]:
    """Language index and score per text; texts without bytes get -1 and 0."""
    data, offsets = string_buffers(texts)
    n = len(offsets) - 1
    total = np.zeros((n, len(net.langs)))
    starts = np.arange(n)
    windows = -(-np.diff(offsets) // WINDOW)
    # a slice of rows at a time; a long row is cut into spans of whole windows
    span = WINDOW * WINDOWS_AT_ONCE
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + span, side="right")) - 1)
        for a in range(int(offsets[lo]), max(int(offsets[hi]), int(offsets[lo]) + 1), span if hi == lo + 1 else 1 << 62):
            b = min(a + span, int(offsets[hi])) if hi == lo + 1 else int(offsets[hi])
            if b > a:
                x, rows = windows_of(data[a:b], np.clip(offsets[lo:hi + 1], a, b) - a)
                np.add.at(total, starts[lo:hi][rows], net.log_probs(x))
        lo = hi
    mean = total / np.maximum(windows, 1)[:, None]
    best = np.where(windows > 0, mean.argmax(axis=1), -1)
    score = np.where(windows > 0, np.exp(_log_softmax(mean)).max(axis=1), 0.0)
    return best, score


def _sample_windows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        data, offsets = string_buffers(texts)
        out = []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            middle = a + (b - a - WINDOW) // 2
            begins = [a] if b - a <= WINDOW else [a, b - WINDOW] if b - a <= 2 * WINDOW else [a, middle, b - WINDOW]
            padded = np.zeros((len(begins), WINDOW + PAD), np.uint8)
            for row, begin in zip(padded, begins, strict=True):
                part = data[begin:min(begin + WINDOW, b)]
                row[:len(part)] = ALPHABET[part]
            out.append(padded.tobytes())
        yield pa.array(out, pa.binary())


_sample_windows.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}


def has_letter(text):
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Fit on a bounded sample of labelled documents; None when there is none."""
    texts = docs.filter(has_letter(F.col(text_col)) & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    texts = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang"),
                         F.xxhash64(text_col).alias("th"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    # the rank limit is applied within each task before the shuffle, so a hot language sends few rows
    # repeated rows of an id are one document: its least text hash
    ids = texts.groupBy("id", "lang").agg(F.min("th").alias("th")).withColumn("rank", F.row_number().over(order))
    ids = ids.filter(F.col("rank") <= SAMPLE_PER_LANG).select("id", "lang", "th", "rank").toArrow()
    if ids.num_rows == 0:
        return None
    chosen = F.broadcast(docs.sparkSession.createDataFrame(ids))
    rows = (texts.join(chosen, ["id", "lang", "th"]).dropDuplicates(["id", "lang"])
            .select("lang", "rank", "id", F.arrow_udf(_sample_windows, "binary")("t").alias("x")).toArrow())
    rows = rows.sort_by([("lang", "ascending"), ("rank", "ascending")]).to_pylist()
    langs = sorted({r["lang"] for r in rows})
    x = [np.frombuffer(r["x"], np.uint8).reshape(-1, WINDOW + PAD) for r in rows]
    y = np.repeat([langs.index(r["lang"]) for r in rows], [len(a) for a in x])
    return fit(np.concatenate(x), y, langs)


def language(docs: DataFrame, net: Network | None, text_col: str = "text", out: str = "lang_pred",
             score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language of each whole text and its score."""
    if net is None:
        return docs.withColumns({out: F.lit(UNDETERMINED), score_out: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        paired = shared.value.paired()
        for texts in batches:
            best, score = predict_batch(texts, paired)
            names = np.array([*paired.langs, UNDETERMINED], object)[best]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score)], ["lang", "score"])

    predict.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    letter = has_letter(F.col(text_col))
    found = docs.withColumn("__lang", F.arrow_udf(predict, "lang string, score double")(F.col(text_col)))
    return found.withColumns({out: F.when(letter, F.col("__lang.lang")).otherwise(UNDETERMINED),
                              score_out: F.when(letter, F.col("__lang.score")).otherwise(0.0)}).drop("__lang")
