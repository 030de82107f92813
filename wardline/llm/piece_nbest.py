"""N-best segmentation of texts into the pieces of a SentencePiece vocabulary, and decoding.

A text is a lattice of pieces; the score of a segmentation is the sum of its
pieces' scores. No piece crosses the edge between two segments (a run of spaces
with what follows it, or a newline with what follows), so the lattice is a
chain of small ones:

1. a forward Viterbi pass over each distinct segment gives the best score to
   every position, the best segmentation and the gap to the second best, for
   many segments of one length at a time in numpy;
2. the text's best segmentation joins those of its segments. An n-best
   alternative changes only segments among the n - 1 of smallest gap (any other
   change costs at least as much as n - 1 single ones);
3. for these segments a backward A-star search from the end lists the n best:
   the forward score of a position is the exact best completion, so every
   hypothesis that is popped lies on a segmentation as good as one of the list.
   Of equally good ones the one nearest to the start is popped first, so the
   first goal is the Viterbi segmentation, and no position is popped more than n
   times (a worse way from there to the end is on none of the n best), so a run
   of one character, with very many equally good segmentations, costs n pops a
   place at most.

A character that no piece covers becomes its byte pieces, at the library's
unknown score (least score - 10). Ties prefer longer last pieces. Decoding puts
the pieces together again; encoding and decoding give the text back, but for
the character U+2581, which reads as a space.

Defined results: null and empty texts have no pieces, score 0 and no
alternatives; repeated rows give a row each; an empty table gives an empty
table; other columns stay.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import blocks_of, row_blocks

SEGMENT = re.compile(r" +[^ \n]*|\n[^ \n]*")
SPACE = "▁"
N_BEST = 4
UNKNOWN_PENALTY = 10.0
LONGEST_BATCHED = 48
CACHE_ENTRIES = 100_000
BLOCK_BYTES = 1 << 20
_SLOTS_BITS = 18
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


class Vocabulary:
    """Pieces, scores and a hash table over the vocabulary of a model."""

    def __init__(self, model: bytes):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(self.size)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(self.size)]
        if any(re.search("[^▁]▁|\n", p) for p, s in zip(self.pieces, special, strict=True) if not s):
            raise ValueError("a piece of the vocabulary crosses a space or a newline")
        self.bytes_at = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_ids = set(self.bytes_at.values())
        self.ascii = np.array([self.bytes_at.get(b, -1) for b in range(128)] + [-1], np.int32)
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.score = np.array([sp.get_score(i) for i in range(self.size)], np.float64)
        self.unknown = min(self.score[i] for i in self.ids.values()) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.ids))
        raw = [p.encode() for p in self.pieces]
        for b, i in self.bytes_at.items():
            raw[i] = bytes([b])
        self.raw_start = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        self.raw_flat = np.frombuffer(b"".join(raw), np.uint8)
        self._table()

    def _table(self) -> None:
        """Open addressing by the rolling hash of a piece's code points."""
        self.keys = np.zeros(1 << _SLOTS_BITS, np.uint64)
        self.values = np.full(1 << _SLOTS_BITS, -1, np.int32)
        seen = set()
        for piece, i in self.ids.items():
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in piece:
                    h = h * _STEP + np.uint64(ord(c) + 1)
                slot = int((h * _MULTIPLIER) >> np.uint64(64 - _SLOTS_BITS))
            if int(h) in seen:
                raise ValueError("two pieces share a hash")
            seen.add(int(h))
            while self.values[slot] >= 0:
                slot = (slot + 1) & ((1 << _SLOTS_BITS) - 1)
            self.keys[slot], self.values[slot] = h, i

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of hashes, -1 where there is none."""
        slot = ((h * _MULTIPLIER) >> np.uint64(64 - _SLOTS_BITS)).astype(np.int64)
        out = self.values[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[slot] != h))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << _SLOTS_BITS) - 1)
            found = self.values[slot[open_]]
            out[open_] = found
            open_ = open_[(found >= 0) & (self.keys[slot[open_]] != h[open_])]
        return out

    def spell(self, ids: list[int], text: str) -> list[int]:
        """Replace each -1 (an unknown character) by its byte pieces."""
        if -1 not in ids:
            return ids
        out, at = [], 0
        for i in ids:
            out += [i] if i >= 0 else [self.bytes_at[b] for b in text[at].encode()]
            at += 1 if i < 0 or i in self.byte_ids else len(self.pieces[i])
        return out


def _marked(segment: str) -> str:
    return segment.replace(" ", SPACE)


def best_two(vocab: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward Viterbi over equally long marked segments.

    Returns the ids of all best segmentations in one array, how many each has,
    the best scores and the gaps to the second best.
    """
    length, m = len(texts[0]), len(texts)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(m, length).T.astype(np.uint64) + np.uint64(1)
    best, second = np.full((length + 1, m), -np.inf), np.full((length + 1, m), -np.inf)
    came, piece = np.zeros((length + 1, m), np.int64), np.zeros((length + 1, m), np.int32)
    best[0] = 0.0
    h = np.zeros((0, m), np.uint64)
    columns = np.arange(m)
    for j in range(1, length + 1):
        lo = max(0, j - vocab.longest)
        h = np.concatenate([h[max(0, len(h) + 1 - (j - lo)):], np.zeros((1, m), np.uint64)])
        h = h * _STEP + codes[j - 1]
        ids = vocab.look_up(h.reshape(-1)).reshape(h.shape)
        score = np.where(ids >= 0, vocab.score[ids], -np.inf)
        score[-1] = np.where(ids[-1] >= 0, score[-1], vocab.unknown)
        first = best[lo:j] + score
        at = first.argmax(axis=0)
        best[j] = first[at, columns]
        # an unknown ASCII character is one byte piece; others are spelled at the end
        ids[-1] = np.where(ids[-1] >= 0, ids[-1], vocab.ascii[np.minimum(codes[j - 1] - np.uint64(1), np.uint64(128))])
        came[j], piece[j] = at + lo, ids[at, columns]
        first[at, columns] = -np.inf
        second[j] = np.maximum(first.max(axis=0), (second[lo:j] + score).max(axis=0))
    steps, pos = [], np.full(m, length)
    while pos.any():
        steps.append(np.where(pos > 0, piece[pos, columns], -2))
        pos = came[pos, columns]
    path = np.stack(steps[::-1], axis=1)  # a row per segment, -2 before its first piece
    gap = best[-1] - second[-1]
    if (path != -1).all():
        return path[path >= 0], (path >= 0).sum(axis=1), best[-1], gap
    spelled = [vocab.spell([i for i in row if i != -2], t) for row, t in zip(path.tolist(), texts, strict=True)]
    return (np.fromiter((i for row in spelled for i in row), np.int32), np.array([len(row) for row in spelled]),
            best[-1], gap)


def best_two_long(vocab: Vocabulary, text: str) -> tuple[list[int], float, float]:
    """The same for one segment of any length, position by position."""
    n = len(text)
    best, second = [0.0] + [-np.inf] * n, [-np.inf] * (n + 1)
    came, piece = [0] * (n + 1), [0] * (n + 1)
    get, scores = vocab.ids.get, vocab.score
    for j in range(1, n + 1):
        for i in range(max(0, j - vocab.longest), j):
            p = get(text[i:j], -1)
            if p < 0 and i < j - 1:
                continue
            s = float(scores[p]) if p >= 0 else vocab.unknown
            if best[i] + s > best[j]:
                second[j] = max(best[j], second[i] + s)
                best[j], came[j], piece[j] = best[i] + s, i, p
            else:
                second[j] = max(second[j], best[i] + s)
    ids, at = [], n
    while at:
        ids.append(piece[at])
        at = came[at]
    return vocab.spell(ids[::-1], text), best[n], best[n] - second[n]


def n_best(vocab: Vocabulary, text: str, n: int) -> list[tuple[float, list[int]]]:
    """The ``n`` best segmentations of one marked segment, by backward A-star search."""
    size, get, scores = len(text), vocab.ids.get, vocab.score

    def edges(j: int) -> Iterator[tuple[int, int, float]]:
        """(start, piece, score) of the pieces that end at ``j``."""
        for i in range(max(0, j - vocab.longest), j):
            p = get(text[i:j], -1)
            if p >= 0 or i == j - 1:
                yield i, p, float(scores[p]) if p >= 0 else vocab.unknown

    forward = [0.0] + [-np.inf] * size
    for j in range(1, size + 1):
        forward[j] = max(forward[i] + s for i, _, s in edges(j))
    # (-(forward score + score behind), position, order of arrival, score behind, pieces behind)
    agenda: list[tuple] = [(-forward[size], size, 0, 0.0, None)]
    arrived, out = 1, []
    popped = [0] * (size + 1)
    while agenda and len(out) < n:
        _, at, _, behind, tail = heapq.heappop(agenda)
        if popped[at] == n:
            continue
        popped[at] += 1
        if at == 0:
            ids = []
            while tail is not None:
                ids.append(tail[0])
                tail = tail[1]
            out.append((behind, vocab.spell(ids, text)))
            continue
        for i, p, s in edges(at):
            if popped[i] < n:
                heapq.heappush(agenda, (-(forward[i] + s + behind), i, arrived, behind + s, (p, tail)))
                arrived += 1
    return out


def decode(vocab: Vocabulary, ids: np.ndarray, ends: np.ndarray) -> list[str]:
    """Texts spelled by piece ids; text k ends before ``ends[k]``."""
    sizes = vocab.raw_start[ids + 1] - vocab.raw_start[ids]
    stops = np.concatenate([[0], np.cumsum(sizes)])
    data = vocab.raw_flat[np.arange(stops[-1]) + np.repeat(vocab.raw_start[ids] - stops[:-1], sizes)].tobytes()
    out, at = [], 0
    for end in stops[ends].tolist():
        text = data[at:end].decode("utf-8", "replace").replace(SPACE, " ")
        out.append(text[1:] if text.startswith(" ") else text)
        at = end
    return out


class SegmentTable:
    """Best segmentations by segment, kept in flat arrays; filled for many segments at a time."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.lists: dict[tuple[str, int], list[tuple[float, list[int]]]] = {}
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.start = np.zeros(1, np.int64)  # start[i + 1] is the end of entry i
        self.flat = np.zeros(0, np.int32)
        self.score, self.gap = np.zeros(0), np.zeros(0)

    def add(self, segments: set[str]) -> None:
        missing = [s for s in segments if s not in self.index]
        if len(self.index) + len(missing) > CACHE_ENTRIES:
            self.clear()
            missing = list(segments)
        missing.sort(key=len)
        found, at = [], 0
        while at < len(missing):
            size = len(missing[at])
            stop = at + 1
            while size <= LONGEST_BATCHED and stop < len(missing) and len(missing[stop]) == size and stop - at < 8192:
                stop += 1
            if size <= LONGEST_BATCHED:
                found.append(best_two(self.vocab, [_marked(s) for s in missing[at:stop]]))
            else:
                ids, score, gap = best_two_long(self.vocab, _marked(missing[at]))
                found.append((np.array(ids, np.int32), [len(ids)], [score], [gap]))
            at = stop
        if missing:
            base = len(self.score)
            self.index.update(zip(missing, range(base, base + len(missing)), strict=True))
            ids, sizes, score, gap = (np.concatenate(x) for x in zip(*found, strict=True))
            self.start = np.concatenate([self.start, np.cumsum(sizes) + self.start[-1]])
            self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
            self.score, self.gap = np.append(self.score, score), np.append(self.gap, gap)

    def alternatives(self, segment: str, n: int) -> list[tuple[float, list[int]]]:
        key = (segment, n)
        if key not in self.lists:
            if len(self.lists) >= 5_000:
                self.lists.clear()
            self.lists[key] = n_best(self.vocab, _marked(segment), n)
        return self.lists[key]


def encode_block(table: SegmentTable, texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, list, list]:
    """Ids of all texts in one array, end of each text, n-best scores and alternatives of each text.

    An alternative is its score and the segments that differ from the best:
    (number of the segment, its piece ids).
    """
    segments = [SEGMENT.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
    table.add(set(chain.from_iterable(segments)))
    words = sum(map(len, segments))
    at = np.fromiter(map(table.index.__getitem__, chain.from_iterable(segments)), np.int64, words)
    sizes = table.start[at + 1] - table.start[at]
    ends = np.cumsum(sizes)
    ids = table.flat[np.arange(ends[-1] if words else 0) + np.repeat(table.start[at] - (ends - sizes), sizes)]
    cuts = np.concatenate([[0], np.cumsum([len(row) for row in segments])]).astype(np.int64)
    text_ends = np.concatenate([[0], ends])[cuts[1:]]
    totals = np.concatenate([[0.0], np.cumsum(table.score[at])])
    gaps = table.gap[at]
    scores, others = [], []
    for row, a, b in zip(segments, cuts[:-1], cuts[1:], strict=True):
        if a == b:
            scores.append([])
            others.append([])
            continue
        total, g = totals[b] - totals[a], gaps[a:b]
        near = np.argpartition(g, n - 2)[:n - 1] if 1 < n <= len(g) else np.arange(len(g) if n > 1 else 0)
        # ties by position: every segment with a gap below the largest of these, then the first of equals
        if len(near):
            edge = g[near].max()
            equal = np.flatnonzero(g == edge)
            near = np.concatenate([near[g[near] < edge], equal])[:n - 1]
        combos: list[tuple[float, tuple]] = [(0.0, ())]
        for w in sorted(near.tolist()):
            if np.isfinite(g[w]):
                options = table.alternatives(row[w], n)
                more = [(d + options[0][0] - s, (*picked, (w, k))) for d, picked in combos
                        for k, (s, _) in enumerate(options) if k]
                combos = sorted(combos + more)[:n]
        scores.append([total - d for d, _ in combos])
        others.append([{"score": total - d, "changes": [
            {"segment": w, "ids": table.alternatives(row[w], n)[k][1]} for w, k in picked]} for d, picked in combos[1:]])
    return ids, text_ends, scores, others


_WORKER: dict[str, SegmentTable] = {}


def _segment_table(model: bytes) -> SegmentTable:
    """The worker's table for this model, kept from task to task."""
    key = hashlib.md5(model).hexdigest()
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = SegmentTable(Vocabulary(model))
    return _WORKER[key]


SCHEMA = ("ids array<int>, scores array<double>, "
          "others array<struct<score: double, changes: array<struct<segment: int, ids: array<int>>>>>")
_OTHERS = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(
    pa.struct([("segment", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))


def encode_pieces(docs: DataFrame, model: bytes, text_col: str = "text", out: str = "pieces",
                  n: int = N_BEST, with_text: bool = False) -> DataFrame:
    """``docs`` with a struct: ids of the best segmentation, n-best scores, and the alternatives' changes.

    ``with_text`` adds the text that the ids spell, decoded in the same worker
    (a second function in the plan would be a second worker per task).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = _segment_table(shared.value)
        for batch in batches:
            for (texts,) in blocks_of(BLOCK_BYTES, batch):
                ids, ends, scores, others = encode_block(table, texts.to_pylist(), n)
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                columns = {"ids": pa.ListArray.from_arrays(offsets, pa.array(ids)), "scores": pa.array(scores, pa.list_(pa.float64())),
                           "others": pa.array(others, _OTHERS)}
                if with_text:
                    columns["decoded"] = pa.array(decode(table.vocab, ids.astype(np.int64), ends), pa.string())
                yield pa.StructArray.from_arrays(list(columns.values()), list(columns))

    encode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    schema = SCHEMA + ", decoded string" if with_text else SCHEMA
    return docs.withColumn(out, F.arrow_udf(encode, schema)(F.col(text_col)))


def decode_pieces(df: DataFrame, model: bytes, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text that its piece ids spell (null ids: null)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def spell(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = _segment_table(shared.value).vocab
        for lists in batches:
            offsets, values = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
            valid = lists.is_valid().to_pylist()
            for lo, hi in row_blocks(offsets - offsets[0], BLOCK_BYTES):
                ids = values[offsets[lo]:offsets[hi]].astype(np.int64)
                texts = decode(vocab, ids, offsets[lo + 1:hi + 1] - offsets[lo])
                yield pa.array([t if ok else None for t, ok in zip(texts, valid[lo:hi], strict=True)], pa.string())

    spell.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(out, F.arrow_udf(spell, "string")(ids_col))
