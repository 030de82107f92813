"""Periodic runs of words by recompression.

A run is a stretch of consecutive words in which words ``q`` apart are equal,
``q`` being its smallest period, of at least ``min_words`` words and
``min_repeats`` periods, that no neighbouring word extends.

1. Documents of a block are laid end to end, each closed by a letter of its own,
   so that no match crosses a border.
2. Recompression makes a run-length grammar of the block: a level of block
   compression (each maximal a^k becomes one letter) is followed by a level of
   pair compression (letters are dealt to a left and a right half, each left
   letter followed by a right one becomes one letter with it) and so on until no
   letter occurs twice. Equal stretches are cut alike but for a few letters at
   their ends.
3. Harmonic grid: a run of period q and at least two further periods holds two
   neighbouring multiples k*q whose words recur q later, so candidates are grid
   places with that many equal words in a row; there are n/q for each q, n log n
   in all.
4. Each candidate is extended exactly both ways by longest-common-extension
   queries of (k*q, k*q + q) on the grammar: up through the levels while the
   letters agree, then down into the letters that differ. All queries of a block
   go through the levels together, in numpy.
5. A stretch that several periods share is a run of the smallest of them.

Blocks are whole documents of about PIECE_BYTES of text; a task holds some 300
bytes a word of its current block, or of its longest text.

Defined results: null and empty texts have no words and no runs; texts under
``min_words`` words have none; repeated rows give a row each; an empty table gives an
empty table; other columns stay as they are, whatever their names (``out`` apart).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import PIECE_BYTES, blocks_of

# Candidates are extended together up to this many, so that temporaries stay small.
QUERIES_AT_ONCE = 1 << 17

SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Grammar:
    """Levels of a run-length grammar over ``letters``, whose first and last letter occur once.

    ``levels[h]`` holds the letters of level h; ``parents[h]`` the index at level h + 1 of
    the letter that covers each of them; ``firsts[h]`` the first child of each letter of
    level h + 1, closed by the length of level h.
    """

    def __init__(self, letters: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.levels, self.parents, self.firsts = [], [], []
        t, blocks = np.unique(letters, return_inverse=True)[1].astype(np.int64), True
        while True:
            self.levels.append(t)
            size = int(t.max()) + 1
            if not blocks and size == len(t):  # every letter occurs once, so letters differ wherever places do
                return
            start = self._blocks(t) if blocks else self._pairs(t, size, rng)
            first = np.flatnonzero(start)
            self.parents.append(np.cumsum(start, dtype=np.int32) - 1)
            self.firsts.append(np.append(first, len(t)).astype(np.int32))
            t = self._names(t, first, size, blocks)
            blocks = not blocks

    @staticmethod
    def _blocks(t: np.ndarray) -> np.ndarray:
        """Starts of the maximal blocks of one letter."""
        start = np.ones(len(t), bool)
        start[1:] = t[1:] != t[:-1]
        return start

    @staticmethod
    def _pairs(t: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
        """Starts of pairs and of the letters left alone; of the two ways round the halves, the one with more pairs."""
        left = rng.integers(0, 2, size).astype(bool)[t]
        one, other = left[:-1] & ~left[1:], ~left[:-1] & left[1:]
        start = np.ones(len(t), bool)
        start[1:] = ~(one if one.sum() >= other.sum() else other)
        return start

    @staticmethod
    def _names(t: np.ndarray, first: np.ndarray, size: int, blocks: bool) -> np.ndarray:
        """Letters of the next level: equal ones for equal blocks or pairs."""
        length = np.diff(np.append(first, len(t)))
        out, many = t[first], np.flatnonzero(length > 1)
        if len(many):
            at = first[many]
            key = t[at] * (len(t) + 1) + length[many] if blocks else t[at] * size + t[at + 1]
            out[many] = size + np.unique(key, return_inverse=True)[1]
        present = np.zeros(int(out.max()) + 1, bool)
        present[out] = True
        return (np.cumsum(present) - 1)[out]

    def extend(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """Length of the longest common extension of the places i < j: from them on, or (``back``) of what ends before them."""
        u, v = i.astype(np.int64), j.astype(np.int64)
        stop = np.zeros(len(u), np.int16)
        live = np.arange(len(u))
        for h in range(len(self.firsts)):
            for _ in range(2):  # a second letter at most stands before the next border
                loose = live[~(self._border(h, u[live]) & self._border(h, v[live]))]
                differs = self._letter(h, u[loose], back) != self._letter(h, v[loose], back)
                stop[loose[differs]] = h + 1
                self._step(h, u, v, loose[~differs], back)
                live = live[stop[live] == 0]
            if not len(live):
                break
            u[live], v[live] = self._up(h, u[live]), self._up(h, v[live])
        stop[live] = len(self.firsts) + 1  # letters of the last level differ wherever places do
        for h in range(int(stop.max(initial=1)) - 2, -1, -1):
            down = np.flatnonzero(stop >= h + 2)
            u[down], v[down] = self.firsts[h][u[down]], self.firsts[h][v[down]]
            self._step(h, u, v, down[self._letter(h, u[down], back) == self._letter(h, v[down], back)], back)
        return i - u if back else u - i

    def _border(self, h: int, at: np.ndarray) -> np.ndarray:
        """Whether a letter of level h + 1 starts at these places of level h."""
        return self.firsts[h][self.parents[h][at]] == at

    def _letter(self, h: int, at: np.ndarray, back: bool) -> np.ndarray:
        return self.levels[h][at - 1 if back else at]

    def _up(self, h: int, at: np.ndarray) -> np.ndarray:
        return self.parents[h][at]

    def _step(self, h: int, u: np.ndarray, v: np.ndarray, which: np.ndarray, back: bool) -> None:
        """Pass the letter that ``which`` have in common: one, or at a level of blocks what both have left of the block."""
        if h % 2:
            n = 1
        elif back:
            n = np.minimum(*(x[which] - self.firsts[h][self.parents[h][x[which] - 1]] for x in (u, v)))
        else:
            n = np.minimum(*(self.firsts[h][self.parents[h][x[which]] + 1] - x[which] for x in (u, v)))
        u[which] += -n if back else n
        v[which] += -n if back else n


def _grid(letters: np.ndarray, ends: np.ndarray, sizes: np.ndarray, min_words: int, min_repeats: int) -> Iterator[tuple[np.ndarray, int]]:
    """(places, period) of candidates; documents stand in order of size, so that each period looks at those long enough."""
    for q in range(1, int(sizes[-1]) // min_repeats + 1):
        least = max(min_words, min_repeats * q)
        doc = int(np.searchsorted(sizes, least))
        if doc == len(sizes):
            return
        start = -(-int(ends[doc] - sizes[doc]) // q) * q
        grid = letters[start::q]
        same = grid[1:] == grid[:-1]
        both = same
        for k in range(1, (least - q) // q):  # so many neighbouring multiples of q lie where words recur
            if k >= len(same) or not both.any():
                break
            both = both[:-1] & same[k:]
        found = np.flatnonzero(both) if (least - q) // q <= len(same) else np.zeros(0, np.int64)
        if len(found):
            yield start + found * q, q


def find_runs(letters: np.ndarray, sizes: np.ndarray, min_words: int, min_repeats: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs; ``letters`` are those of documents of ``sizes`` words, each closed by
    a letter of its own, in order of size, after one more such letter."""
    ends = 1 + np.cumsum(sizes + 1) - 1  # of each document's words
    parts, grammar = [], None

    def extended(at: np.ndarray, q: np.ndarray) -> None:
        nonlocal grammar
        grammar = grammar or Grammar(letters)
        on = grammar.extend(at, at + q)
        # a place that the extension from an earlier place of its grid reaches has the same run
        fresh = np.ones(len(at), bool)
        fresh[1:] = ~((q[1:] == q[:-1]) & (at[1:] < at[:-1] + on[:-1]))
        at, q, on = at[fresh], q[fresh], on[fresh]
        before = grammar.extend(at, at + q, back=True)
        length = before + on + q
        real = length >= np.maximum(min_words, min_repeats * q)
        parts.append((at[real] - before[real], length[real], q[real]))

    held, n = [], 0
    for at, q in _grid(letters, ends, sizes, min_words, min_repeats):
        for lo in range(0, len(at), QUERIES_AT_ONCE):
            piece = at[lo:lo + QUERIES_AT_ONCE]
            held.append((piece, np.full(len(piece), q)))
            n += len(piece)
            if n >= QUERIES_AT_ONCE:
                extended(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, n = [], 0
    if held:
        extended(*(np.concatenate(x) for x in zip(*held, strict=True)))
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    # the same stretch under several periods is a run of the least
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def runs_of(texts: pa.Array, min_words: int, min_repeats: int) -> pa.StructArray:
    """Words, runs and the text without repeated periods of each text of a batch."""
    # the separators of ascii_split_whitespace are the space and the bytes 9 to 13
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat, rows = split.flatten(), pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(flat), 0)
    words, rows = flat.filter(full), rows[full.to_numpy(zero_copy_only=False)]
    n, total = len(texts), len(words)
    sizes = np.bincount(rows, minlength=n).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])

    order = np.flatnonzero(sizes >= max(min_words, min_repeats))  # shorter texts have no runs
    order = order[np.argsort(sizes[order], kind="stable")]
    shift = np.cumsum(sizes[order] + 1) - sizes[order]  # where each text's letters start after the first closing letter
    covered, found = np.zeros(total + 1, np.int64), (np.zeros(0, np.int64),) * 4
    if len(order):
        names = words.dictionary_encode().indices.to_numpy().astype(np.int64) + len(order) + 1
        laid = np.zeros(int(shift[-1] + sizes[order[-1]] + 1), np.int64)
        laid[shift + sizes[order]] = np.arange(1, len(order) + 1)
        for at, row in zip(shift, order, strict=True):
            laid[at:at + sizes[row]] = names[begin[row]:begin[row + 1]]
        start, length, period = find_runs(laid, sizes[order], min_words, min_repeats)
        place = np.searchsorted(shift, start, side="right") - 1
        row, start = order[place], start - shift[place]
        by_row = np.argsort(row, kind="stable")
        found = tuple(x[by_row] for x in (row, start, length, period))
        row, start, length, period = found
        np.add.at(covered, begin[row] + start + period, 1)
        np.add.at(covered, begin[row] + start + length, -1)
    kept = np.cumsum(covered[:total]) == 0
    left = np.concatenate([[0], np.cumsum(np.bincount(rows[kept], minlength=n))])
    texts_left = pc.binary_join(pa.LargeListArray.from_arrays(left, words.filter(pa.array(kept))), pa.scalar(" ", pa.large_string()))
    row, start, length, period = (x.astype(np.int64) for x in found)
    runs = pa.ListArray.from_arrays(
        np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32),
        pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"]))
    return pa.StructArray.from_arrays([pa.array(sizes), runs, texts_left.cast(pa.string())], ["n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text_col: str = "text", out: str = "periodic", min_words: int = 24, min_repeats: int = 3) -> DataFrame:
    """``docs`` with a struct: ``n_words``, ``runs`` by start and period, ``collapsed``: the words outside the second and
    later periods of every run, joined by a space."""
    if min_repeats < 2 or min_words < 1:
        raise ValueError("a run has two periods and a word at least")

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [runs_of(piece, min_words, min_repeats) for piece, in blocks_of(PIECE_BYTES, texts)]
            yield pa.concat_arrays(parts) if parts else runs_of(texts, min_words, min_repeats)

    find.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(out, F.arrow_udf(find, SCHEMA)(F.col(text_col)))

