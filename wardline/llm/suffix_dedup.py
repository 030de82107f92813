"""Removal of repeated byte strings by longest-previous-factor arrays over anchored suffixes.

A byte goes when a string of SPAN bytes that covers it also starts in a
document with a smaller id. No task can hold the suffix array of a corpus, so
suffixes are dealt out by an anchor that equal strings share: the smallest hash
among the GRAM-byte grams of the SPAN-byte string (its leftmost place). One
anchor serves a run of neighbouring string starts, about 16 of them.

1. Copies: of rows with one text the smallest id stands for all; the others go as a whole.
2. Anchors: the anchor hashes are written once, in sorted lists of some _CHUNK bytes of texts.
   The lists are cut by hash range and ranges brought together; hashes of two or more documents
   are kept. A hash stands at most twice in what a list sends (its least and its greatest id), so
   a common one is no large group.
3. Contexts: the bytes around each kept anchor, i.e. all SPAN-byte strings that
   it serves, named by a hash made where the text is; equal contexts are one row with its
   smallest id, so a passage that stands in a third of all documents is a few rows.
   Occurrences in later documents than a context's first are repeats as a whole.
4. Anchors with several contexts bring these contexts' bytes together, each context once. Within an
   anchor the suffixes (up to SPAN bytes) are put in suffix order with the common prefixes of
   neighbours. From each place the previous and the next smaller position, which are the nearest places with a
   smaller id, are found by jumping over larger ones, the least common prefix on the way kept;
   the larger of both is the longest previous factor. A string whose factor reaches SPAN
   stands earlier.
   An anchor of more than GROUP_CONTEXTS contexts (a common GRAM bytes with
   different surroundings) is no group of one task: its contexts' strings are
   dealt out by (anchor, distance to it, string), with the smallest id of each.
5. Repeats go back to their documents, where covered bytes are removed.

Defined results: null and empty texts, and texts of fewer than SPAN bytes, lose
nothing; rows of one id do not count as earlier for each other; a row with a
null id loses nothing and is no source; repeated rows give a row each; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import Landed, blocks_of, broadcast_if_small, row_blocks, string_buffers
from wardline.llm.words_np import mix

SPAN = 50
GRAM = 20
WIDTH = SPAN - GRAM + 1
GROUP_CONTEXTS = 1 << 14
_PLACE_BITS = np.uint64(22)
_PLACE = np.uint64((1 << 22) - 1)
# Bytes of a block of texts, and those whose 64-bit temporaries stay in a core's cache.
_PIECE = 1 << 18
_CACHED = 1 << 15
_BASE, _BASE2, _BASE3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
_HALF = np.uint64(32)
WORDS = -(-SPAN // 8)


def _context_names(hashes: np.ndarray, place: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from ``first`` to ``end`` and of the anchor's place in them.

    Two grams (``hashes``) at either end cover a context, which has at most 4 * GRAM bytes.
    """
    out = ((place - first) << 8 | (end - first)).astype(np.uint64)
    for at in (first, first + GRAM, end - 2 * GRAM, end - GRAM):
        out = mix(out * _BASE + hashes[at])
    return out


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed hash of the GRAM (20) bytes at each place: of its words of 8 bytes from byte 0, 8 and 12 on."""
    n = len(data) - GRAM + 1
    words = np.ndarray((n + GRAM - 8,), "<u8", data, strides=(1,)).copy()
    out = words[:n] * _BASE
    high = out >> _HALF
    for at, factor in ((8, _BASE2), (12, _BASE3)):
        out ^= high
        out += words[at:at + n]
        out *= factor
        np.right_shift(out, _HALF, out=high)
    out ^= high
    return out


def _lowest_grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gram hash of each place, and for each string start the lowest of its grams (hash with the place in its last bits)."""
    n = len(data) - SPAN + 1
    hashes, lowest = np.empty(n + WIDTH - 1, np.uint64), np.empty(n, np.uint64)
    for a in range(0, n, _CACHED):
        b = min(a + _CACHED, n)
        h = hashes[a:b + WIDTH - 1]
        h[:] = _gram_hashes(data[a:b + SPAN - 1])
        low = (h & ~_PLACE) | np.arange(a, a + len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= WIDTH:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        lowest[a:b] = np.minimum(low[:b - a], low[WIDTH - size:][:b - a])
    return hashes, lowest


def _anchors_of(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of consecutive texts, each of SPAN bytes at least (``begin``, ``stop``: where each begins and stops).

    Returns text of each anchor, gram hashes, anchor place, first and last string start that it serves.
    """
    hashes, lowest = _lowest_grams(data)
    cut = np.flatnonzero(lowest[1:] != lowest[:-1]) + 1
    # texts are few beside cuts: they are looked up among the cuts
    text = np.repeat(np.arange(-1, len(begin)), np.diff(np.searchsorted(cut, begin), prepend=0, append=len(cut)))
    inside = (text >= 0) & (cut > begin[text]) & (cut <= stop[text] - SPAN)
    cut, text = cut[inside], text[inside]
    at = np.searchsorted(cut, begin)
    first, text = np.insert(cut, at, begin), np.insert(text, at, np.arange(len(begin)))
    last = np.minimum(np.append(first[1:], len(data)) - 1, stop[text] - SPAN)
    place = (lowest[first] & _PLACE).astype(np.int64)
    return text, hashes, place, first, last


def _blocks(offsets: np.ndarray, data: np.ndarray, named: bool = False):
    """Anchors with the row of each (and the names of their contexts) over blocks of rows and pieces of long rows."""
    for lo, hi in row_blocks(offsets, _PIECE):
        start, end = int(offsets[lo]), int(offsets[hi])
        for a in range(start, max(end - SPAN + 1, start), _PIECE):
            b = min(a + _PIECE + SPAN - 1, end)
            begin, stop = (np.clip(x, a, b) - a for x in (offsets[lo:hi], offsets[lo + 1:hi + 1]))
            rows = np.flatnonzero(stop - begin >= SPAN)
            if not len(rows):
                continue
            text, hashes, place, first, last = _anchors_of(data[a:b], begin[rows], stop[rows])
            names = (_context_names(hashes, place, first, last + SPAN).view(np.int64),) if named else ()
            # mixed anew: an anchor is the lowest hash around, so low ones would crowd the first range of hashes
            yield rows[text] + lo, mix(hashes[place]), place + a, first + a, last + a, *names


def _group_starts(*keys: np.ndarray) -> np.ndarray:
    """Where a row of sorted keys differs from the one before it."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _order(h: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Order by ``h``, then ``own``; the latter is looked at only where hashes are equal."""
    order = np.argsort(h)
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[order[1:]] == h[order[:-1]]
    ties = np.flatnonzero(same[1:] | same[:-1])
    tied = order[ties]
    order[ties] = tied[np.lexsort((own[tied], h[tied]))]
    return order


def _packed(cuts: np.ndarray, values: np.ndarray) -> pa.BinaryArray:
    """Stretches of 64-bit numbers as bytes, which Spark moves without looking at each number."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * 8).astype(np.int32)),
                                                              pa.py_buffer(np.ascontiguousarray(values, np.int64))])


def _numbers(*packed: pa.Scalar) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.int64) for x in packed]


ANCHORS = "n long, hs binary, ids binary"
# bytes of text in one list of anchors, and anchors that come together in one range of hashes
_CHUNK = 1 << 23
_RANGE = 1 << 19


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every _CHUNK bytes of texts: the different pairs of anchor hash and id, in their order."""
    for batch in batches:
        for ids, texts in ((i, t) for t, i in blocks_of(_CHUNK, batch.column("t"), batch.column("id"))):
            data, offsets = string_buffers(texts)
            parts = [(h.view(np.int64), rows) for rows, h, *_ in _blocks(offsets, data)]
            if not parts:
                continue
            h, own = (np.concatenate(x) for x in zip(*parts, strict=True))
            own = ids.to_numpy()[own]
            order = _order(h, own)
            h, own = h[order], own[order]
            pick = _group_starts(h, own)
            h, own = h[pick], own[pick]
            cuts = np.array([0, len(h)])
            yield pa.RecordBatch.from_arrays([pa.array(cuts[1:]), _packed(cuts, h), _packed(cuts, own)], ["n", "hs", "ids"])


def _ranges(bits: int):
    """Lists cut into 2 ** ``bits`` ranges of hashes; of a hash's ids the least and the greatest stay."""
    edges = np.arange(-(1 << bits - 1), (1 << bits - 1) + 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, hs, ids in zip(*(batch.column(k) for k in ("chunk", "hs", "ids")), strict=True):
                h, own = _numbers(hs, ids)
                ends = np.zeros(len(h), bool)
                first = _group_starts(h)
                ends[first] = True
                ends[np.append(first[1:], len(h)) - 1] = True
                h, own = h[ends], own[ends]
                cuts = np.searchsorted(h >> 64 - bits, edges)
                some = np.flatnonzero(np.diff(cuts))
                cuts = np.append(cuts[some], len(h))
                yield pa.RecordBatch.from_arrays([pa.array(edges[some]), pa.repeat(chunk, len(some)), _packed(cuts, h), _packed(cuts, own)],
                                                 ["part", "chunk", "hs", "ids"])

    return cut


def _shared_hashes(part: pa.Table) -> pa.Table:
    """For each list with hashes in a range: those that stand in two or more documents."""
    lists = [_numbers(*x) for x in zip(part.column("hs"), part.column("ids"), strict=True)]
    h, own = (np.concatenate(x) for x in zip(*lists, strict=True))
    order = np.argsort(h)
    first = _group_starts(h[order])
    own = own[order]
    several = np.minimum.reduceat(own, first) < np.maximum.reduceat(own, first)
    keep = np.zeros(len(h), bool)
    keep[order] = np.repeat(several, np.diff(np.append(first, len(h))))
    cuts = np.concatenate([[0], np.cumsum([len(x) for x, _ in lists])])
    stays = np.concatenate([[0], np.cumsum(keep)])[cuts]
    out = pa.table([part.column("chunk"), _packed(stays, h[keep])], ["chunk", "hs"])
    return out.filter(pa.array(np.diff(stays) > 0))


def _wanted_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each id of a list: its hashes among the shared ones."""
    for batch in batches:
        for hs, ids, shared in zip(*(batch.column(k) for k in ("hs", "ids", "shared")), strict=True):
            h, own = _numbers(hs, ids)
            asked = np.sort(np.concatenate(_numbers(*shared.values)))
            live = asked[np.minimum(np.searchsorted(asked, h), len(asked) - 1)] == h
            h, own = h[live], own[live]
            order = np.argsort(own, kind="stable")
            h, own = h[order], own[order]
            first = _group_starts(own)
            yield pa.RecordBatch.from_arrays([pa.array(own[first]), _packed(np.append(first, len(h)), h)], ["id", "wanted"])


def _wanted(lists: DataFrame) -> DataFrame:
    """(id, wanted): the anchor hashes of each id that stand in two or more documents."""
    total = lists.agg(F.sum("n")).first()[0] or 0
    bits = max(6, (total // _RANGE).bit_length())
    parts = lists.select("chunk", "hs", "ids").mapInArrow(_ranges(bits), "part long, chunk long, hs binary, ids binary")
    shared = parts.groupBy("part").applyInArrow(_shared_hashes, "chunk long, hs binary")
    shared = shared.groupBy("chunk").agg(F.collect_list("hs").alias("shared"))
    found = lists.select("chunk", "hs", "ids").join(shared, "chunk").select("hs", "ids", "shared")
    found = found.mapInArrow(_wanted_hashes, "id long, wanted binary")
    return found.groupBy("id").agg(F.collect_list("wanted").alias("wanted"))


CONTEXT = "array<struct<h: long, c: long, at: int, served: int>>"
BYTES = "array<struct<h: long, c: long, place: int, bytes: binary>>"
_KEYS = [("h", pa.int64()), ("c", pa.int64())]


def _of_row(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """One number for an anchor hash of a row; two that are alike by chance only bring a context that is not asked for."""
    return mix(h ^ (row.astype(np.uint64) * _BASE))


def _wanted_contexts(texts: pa.Array, wanted: pa.Array, once: bool):
    """(bytes, row offsets, then row, anchor hash, name, anchor place, first and last string start of each wanted
    context); ``once``: of equal contexts of a text the first only."""
    data, offsets = string_buffers(texts)
    own, w = np.repeat(np.arange(len(texts)), pc.list_value_length(wanted).to_numpy(zero_copy_only=False)), wanted.flatten()
    if pa.types.is_binary(w.type):  # packed
        own = np.repeat(own, pc.binary_length(w).to_numpy(zero_copy_only=False) // 8)
        w = np.concatenate([np.zeros(0, np.int64), *_numbers(*w)])
    asked = np.sort(_of_row(np.asarray(w).view(np.uint64), own))
    parts = []
    for rows, h, place, first, last, c in _blocks(offsets, data, True) if len(asked) else ():
        keys = _of_row(h, rows)
        live = asked[np.minimum(np.searchsorted(asked, keys), len(asked) - 1)] == keys
        parts.append([x[live] for x in (rows, h.view(np.int64), c, place, first, last)])
    found = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 6
    if once and len(found[0]):
        order = np.lexsort((found[2], found[1], found[0]))
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in found[:3]], axis=0)
        found = [x[order[new]] for x in found]
    return data, offsets, *found


def _contexts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Contexts of the wanted anchors of each text: anchor, name, string start, number of strings."""
    for texts, wanted in (part for batch in batches for part in blocks_of(_PIECE, *batch)):
        _, offsets, row, h, c, _, first, last = _wanted_contexts(texts, wanted, False)
        items = pa.StructArray.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(first - offsets[row], pa.int32()),
                                            pa.array(last - first + 1, pa.int32())], ["h", "c", "at", "served"])
        yield pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(offsets))), pa.int32()), items)


def _context_bytes(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Different contexts of the wanted anchors of each text: anchor, name, place of the anchor, bytes."""
    for texts, wanted in (part for batch in batches for part in blocks_of(_PIECE, *batch)):
        data, offsets, row, h, c, place, first, last = _wanted_contexts(texts, wanted, True)
        sizes = last - first + SPAN
        stops = np.concatenate([[0], np.cumsum(sizes)])
        flat = data[np.arange(stops[-1]) + np.repeat(first - stops[:-1], sizes)]
        raw = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(flat)])
        items = pa.StructArray.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(place - first, pa.int32()), raw],
                                           ["h", "c", "place", "bytes"])
        yield pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(offsets))), pa.int32()), items)


for _f in (_contexts, _context_bytes):
    _f.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}


def _common_prefixes(words: np.ndarray) -> np.ndarray:
    """Bytes that each of the sorted strings (big-endian words) shares with the one before it, up to SPAN; 0 for the first."""
    out = np.zeros(len(words), np.int64)
    if len(words) < 2:
        return out
    differ = words[1:] ^ words[:-1]
    word = (differ != 0).argmax(axis=1)
    x = differ[np.arange(len(differ)), word]
    lead = sum((x < np.uint64(1 << b)).astype(np.int64) for b in range(8, 64, 8))
    out[1:] = np.minimum(np.where(x == 0, SPAN, word * 8 + lead), SPAN)
    return out


def _to_smaller(ids: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Common prefix of each place with the nearest place before it that has a smaller id (0: none shares a byte).

    ``shared``: common prefix with the place before. A place jumps to where the place it looks at already looks;
    all places between have ids that are no smaller.
    """
    low, to = shared.copy(), np.arange(len(ids)) - 1
    live = np.flatnonzero(low > 0)
    live = live[ids[to[live]] >= ids[live]]
    while len(live):
        via = to[live]
        low[live] = np.minimum(low[live], low[via])
        to[live] = to[via]
        live = live[low[live] > 0]
        live = live[ids[to[live]] >= ids[live]]
    return low


def longest_previous(data: np.ndarray, starts: np.ndarray, group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Longest previous factors: how many of the SPAN bytes at each start begin, at the same
    distance to the anchor, a suffix of the group in a document with a smaller id."""
    padded = np.concatenate([data, np.zeros(8 * WORDS, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8 * WORDS)[starts].copy()
    words[:, SPAN:] = 0
    # 16 bits a key, for which stable sorting takes time in proportion
    keys = words[:, :SPAN + SPAN % 2].view(">u2").T.astype(np.uint16)
    groups = [(group >> k & 0xFFFF).astype(np.uint16) for k in range(0, max(int(group.max(initial=0)).bit_length(), 1), 16)]
    order = np.lexsort((*keys[::-1], *groups))
    words = words.view(">u8").astype(np.uint64)
    words, g, i = words[order], group[order], ids[order]
    shared = _common_prefixes(words)
    shared[1:][g[1:] != g[:-1]] = 0
    back = np.append(shared[1:], 0)[::-1]
    out = np.zeros(len(order), np.int64)
    out[order] = np.maximum(_to_smaller(i, shared), _to_smaller(i[::-1], back)[::-1])
    return out


def earlier_factors(data: np.ndarray, starts: np.ndarray, group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether the SPAN bytes at each start also stand in a document with a smaller id of the group."""
    return longest_previous(data, starts, group, ids) >= SPAN


_STARTS_AT_ONCE = 1 << 18


def _masks(batch: pa.RecordBatch) -> pa.Array:
    """For whole anchor groups (sorted): bit t is set when the string at start t of a context stands earlier."""
    raw = batch.column("bytes")
    _, off, data = raw.buffers()
    offsets = np.frombuffer(off, np.int32)[raw.offset:raw.offset + len(raw) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)
    h, ids = batch.column("h").to_numpy(), batch.column("first").to_numpy()
    edges = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]]) if len(h) else np.zeros(1, np.int64)
    out = np.zeros(len(h), np.int64)
    serves = np.diff(offsets) - SPAN + 1
    group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    several = np.flatnonzero((np.diff(edges) > 1)[group]) if len(h) else np.zeros(0, np.int64)
    # equal strings have their anchor at the same place, so each distance to the anchor is a job of its own
    place = batch.column("place").to_numpy().astype(np.int64)
    total = np.concatenate([[0], np.cumsum(serves[several])])
    at = 0
    while at < len(several):  # as many whole groups as fit
        stop = int(np.searchsorted(total, total[at] + _STARTS_AT_ONCE, side="right")) - 1
        stop = max(stop, at + 1)
        last = group[several[stop - 1]]
        stop = int(np.searchsorted(group[several], last, side="right")) if stop < len(several) else stop
        if stop < len(several) and group[several[at]] != last and total[stop] - total[at] > _STARTS_AT_ONCE:
            stop = int(np.searchsorted(group[several], last, side="left"))
        rows = several[at:stop]
        whole = total[stop] - total[at] <= 4 * _STARTS_AT_ONCE
        for distance in [None] if whole else range(WIDTH):
            row = np.repeat(rows, serves[rows])
            t = np.arange(len(row)) - np.repeat(np.cumsum(serves[rows]) - serves[rows], serves[rows])
            if distance is not None:
                pick = place[row] - t == distance
                row, t = row[pick], t[pick]
            if len(row):
                hit = earlier_factors(data, offsets[row] + t, group[row] * (WIDTH + 1) + place[row] - t, ids[row])
                np.bitwise_or.at(out, row[hit], np.int64(1) << t[hit])
        at = stop
    return pa.array(out)


def _mask_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by anchor hash come in batches; a group that is cut is finished with the next batch."""
    names = ["h", "c", "first", "mask"]
    held: list[pa.RecordBatch] = []

    def finish(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.concat_batches(parts)
        return pa.RecordBatch.from_arrays([batch.column("h"), batch.column("c"), batch.column("first"), _masks(batch)], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch.column("h").to_numpy()
        edge = int(np.searchsorted(h, h[-1], side="left"))
        if edge or (held and held[-1].column("h")[-1].as_py() != h[0]):
            if edge:
                held.append(batch.slice(0, edge))
            yield finish(held)
            held = []
        held.append(batch.slice(edge))
    if held:
        yield finish(held)


def _covered(at: np.ndarray, mask: np.ndarray, size: int) -> np.ndarray:
    """Bytes covered by the strings that start at ``at`` + t for every bit t set in ``mask``."""
    change = np.zeros(size + 1, np.int32)
    run = (mask & (mask + 1)) == 0  # the bits from 0 on: one stretch
    starts, ends = at[run], at[run] + np.bitwise_count(mask[run]) - 1 + SPAN
    bits = np.flatnonzero(((mask[~run, None] >> np.arange(WIDTH)) & 1).ravel())
    single = at[~run][bits // WIDTH] + bits % WIDTH
    np.add.at(change, np.concatenate([starts, single]), 1)
    np.add.at(change, np.concatenate([ends, single + SPAN]), -1)
    return np.cumsum(change[:-1]) > 0


KEPT = "spans array<struct<start: int, end: int>>, kept binary"


def _keep(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, repeats in (part for batch in batches for part in blocks_of(_PIECE, *batch)):
        data, offsets = string_buffers(texts)
        repeats = pc.fill_null(repeats, [])
        listed, cuts = repeats.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(repeats).to_numpy())])
        row = np.repeat(np.arange(len(texts)), np.diff(cuts))
        at, mask = (listed.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        copies, some = row[at < 0], at >= 0
        at, mask, row = at[some], mask[some], row[some]
        gone = _covered(at + offsets[row], mask, len(data))
        for k in copies.tolist():
            gone[offsets[k]:offsets[k + 1]] = True
        # stretches end with their text
        first, last = gone.copy(), gone.copy()
        first[1:] &= ~gone[:-1]
        last[:-1] &= ~gone[1:]
        edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        first[edges], last[edges - 1] = gone[edges], gone[edges - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        own = np.searchsorted(offsets, starts, side="right") - 1
        pairs = pa.StructArray.from_arrays([pa.array(starts - offsets[own], pa.int32()), pa.array(ends - offsets[own], pa.int32())],
                                           ["start", "end"])
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(len(offsets))), pa.int32()), pairs)
        stays = np.concatenate([[0], np.cumsum(~gone)])[offsets].astype(np.int32)
        kept = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(stays), pa.py_buffer(data[~gone])])
        yield pa.StructArray.from_arrays([spans, kept], ["spans", "kept"])


_keep.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}


def _string_masks(contexts: DataFrame) -> DataFrame:
    """(h, c, first, mask) as ``_mask_batches`` gives them, without bringing an anchor's contexts together."""
    starts = F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - SPAN)).alias("t")
    strings = contexts.select("h", "c", "first", "place", "bytes", starts).select(
        "h", "c", "first", "t", (F.col("place") - F.col("t")).alias("distance"),
        F.xxhash64(F.expr(f"substring(bytes, t + 1, {SPAN})")).alias("s"))
    strings = Landed(strings, "suffix-strings").df
    least = strings.groupBy("h", "distance", "s").agg(F.min("first").alias("least"))
    later = strings.join(least, ["h", "distance", "s"]).filter("first > least")
    return later.groupBy("h", "c", "first").agg(F.bit_or(F.expr("shiftleft(1L, t)")).alias("mask"))


def _later_copies(rows: DataFrame) -> Landed:
    """(id, th) of texts that equal the text of a smaller id (two 64-bit hashes and the length tell)."""
    named = rows.select("id", "th", F.octet_length("t").alias("n"), F.xxhash64(F.lit(1), "t").alias("again"))
    least = named.groupBy("th", "n", "again").agg(F.min("id").alias("lead"), F.max("id").alias("last")).filter("lead < last")
    least = Landed(least, "suffix-leads")
    later = named.join(broadcast_if_small(least.df, 40), ["th", "n", "again"]).filter("id > lead")
    out = Landed(later.select("id", "th").distinct(), "suffix-copies")
    least.drop()
    return out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, n_bytes, removed spans (byte offsets) and the bytes that stay."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    long_rows = rows.filter(F.col("id").isNotNull() & (F.octet_length("t") >= SPAN)).withColumn("th", F.xxhash64("t"))
    copies = _later_copies(long_rows)
    texts = long_rows.join(broadcast_if_small(copies.df, 24), ["id", "th"], "left_anti")
    lists = texts.select("id", "t").mapInArrow(_hash_lists, ANCHORS)
    lists = Landed(lists.withColumn("chunk", F.monotonically_increasing_id()), "suffix-anchors")
    wanted = Landed(_wanted(lists.df), "suffix-wanted")
    lists.drop()
    found = texts.join(wanted.df, "id").select("id", "th", F.explode(F.arrow_udf(_contexts, CONTEXT)("t", "wanted")).alias("x"))
    found = Landed(found.select("id", "th", "x.*"), "suffix-contexts")
    wanted.drop()
    names = Landed(found.df.groupBy("h", "c").agg(F.min("id").alias("first")), "suffix-names")
    # only anchors with several contexts need the bytes, once more from the documents that have them first
    several = Landed(names.df.groupBy("h").count().filter("count > 1"), "suffix-several")

    def asked_of(some: DataFrame) -> DataFrame:
        """(id, wanted): the anchors ``some`` of each document that has a context of them first."""
        return (names.df.join(some.select("h"), "h", "left_semi").groupBy(F.col("first").alias("id"))
                .agg(F.collect_set("h").alias("wanted")))

    def bytes_of(asked: DataFrame) -> DataFrame:
        """Contexts of the anchors in ``asked`` with their bytes."""
        rows = texts.join(asked, "id").select("id", F.explode(F.arrow_udf(_context_bytes, BYTES)("t", "wanted")).alias("x"))
        # each context once, also where rows of its first document repeat
        return (rows.select("x.h", "x.c", F.col("id").alias("first"), "x.place", "x.bytes")
                .repartition("h").dropDuplicates(["h", "c", "first"]))

    # a task holds the contexts of one anchor, so their number is bounded
    masks = (bytes_of(asked_of(several.df.filter(F.col("count") <= GROUP_CONTEXTS)))
             .sortWithinPartitions("h").mapInArrow(_mask_batches, "h long, c long, first long, mask long"))
    large = several.df.filter(F.col("count") > GROUP_CONTEXTS)
    scratch = [several]
    if n := large.count():
        # few anchors and, as a rule, few documents: those are looked for where the texts are
        scratch.append(Landed(asked_of(large), "suffix-asked"))
        masks = masks.unionByName(_string_masks(bytes_of(broadcast_if_small(scratch[-1].df, 32 + 8 * n))))
    masks = Landed(masks.filter("mask != 0").distinct(), "suffix-masks")
    for table in scratch:
        table.drop()
    known = names.df.join(masks.df, ["h", "c", "first"], "left")
    mask = F.when(F.col("id") > F.col("first"), F.expr("shiftleft(1L, served) - 1")).otherwise(F.col("mask"))
    repeats = (found.df.join(known, ["h", "c"]).select("id", "th", "at", mask.alias("mask"))
               .filter("mask != 0").groupBy("id", "th").agg(F.collect_list(F.struct("at", "mask")).alias("repeats")))
    whole = copies.df.select("id", "th", F.array(F.struct(F.lit(-1).alias("at"), F.lit(-1).cast("long").alias("mask"))).alias("repeats"))
    repeats = Landed(repeats.unionByName(whole), "suffix-repeats")
    for table in (found, names, masks, copies):
        table.drop()
    keyed = rows.withColumn("th", F.xxhash64("t"))
    out = keyed.join(repeats.df, ["id", "th"], "left").withColumn("x", F.arrow_udf(_keep, KEPT)("t", "repeats"))
    return out.select(F.col("id").alias(id_col), F.octet_length("t").cast("long").alias("n_bytes"), "x.spans", "x.kept")
