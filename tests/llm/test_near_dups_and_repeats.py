import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from helpers import empty, lower, table

from wardline.llm import simhash, suffix_dedup
from wardline.llm.simhash import components, hex_fingerprint, keep_one_of_near, links, near_groups
from wardline.llm.suffix_dedup import repeated_spans


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(prints):
    ids = list(prints)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def near_rows():
    rnd = random.Random(2)
    vocab = [f"w{k}" for k in range(300)]
    rows = []
    for g in range(12):
        base = [rnd.choice(vocab) for _ in range(120)]
        for k in range(rnd.randint(1, 5)):
            copy = list(base)
            if k:
                copy[rnd.randrange(120)] = rnd.choice(vocab)
            rows.append((g * 10 + k, " ".join(copy)))
    return rows + [(500, None), (501, ""), (502, " \t\n"), (503, "One two"), (504, "one  TWO"), (505, "É é É é"),
                   (506, "z " * 40_000)]


def test_prints_and_components_against_brute_force(spark):
    rows = near_rows()
    prints = {i: brute_print(t) for i, t in rows}
    want = brute_components(prints)
    for clashes in (False, True):
        got = near_groups(table(spark, rows, clashes)).withColumn("hex", hex_fingerprint("fp")).collect()
        assert {r.doc_id: (r.hex, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    kept = keep_one_of_near(table(spark, rows + rows[:3] + [(0, "other text of id zero here")], True)).collect()
    assert sorted(r.doc_id for r in kept) == sorted({*want.values()} | {0}) or len(kept) == len({*want.values()}) + 1
    assert near_groups(empty(spark)).count() == 0 and keep_one_of_near(empty(spark)).count() == 0


def test_null_id_does_not_name_a_component(spark):
    got = near_groups(table(spark, [(None, "a b c d"), (7, "a b c d"), (None, "quite another text altogether")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 7), (7, 7)]


def test_unrelated_rows_without_an_id_or_with_one_id_all_stay(spark):
    rows = [(None, "a b c d"), (None, "quite another text altogether"), (3, "one text of the third"),
            (3, "some words that have nothing in common with it"), (8, "one text of the third"), (None, "one text of the third")]
    kept = keep_one_of_near(table(spark, rows + rows[:1], True)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted(rows[:4], key=repr)


def test_no_link_is_missed(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-2**63, 2**63 - 1, 150)
    near = base ^ (np.int64(1) << rng.integers(0, 64, 150)) ^ (np.int64(1) << rng.integers(0, 64, 150))
    cluster = np.array([base[0] ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)])
    fps = np.unique(np.concatenate([base, near, cluster]))
    want = {(int(a), int(b)) for n, a in enumerate(fps) for b in fps[n + 1:] if int(a ^ b).bit_count() <= 2 or
            (int(a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    got = [tuple(r) for r in links(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_every_word_has_a_home_within_the_radius():
    words = np.random.default_rng(4).integers(0, 1 << 23, 5000)
    s = simhash._syndromes(words)
    error = simhash.PATTERNS[simhash.CUTS[s]]
    assert (np.bitwise_count(error) <= 3).all() and (simhash._syndromes(words ^ error) == 0).all()


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(n, n + 1) for n in range(60)] + [(100, 101), (101, 102), (100, 102)], "a long, b long")
    assert dict(map(tuple, components(chain).collect())) == {n: 0 for n in range(61)} | {n: 100 for n in (100, 101, 102)}


def brute_repeats(rows):
    """(id, n_bytes, n_removed, n_spans, digest of the rest) of every row."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            if i is not None:
                first[b[k:k + 50]] = min(i, first.get(b[k:k + 50], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if i is not None and first[b[k:k + 50]] < i:
                gone[k:k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        rest = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def test_repeats_against_brute_force(spark):
    rnd = random.Random(6)
    pool = ["".join(rnd.choice("abé ") for _ in range(rnd.randint(20, 140))) for _ in range(14)]
    rows = [(n, "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 5))) + rnd.choice(["", "x", "yé"])) for n in range(60)]
    rows += [(3, rows[10][1]), (61, "a" * 49), (62, "a" * 50), (63, "a" * 51), (64, "a" * 500), (65, None), (66, ""),
             (None, rows[20][1]), (None, "n" * 80), (67, "n" * 80), (68, "ab" * 300), (69, "ba" * 300), rows[5], rows[5]]
    want = brute_repeats(rows)
    for clashes in (False, True):
        got = repeated_spans(table(spark, rows, clashes)).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest())
                       for r in got), key=repr) == want
    assert repeated_spans(empty(spark)).count() == 0


def test_long_texts_are_anchored_alike_in_pieces(monkeypatch):
    rnd = random.Random(7)
    texts = pa.array(["".join(rnd.choice("abc d") for _ in range(n)) for n in (5000, 30, 700, 0, 2600)])
    data, offsets = suffix_dedup.string_buffers(texts)
    served = {}
    for piece in (1 << 20, 300):
        monkeypatch.setattr(suffix_dedup, "_PIECE", piece)
        starts = {}
        for rows, h, place, first, last in suffix_dedup._blocks(offsets, data):
            for r, x, p, a, b in zip(rows, h, place, first, last, strict=True):
                starts.update({(int(r), s): (int(x), int(p)) for s in range(a, b + 1)})
        served[piece] = starts
    assert served[300] == served[1 << 20]
    assert len(served[300]) == sum(max(0, n - 49) for n in (5000, 30, 700, 0, 2600))


def test_anchor_groups_cut_between_batches_or_too_large(monkeypatch):
    rnd = random.Random(8)
    rows = []
    for h in range(40):
        for k in range(rnd.choice([1, 1, 2, 9])):
            body = "".join(rnd.choice("ab") for _ in range(rnd.choice([50, 55, 60]))).encode()
            rows.append((h, f"{h}-{k}", rnd.randrange(30), 12, body))
            if rnd.random() < 0.5:
                rows.append((h, f"{h}-{k}b", rnd.randrange(30), rows[-1][3], body[:58] + b"q" * (len(body) - 58 if len(body) > 58 else 0)))
    rows.sort(key=lambda r: r[0])
    names = ["h", "c", "first", "place", "bytes"]
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [
        pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary()], strict=True)], names)
    want = pa.Table.from_batches(suffix_dedup._mask_batches(iter([whole]))).to_pylist()
    assert any(r["mask"] for r in want)
    cut = [whole.slice(k, 3) for k in range(0, len(rows), 3)]
    assert pa.Table.from_batches(suffix_dedup._mask_batches(iter(cut))).to_pylist() == want
    monkeypatch.setattr(suffix_dedup, "_STARTS_AT_ONCE", 2)
    assert pa.Table.from_batches(suffix_dedup._mask_batches(iter([whole]))).to_pylist() == want


def test_anchors_of_many_contexts_are_no_group_of_a_task(spark, monkeypatch):
    rnd = random.Random(9)
    common = "a common phrase, of twenty-odd bytes"
    some = ["".join(rnd.choice("abcd ") for _ in range(n)) for n in (25, 30, 35, 40)]
    rows = [(n, rnd.choice(some) + common + rnd.choice(some) + f" end {n}") for n in range(40)]
    rows += [(100 + n, f"start {n} " + common + rnd.choice(some)) for n in range(20)] + [(None, rows[3][1]), rows[5], (7, rows[9][1])]
    sizes, masks = [], suffix_dedup._string_masks

    def seen(contexts):
        sizes.append(contexts.groupBy("h").count().agg({"count": "min"}).collect()[0][0])
        return masks(contexts)

    monkeypatch.setattr(suffix_dedup, "GROUP_CONTEXTS", 4)
    monkeypatch.setattr(suffix_dedup, "_string_masks", seen)
    got = repeated_spans(table(spark, rows)).collect()
    assert sizes and sizes[0] > 4
    assert sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest())
                   for r in got), key=repr) == brute_repeats(rows)


def test_longest_previous_factors_against_brute_force():
    rnd = np.random.default_rng(10)
    for _ in range(150):
        n, span = int(rnd.integers(1, 40)), suffix_dedup.SPAN
        stems = [rnd.integers(97, 99, span + 30).astype(np.uint8) for _ in range(3)]
        texts = []
        for _ in range(n):
            t = stems[rnd.integers(3)].copy()
            if rnd.random() < 0.8:
                t[rnd.integers(len(t))] = rnd.integers(97, 124)
            texts.append(t)
        data, starts = np.concatenate(texts), np.arange(n) * (span + 30) + rnd.integers(0, 3, n)
        group, ids = np.sort(rnd.integers(0, 3, n)), rnd.integers(0, 12, n)
        got = suffix_dedup.longest_previous(data, starts, group, ids)
        for i in range(n):
            best = 0
            for j in range(n):
                if group[i] == group[j] and ids[j] < ids[i]:
                    a, b = data[starts[i]:starts[i] + span], data[starts[j]:starts[j] + span]
                    best = max(best, span if (a == b).all() else int((a != b).argmax()))
            assert got[i] == best


def test_copies_go_whole_and_repeated_rows_are_one_source(spark):
    line = "the same line of some fifty bytes or a little more than that\n"
    rows = [(5, line * 40), (9, line * 40), (2, line * 40), (9, line * 40), (7, line), (2, line * 40), (1, "x" + line), (None, line * 40)]
    got = repeated_spans(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest())
                   for r in got), key=repr) == brute_repeats(rows)


def test_held_batches_are_all_used():
    whole = pa.RecordBatch.from_pydict({"h": [1, 1], "c": [1, 2], "first": [3, 4], "place": [5, 5], "bytes": [b"x" * 50] * 2})
    parts = [whole.slice(0, 1), whole.slice(1, 1)]
    assert [r["mask"] for b in suffix_dedup._mask_batches(iter(parts)) for r in b.to_pylist()] == [0, 1]


def test_ranges_of_anchor_hashes_are_alike_in_size():
    rng = np.random.default_rng(5)
    texts = pa.array(rng.integers(97, 123, (400, 600), dtype=np.uint8).tobytes().decode()[600 * k:600 * k + 600] for k in range(400))
    ids = pa.array(range(400), pa.int64())
    lists = list(suffix_dedup._hash_lists(iter([pa.RecordBatch.from_arrays([ids, texts], ["id", "t"])])))
    whole = pa.Table.from_batches(lists).append_column("chunk", pa.array(range(len(lists)), pa.int64()))
    sizes = [len(suffix_dedup._numbers(x)[0]) for b in suffix_dedup._ranges(6)(iter(whole.combine_chunks().to_batches())) for x in b.column("hs")]
    assert len(sizes) == 64 and sum(sizes) > 10_000
    assert max(sizes) < 2 * sum(sizes) / 64  # a third of all came together in the first range


def test_names_of_contexts_tell_them_apart(monkeypatch):
    rnd = random.Random(12)
    shared = "".join(rnd.choice("ab") for _ in range(3000))
    texts = pa.array([shared[rnd.randrange(2500):][:rnd.randrange(400)] for _ in range(60)] + [shared])
    data, offsets = suffix_dedup.string_buffers(texts)
    for piece in (1 << 18, 300):
        monkeypatch.setattr(suffix_dedup, "_PIECE", piece)
        _, h, place, first, last, names = (np.concatenate(x) for x in zip(*suffix_dedup._blocks(offsets, data, True), strict=True))
        assert (last - first).max() + suffix_dedup.SPAN <= 4 * suffix_dedup.GRAM
        contexts = [(data[a:b + suffix_dedup.SPAN].tobytes(), p - a) for a, b, p in zip(first.tolist(), last.tolist(), place.tolist(), strict=True)]
        assert len(set(zip(names.tolist(), contexts, strict=True))) == len(set(names.tolist())) == len(set(contexts)) < len(contexts)
        grams = {(x, data[p:p + suffix_dedup.GRAM].tobytes()) for x, p in zip(h.tolist(), place.tolist(), strict=True)}
        assert len(grams) == len({x for x, _ in grams}) == len({g for _, g in grams})


def test_shared_anchors_come_from_packed_lists(spark, monkeypatch):
    rnd = random.Random(11)
    common = "a common phrase, of twenty-odd bytes"
    rows = [(n // 2, "".join(rnd.choice("abcd ") for _ in range(60)) + common * rnd.randint(0, 2)) for n in range(80)]
    ids, texts = pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 400)
    lists = list(suffix_dedup._hash_lists(iter([pa.RecordBatch.from_arrays([ids, texts], ["id", "t"])])))
    assert len(lists) > 5
    pairs = {}
    data, offsets = suffix_dedup.string_buffers(texts)
    for own, h, *_ in suffix_dedup._blocks(offsets, data):
        for r, x in zip(own.tolist(), h.view(np.int64).tolist(), strict=True):
            pairs.setdefault(x, set()).add(rows[r][0])
    whole = pa.Table.from_batches(lists).append_column("chunk", pa.array(range(len(lists)), pa.int64()))
    # a list sends at most two entries of a hash, however many documents have it
    for batch in suffix_dedup._ranges(6)(iter(whole.combine_chunks().to_batches())):
        for packed in batch.column("hs"):
            assert np.unique(suffix_dedup._numbers(packed)[0], return_counts=True)[1].max() <= 2
    want = {}
    for x, owners in pairs.items():
        for i in owners if len(owners) > 1 else ():
            want.setdefault(i, set()).add(x)
    df = spark.createDataFrame(whole.to_pandas())
    got = {r.id: set(np.concatenate([np.frombuffer(w, np.int64) for w in r.wanted]).tolist()) for r in suffix_dedup._wanted(df).collect()}
    assert want and got == want


def test_suffix_keys_of_many_groups_keep_their_order():
    # groups beyond 16 bits and bytes above 127 stand in their order
    rnd = np.random.default_rng(12)
    span = suffix_dedup.SPAN
    text = rnd.integers(250, 256, span).astype(np.uint8)
    data = np.concatenate([text, text, text, text])
    starts, ids = np.arange(4) * span, np.array([1, 2, 3, 4])
    got = suffix_dedup.longest_previous(data, starts, np.array([1 << 16, 1, 1 << 16, 1 << 33]), ids)
    assert got.tolist() == [0, 0, span, 0]
