import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import xxhash
from helpers import empty, table

from wardline.llm import pii_crf
from wardline.llm.sharding import balanced_shards, cut_stars, equal_text_links, propagate

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    return {"email": [m.span() for m in EMAIL.finditer(text)],
            "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
            "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
            "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]}


def test_base_patterns_against_plain_regular_expressions():
    rnd = random.Random(3)
    parts = ["4539578763621486", "10.", "1", ".", "255", "256", "007", " ", "-", "+", "a@b.c", "@", "x", "(", "é", "+1 (555) 010-4477"]
    for _ in range(8000):
        for text in ("".join(rnd.choice("a1.@-+ 2(%é)0:") for _ in range(rnd.randint(1, 40))),
                     "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14)))):
            assert pii_crf.base_spans(text) == brute(text)


def test_field_learns_its_table_and_decodes_like_brute_force():
    field = pii_crf.train()
    seed = pii_crf._seed()
    found = pii_crf.viterbi(field, [field.scores(t) for t, _ in seed])
    assert sum(list(f) != g for f, (_, g) in zip(found, seed, strict=True)) <= 1
    from itertools import product
    for tokens, _ in seed:
        if len(tokens) <= 3:
            s = field.scores(tokens)
            best = max(product(range(5), repeat=len(tokens)), key=lambda p, s=s: (
                field.ends[0][p[0]] + field.ends[1][p[-1]] + sum(s[i][k] for i, k in enumerate(p))
                + sum(field.move[a][b] for a, b in zip(p, p[1:], strict=False))))
            assert list(pii_crf.viterbi(field, [s])[0]) == list(best)


def test_spans_of_frames(spark):
    texts = [None, "", "mail é ana@x.org, ip 10.0.0.1 or 10.0.0.999 card 4539578763621486 tel +1 (555) 010-4477.",
             "call (212) 555-0187 today", "1999 and 2,000 words in 12-14", "a" * 200_000 + " 8.8.8.8", "9" * 50_000, "漢 4.4.4.4",
             "7 " * 20_000]
    rows = list(enumerate(texts)) + [(2, texts[2]), (None, "x@y.zz")]
    for clashes in (False, True):
        got = pii_crf.find_personal_data(table(spark, rows, clashes)).collect()
        assert len(got) == len(rows)
        for r in got:
            want = brute(r.text or "")
            flat = ",".join(f"{k}:{s}:{e}" for k in pii_crf.KINDS for s, e in want[k])
            assert r.pii.base == flat and set(filter(None, flat.split(","))) <= set(r.pii.spans.split(","))
            assert (r.pii.n_email, r.pii.n_ip, r.pii.n_card, r.pii.n_phone) == tuple(len(want[k]) for k in pii_crf.KINDS)
    by_id = {r.doc_id: r.pii for r in got}
    assert by_id[3].spans == "phone:5:19" and by_id[4].spans == "" and by_id[0].spans == ""
    assert pii_crf.find_personal_data(empty(spark)).count() == 0


def test_added_spans_touch_no_base_span():
    texts = ["4539578763621486 4539578763621487", "+1 (826) 555-4081 190.137.2.1", "x@y.org 10.1.1.1 (212) 555-0187"]
    for t, (base, spans) in zip(texts, pii_crf.find_batch(texts, pii_crf.train()), strict=True):
        flat = {(k, *s) for k in base for s in base[k]}
        for k, s, e in set(spans) - flat:
            assert not any(a < e and s < b for _, a, b in flat), (t, k, s, e)


def check_law(rows, shards=8):
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes[s] for s in range(shards)) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_shards_are_balanced_and_keep_groups(spark):
    rows = [(n, f"text {n}") for n in range(200)] + [(1000 + n, f"copy {n % 30}") for n in range(90)]
    rows += [(2000, None), (2001, ""), (None, "copy 1"), (3, "text 3"), (2002, "é")]
    docs = table(spark, rows, True)
    got = balanced_shards(docs, equal_text_links(docs)).collect()
    assert len(got) == len(rows)
    check_law(got)
    size = {(r.doc_id, r.text_crc32): r.size for r in got}
    assert all(size[i, zlib.crc32((t or "").encode())] == len((t or "").encode()) + 1 for i, t in rows)
    places = defaultdict(set)
    for r in got:
        if r.doc_id and 1000 <= r.doc_id < 2000:
            places[r.text_crc32].add(r.shard)
    assert sum(len(p) > 1 for p in places.values()) <= 3


def test_a_group_larger_than_a_shard_is_split(spark):
    docs = table(spark, [(n, "same") for n in range(60)] + [(100 + n, f"other {n}") for n in range(41)])
    got = balanced_shards(docs, equal_text_links(docs)).collect()
    check_law(got)
    together = Counter(r.shard for r in got if r.doc_id < 60)
    assert max(together.values()) >= 11  # a whole shard is theirs
    check_law(balanced_shards(table(spark, [(1, "a"), (2, "b")]), equal_text_links(empty(spark))).collect())
    assert balanced_shards(empty(spark), equal_text_links(empty(spark))).count() == 0


def test_large_groups_touch_as_few_shards_as_their_size_allows(spark):
    rows = ([(n, "same") for n in range(60)] + [(n, "also the same") for n in range(100, 120)]
            + [(200 + n, f"pair {n // 3}") for n in range(12)] + [(300 + n, f"other {n}") for n in range(40)])
    docs = table(spark, rows)
    got = balanced_shards(docs, equal_text_links(docs)).collect()  # 132 rows, so 16 or 17 a shard
    check_law(got)
    assert len(got) == len(rows)
    shards = defaultdict(set)
    text = dict(rows)
    for r in got:
        shards[text[r.doc_id]].add(r.shard)
    assert len(shards["same"]) == 4 and len(shards["also the same"]) == 2
    assert all(len(shards[f"pair {n}"]) == 1 for n in range(4))


def test_ids_on_several_texts_keep_their_rows_and_the_law(spark):
    cases = {
        "two large, large and small": [(n, "same") for n in range(40)] + [(n, "also") for n in range(20, 60)]
        + [(n, "pair") for n in (3, 80, 81)] + [(200 + n, f"o{n}") for n in range(40)],
        "hub of one follows another": [(n, "same") for n in (0, 5, *range(10, 30))] + [(n, "also") for n in (5, *range(40, 70))],
        "few rows": [(1, "a"), (2, "a"), (3, "a"), (3, "b"), (4, "b"), (3, "b"), (5, "c"), (6, "c"), (7, "d")],
    }
    for rows in cases.values():
        docs = table(spark, rows)
        got = balanced_shards(docs, equal_text_links(docs)).collect()
        assert sorted((r.doc_id, r.size) for r in got) == sorted((i, len(t) + 1) for i, t in rows)
        check_law(got)
        links = equal_text_links(docs)
        whole, others, _ = cut_stars(links, max(1, len(rows) // 8))
        if whole is not None:
            settled = [r.id for r in whole.collect()]
            assert len(settled) == len(set(settled))
            assert not {x for r in others.collect() for x in r} & set(settled)


def hashed(*values):
    """Spark's xxhash64: each value is hashed with the hash so far as seed."""
    h = 42
    for v, fmt in values:
        h = xxhash.xxh64_intdigest(struct.pack(fmt, v), seed=h)
    return h


def plain_propagation(edges, room, shards=8, rounds=6):
    near = defaultdict(list)
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    follower = {i: min(n) < i for i, n in near.items()}
    unit = {i: min(i, *n) for i, n in near.items()}
    size = Counter(unit.values())
    shard = {i: hashed((i, "<q")) % shards if hashed((i, "<q")) < 1 << 63 else (hashed((i, "<q")) - (1 << 64)) % shards for i in near}
    for turn in range(1, rounds + 1):
        asks = {}
        for i, n in near.items():
            votes = Counter(shard[x] for x in n)
            to = max(votes, key=lambda s, v=votes: (v[s], -s))
            gain = votes[to] - votes[shard[i]]
            if to != shard[i] and gain > 0 and follower[i] == (turn % 2 == 1):
                asks[i] = (to, int(math.log2(gain)), int(math.log2(size[unit[i]])))
        want, free, share = Counter(asks.values()), {s: max(0, room - n) for s, n in Counter({s: 0 for s in range(shards)}).items()}, {}
        for s, n in Counter(shard.values()).items():
            free[s] = max(0, room - n)
        for key in sorted(want, key=lambda k: (k[0], -k[1], k[2])):
            share[key] = min(1.0, free[key[0]] / want[key])
            free[key[0]] = max(0, free[key[0]] - want[key])
        for i, key in asks.items():
            h = hashed((unit[i], "<q"), (turn, "<i"))
            if (h - (1 << 64) * (h >> 63)) % (1 << 40) / float(1 << 40) < share[key]:
                shard[i] = key[0]
        if turn > 1 and not want:
            break
    return shard


def test_propagation_against_plain_python(spark):
    rnd = random.Random(8)
    for room in (9, 14, 40):
        edges, at = [], 0
        while at < 90:
            n = rnd.randint(2, 9)
            edges += [(at + k, at) for k in range(1, n)]
            at += n
        got = propagate(spark.createDataFrame(edges, "a long, b long"), room).df.collect()
        assert {r.id: r.shard for r in got} == plain_propagation(edges, room)
