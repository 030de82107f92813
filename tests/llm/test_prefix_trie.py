"""The trie against one built with dictionaries, and the centroid rounds against plain recursion."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from wardline.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, base=lambda c: c, head=lambda c: 0):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [t for *_, t in sorted(x)] for c, x in own.items()}
    built = {c: tuple(own.get(base(c), [])[:head(c)] + turns[head(c):]) for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        cost = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += cost
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


def unordered(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.select(*columns).collect()))


def trie(spark, rows):
    return T.conversation_trie(*T.whole(T.ordered_turns(spark.createDataFrame(rows, SCHEMA))))


def test_shared_heads_nulls_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 4)
    monkeypatch.setattr(T, "CHUNK_BITS", 2)
    rnd = random.Random(4)
    rows = []
    for c in [*range(-7, 40), 1000, 1001]:
        common = rnd.random() < 0.4
        for turn in range(rnd.randint(1, 14)):
            rows.append((c, turn if rnd.random() < 0.9 else rnd.choice([None, 0, 3]),
                         rnd.choice([None, "user", "assistant"]) if not common else "user", rnd.choice(["a", "é", "bb", "", None]) if not common else f"t{turn}"))
    rows += rows[:30] + [(3, 5, "user", "x")] * 11 + [(None, 1, "user", "y"), (None, None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("d", "k", "a", "total", "digest", "depth", "part")])
    head = F.crc32(F.col("conv_id").cast("string")) % 9
    got = T.conversation_trie(*T.with_shared_heads(T.ordered_turns(frame), F.col("conv_id") - F.col("conv_id") % 5, head, 8))

    def base(c):
        return c - (abs(c) % 5) * (1 if c >= 0 else -1)

    assert unordered(got) == brute(rows, base, lambda c: zlib.crc32(str(c).encode()) % 9)


def test_a_long_path_with_branches(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 16)
    rows = [(c, t, "user", f"{t}" if t < cut else f"{c}-{t}") for c, (n, cut) in enumerate(
        [(150, 150), (150, 149), (40, 20), (90, 70), (150, 150), (1, 1), (1, 0), (60, 0), (3, 1)]) for t in range(n)]
    assert unordered(trie(spark, rows)) == brute(rows)


def test_every_conversation_extends_the_one_before(spark):
    rows = [(c, t, "user", str(t)) for c in range(25) for t in range(c + 1)]
    assert unordered(trie(spark, rows)) == brute(rows)


def test_copies_single_conversations_and_empty_tables(spark):
    rows = [(c, t, "user", "same") for c in range(60) for t in range(3)]
    assert unordered(trie(spark, rows)) == brute(rows)
    assert unordered(trie(spark, [(9, None, None, None)])) == brute([(9, None, None, None)])
    assert trie(spark, []).count() == 0
