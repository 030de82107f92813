import hashlib
import random
import re
from collections import defaultdict

from helpers import empty, lower, table, unordered

from wardline.llm import exact_dedup
from wardline.llm.decontaminate import contamination, drop_contaminated
from wardline.llm.exact_dedup import drop_exact_copies, exact_groups

ROWS = [(1, "Alpha beta"), (2, "alpha BETA"), (3, None), (4, ""), (5, "Éa"), (6, "éa"), (7, "x" * 300_000),
        (8, "X" * 300_000), (9, "alpha betA"), (9, "alpha betA"), (10, "alpha betB"), (11, "unique text")]


def test_exact_groups_against_brute_force(spark):
    groups = defaultdict(set)
    for i, t in ROWS:
        groups[lower(t)].add(i)
    want = sorted({(i, max(groups[lower(t)]), len(groups[lower(t)]), i == max(groups[lower(t)]),
                    hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in ROWS}, key=repr)
    for clashes in (False, True):
        assert unordered(exact_groups(table(spark, ROWS, clashes), digest_all=True)) == want
    # the whole text of a document that shares no prefix is not hashed
    digests = {r.doc_id: r.text_sha256 for r in exact_groups(table(spark, ROWS)).collect()}
    assert digests[11] is None and digests[9] is not None


def test_exact_copies_leave_one_row(spark):
    kept = drop_exact_copies(table(spark, ROWS + [(None, "alpha beta"), (None, "alone")], True))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 5, 6, 8, 9, 10, 11]
    assert kept.columns == table(spark, ROWS, True).columns
    assert drop_exact_copies(empty(spark)).count() == 0 and exact_groups(empty(spark)).count() == 0


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for item, it in items:
            iw = words(it)
            m = min(10, len(iw))
            for j in range(len(iw) - m + 1 if m else 0):
                for k in range(len(w) - m + 1):
                    if w[k:k + m] == iw[j:j + m]:
                        hit.update(range(k, k + m))
                        names.add(item)
        out.append((i, len(w), len(hit), sorted(map(str, names - {None})), sorted(hit)))
    return sorted(out, key=repr)


def test_contamination_against_brute_force(spark):
    rnd = random.Random(5)
    vocab = ["ab", "cd", "Σας", "e", "K9", "zz"]
    items = [(n, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 5, 6, 7, 9, 10, 14, 30])))) for n in range(12)]
    items += [(50, None), (51, "--- !!"), (None, "only here it stands"), (3, "another text of item three"), items[4]]
    docs = [(100 + n, ", ".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 3, 9, 10, 11, 60])))) for n in range(25)]
    docs += [(200, "X " + items[8][1].upper().replace("Σ", "Σ") + " y"), (201, None), (202, ""), (203, "a only here it stands b"),
             (204, "another text of item three"), (204, "another text of item three"), (None, items[9][1]),
             (205, "word " * 3000 + (items[8][1] or ""))]
    want = brute(docs, items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for clashes in (False, True):
        assert unordered(contamination(table(spark, docs, clashes), bench)) == want
    clean = drop_contaminated(table(spark, docs, True), bench)
    assert sorted(r.doc_id or 0 for r in clean.collect()) == sorted(w[0] or 0 for w in want if not w[2])
    assert clean.columns == table(spark, docs, True).columns


def test_contamination_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert unordered(contamination(table(spark, [(1, "a b"), (2, None)]), bench)) == [(1, 2, 0, [], []), (2, 0, 0, [], [])]
    assert contamination(empty(spark), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_texts_that_no_other_can_equal_are_not_hashed(spark, monkeypatch):
    sha2 = exact_dedup.F.sha2

    def hashed(c, bits):
        alone = exact_dedup.F.contains(c, exact_dedup.F.lit("alone"))
        return exact_dedup.F.when(alone, exact_dedup.F.raise_error("hashed").cast("string")).otherwise(sha2(c, bits))

    monkeypatch.setattr(exact_dedup.F, "sha2", hashed)
    rows = [(1, "same"), (2, "Same"), (3, "all alone"), (None, "alone with no id"), (None, "alone again, with no id"),
            (3, "alone, by the same id"), (4, "four"), (4, "four"), (None, "same"), (5, None), (6, "")]
    kept = exact_dedup.drop_exact_copies(table(spark, rows, True)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([*rows[1:7], rows[10]], key=repr)
