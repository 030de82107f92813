import corpus_pipeline as P
import numpy as np
from helpers import lower, table
from test_exact_and_decontamination import brute as brute_contamination
from test_near_dups_and_repeats import brute_print

SF = "/root/testdata/sf0.001"


def brute_exact(rows):
    """Rows that stay: the largest id of each text, repeated rows once."""
    last = {}
    for i, t in rows:
        last[lower(t)] = max(i, last.get(lower(t), i))
    return sorted({(i, t or "") for i, t in rows if last[lower(t)] == i})


def brute_near(rows):
    """Rows that stay: the smallest id of each component of fingerprints within two bits."""
    ids = [i for i, _ in rows]
    prints = np.array([brute_print(t) for _, t in rows], np.uint64)
    best = np.arange(len(ids))
    changed = True
    while changed:
        changed = False
        for k in range(len(ids)):
            near = np.flatnonzero(np.bitwise_count(prints ^ prints[k]) <= 2)
            low = min(best[near], key=lambda j: ids[j])
            if (best[near] != low).any():
                best[near] = low
                changed = True
    return [r for k, r in enumerate(rows) if ids[best[k]] == r[0]]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    start = P.language_stage(spark, docs, SF)
    assert start.columns == docs.columns
    rows = sorted((r.doc_id, r.text) for r in start.select("doc_id", "text").collect())
    assert len(rows) >= 0.95 * docs.count()  # clean documents stay
    exact = brute_exact(rows)
    near = brute_near(exact)
    clean = {r[0] for r in brute_contamination(near, bench) if not r[2]}
    want = [r for r in near if r[0] in clean]
    got = P.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == [i for i, _ in want]
    assert all(r.round_trip and r.n_pieces == len(r.ids) and r.scores == sorted(r.scores, reverse=True) for r in got)


def test_each_stage_on_odd_rows(spark):
    text = "the and of that with this for the and of that with this for one two"
    rows = [(1, None), (2, ""), (3, "12 34"), (4, text), (5, text.upper()), (5, text.upper()), (6, text + " x"), (None, "der die das und nicht"),
            (7, "word " * 20_000), (8, "a"), (9, "zz yy xx")]
    docs = table(spark, rows, True)
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        if name != "piece_encoding":
            assert out.columns == docs.columns
        kept = [r.doc_id for r in out.collect()]
        if name == "language_id":
            assert not {1, 2, 3} & set(kept) and {4, 5, 6, 7} <= set(kept)
        elif name == "exact_dedup":
            assert 4 not in kept and kept.count(5) == 1 and 2 in kept and 1 not in kept
        elif name == "simhash_dedup":
            assert kept.count(4) == 1 and 5 not in kept
        elif name == "piece_encoding":
            assert len(kept) == len(rows)
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_stage_order():
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "simhash_dedup", "decontamination", "piece_encoding"]
