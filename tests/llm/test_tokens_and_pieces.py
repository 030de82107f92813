import random

import numpy as np
import public_tokenizers
import sentencepiece
from helpers import empty, table

from wardline.llm import piece_nbest as N
from wardline.llm.token_counts import SegmentCounts, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = open(PATH, "rb").read()
TEXTS = ["", None, " ", "  ", "a", "a ", " a", "a  b   c", "\n", "\n\nx\n", "tab\there", "▁", "a▁b", "<s> </s> <unk> <0x0A>",
         "naïve café ☃ 漢字 🙂", "x" * 5000, "The quick brown fox.\nJumps  over", "a b c", "\x00\x01", "é" * 300, "don't re-do 3.14"]


def test_counts_are_the_librarys(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(4, "a"), (None, "b c")]
    for clashes in (False, True):
        got = token_counts(table(spark, rows, clashes), MODEL).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.n_tokens == len(sp.encode(r.text or ""))
    assert token_counts(empty(spark), MODEL).count() == 0


def test_cache_restart_keeps_counts(monkeypatch):
    monkeypatch.setattr("wardline.llm.token_counts.CACHE_ENTRIES", 3)
    counts = SegmentCounts(MODEL, {" the": 1})
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    text = "the cat sat on the mat and the dog lay by the log"
    assert [counts.count(text) for _ in range(2)] == [len(sp.encode(text))] * 2 and len(counts) <= 4


def brute(vocab, text):
    """Scores of all segmentations, best first."""
    out = []

    def walk(i, score):
        if i == len(text):
            out.append(score)
        for j in range(i + 1, len(text) + 1):
            p = vocab.ids.get(text[i:j], -1)
            if p >= 0 or j == i + 1:
                walk(j, score + (float(vocab.score[p]) if p >= 0 else vocab.unknown))

    walk(0, 0.0)
    return sorted(out, reverse=True)


def test_segments_against_all_segmentations():
    vocab, rnd = N.Vocabulary(MODEL), random.Random(1)
    table_ = N.SegmentTable(vocab)
    for _ in range(200):
        text = "".join(rnd.choice("theanro é\n 1☃x") for _ in range(rnd.randint(1, 8)))
        for segment in map(N._marked, N.SEGMENT.findall(" " + text)):
            want = brute(vocab, segment)
            found = N.n_best(vocab, segment, 5)
            assert [s for s, _ in found] == want[:5]
            assert len({tuple(i) for _, i in found}) == len(found)
            long, (ids, sizes, score, gap) = N.best_two_long(vocab, segment), N.best_two(vocab, [segment, segment])
            assert long[1] == score[0] == score[1] == want[0] and long[0] == ids[:sizes[0]].tolist()
            assert long[2] == gap[0] == (want[0] - want[1] if len(want) > 1 else np.inf)
        ids, ends, scores, others = N.encode_block(table_, [text], 4)
        whole = brute(vocab, N._marked(" " + text))
        assert scores[0] == whole[:4] and [o["score"] for o in others[0]] == whole[1:4]
        assert N.decode(vocab, ids, ends) == [text]


def n_best_scores(vocab, text, n):
    """The n best scores by a forward pass that keeps n scores a place."""
    top = [[0.0]] + [[]] * len(text)
    for j in range(1, len(text) + 1):
        ways = []
        for i in range(max(0, j - vocab.longest), j):
            p = vocab.ids.get(text[i:j], -1)
            if p >= 0 or i == j - 1:
                ways += [s + (float(vocab.score[p]) if p >= 0 else vocab.unknown) for s in top[i]]
        top[j] = sorted(ways, reverse=True)[:n]
    return top[-1]


def test_runs_of_one_character_have_bounded_search(monkeypatch):
    vocab = N.Vocabulary(MODEL)
    pops, pop = [0], N.heapq.heappop

    def counted(agenda):
        pops[0] += 1
        assert pops[0] <= 200_000, "the search goes through tied hypotheses"
        return pop(agenda)

    monkeypatch.setattr(N.heapq, "heappop", counted)
    for c in "#-=":
        for size in (40, 1007, 2000, 5000):
            pops[0], text = 0, N.SPACE + c * size
            found = N.n_best(vocab, text, 4)
            assert [s for s, _ in found] == n_best_scores(vocab, text, 4)
            assert len({tuple(i) for _, i in found}) == 4
            assert all("".join(vocab.pieces[i] for i in ids) == text and sum(vocab.score[ids]) == s for s, ids in found)
            assert found[0][1] == N.best_two_long(vocab, text)[0]  # alternatives differ from the best segmentation
    _, _, scores, others = N.encode_block(N.SegmentTable(vocab), ["a\n" + "#" * 2000 + "\nb " + "-" * 5000], 4)
    assert len(scores[0]) == 4 and len(others[0]) == 3


def test_alternatives_change_the_named_segments():
    vocab = N.Vocabulary(MODEL)
    table_ = N.SegmentTable(vocab)
    text = "there are several ways to cut this"
    segments = N.SEGMENT.findall(" " + text)
    best = [N.n_best(vocab, N._marked(s), 1)[0][1] for s in segments]
    ids, _, scores, others = N.encode_block(table_, [text], 4)
    assert ids.tolist() == [i for b in best for i in b]
    seen = {tuple(ids.tolist())}
    for score, other in zip(scores[0][1:], others[0], strict=True):
        changed = dict(enumerate(best)) | {c["segment"]: c["ids"] for c in other["changes"]}
        flat = [i for k in range(len(segments)) for i in changed[k]]
        assert sum(vocab.score[flat]) == score and "".join(vocab.pieces[i] for i in flat) == N._marked(" " + text)
        assert tuple(flat) not in seen
        seen.add(tuple(flat))


def test_frames_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, "")]
    for clashes in (False, True):
        encoded = N.encode_pieces(table(spark, rows, clashes), MODEL, out="enc")
        got = N.decode_pieces(encoded.select("doc_id", "text", "enc.*"), MODEL).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.decoded == (r.text or "").replace("▁", " ")
            assert bool(r.scores) == bool(r.text) and r.scores == sorted(r.scores, reverse=True)
    assert N.encode_pieces(empty(spark), MODEL).count() == 0
