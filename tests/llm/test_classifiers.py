import numpy as np
import pyarrow as pa
import pytest
from helpers import empty, table
from pyspark.sql import functions as F


from wardline.llm import language_id, toxicity, words_np
from wardline.llm.common import string_buffers
from wardline.llm.queries import QUERIES


SF = "/root/testdata/sf0.01"


def auc(score, label):
    pos, neg = score[label == 1], score[label == 0]
    return (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()


def test_toxicity_on_held_out_documents(spark):
    scored = QUERIES["op1_toxicity"](spark, SF)
    assert scored.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = scored.filter("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert auc(held.score.to_numpy(), held.toxic.to_numpy()) > 0.85
    assert held[held.toxic == 0].predicted.mean() < 0.05
    assert scored.filter("predicted != cast(score >= 0.7 as int) or score < 0 or score > 1").count() == 0


def test_toxicity_edges(spark):
    rows = [(n, "nice words here" if n % 2 else "vile words here") for n in range(40)] + [(90, None), (91, ""), (0, "vile")]
    labels = spark.createDataFrame([(n, None, 1 - n % 2) for n in range(40)] + [(None, None, 1), (3, None, None), (7, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    docs = table(spark, rows, True)
    weights = toxicity.train(docs, labels)
    got = {(r.doc_id, r.text): r.tox for r in toxicity.toxicity(docs, weights, out="tox").collect()}
    assert len(got) == 43 and min(v for (i, t), v in got.items() if t and "vile" in t) > max(
        v for (i, t), v in got.items() if t and "nice" in t)
    assert got[90, None] == got[91, ""]
    assert toxicity.train(docs, labels.filter("toxic = 1")) is None and toxicity.train(empty(spark), labels) is None
    assert toxicity.toxicity(docs, None, out="tox").filter("tox != 0").count() == 0
    assert toxicity.toxicity(empty(spark), weights).count() == 0


def brute_features(text):
    """The distinct features of a text as word tuples."""
    import re
    w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text))
    return {(a,) for a in w} | {(1, *p) for p in zip(w, w[1:], strict=False)} | {(2, *p) for p in zip(w, w[2:], strict=False)}


def test_features_are_distinct_words_pairs_and_skip_pairs():
    texts = ["A b a b", "", "one TWO one-two", "é É\nx", "b", None, "tail"]
    data, offsets = string_buffers(pa.array(texts))


    for _, _, h, rows in words_np.hashed_blocks(data, offsets):
        bucket, owner = toxicity.features(h, rows)
        for row, t in enumerate(texts):
            assert len(set(bucket[owner == row].tolist())) == len(brute_features(t or ""))
    one = {t: next(words_np.hashed_blocks(*string_buffers(pa.array([t]))))[2].tolist() for t in ("one two", "ONE  two!")}
    assert one["one two"] == one["ONE  two!"]


def test_long_texts_are_hashed_alike_in_pieces(monkeypatch):
    texts = pa.array(["word%d and more " % n * 40 for n in range(8)] + ["x" * 90, "", "end"])
    data, offsets = string_buffers(texts)
    whole = [(h.tolist(), r.tolist()) for _, _, h, r in words_np.hashed_blocks(data, offsets)]
    monkeypatch.setattr(words_np, "PIECE_BYTES", 100)
    monkeypatch.setattr(words_np.row_blocks, "__defaults__", (100,))
    parts = [(h.tolist(), r.tolist()) for _, _, h, r in words_np.hashed_blocks(data, offsets)]
    assert len(parts) > len(whole)
    assert [sum((p[k] for p in parts), []) for k in (0, 1)] == [sum((p[k] for p in whole), []) for k in (0, 1)]


def test_language_of_held_out_documents(spark):
    got = QUERIES["op9_language_id"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = got.filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert got.count() == docs.count() and (held.lang == held.lang_pred).mean() > 0.97
    assert got.filter("score < 0 or score > 1").count() == 0


@pytest.fixture(scope="module")
def network(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return language_id.train(docs)


def test_language_edges(spark, network):
    rows = [(1, None), (2, ""), (3, "123 456 --"), (4, "the and of that with this for"), (4, "the and of that with this for"),
            (None, "und der die das nicht ist"), (6, "the and that with " * 30_000), (7, "漢字")]
    got = language_id.language(table(spark, rows, True).drop("lang"), network).collect()
    by_text = {(r.doc_id, (r.text or "")[:10]): (r.lang_pred, r.score) for r in got}
    assert len(got) == len(rows)
    assert all(by_text[k] == ("und", 0.0) for k in ((1, ""), (2, ""), (3, "123 456 --")))
    assert by_text[4, "the and of"][0] == "en" and by_text[6, "the and th"][0] == "en" and by_text[None, "und der di"][0] == "de"
    assert by_text[7, "漢字"][0] in network.langs
    assert language_id.train(empty(spark)) is None
    assert {r.lang_pred for r in language_id.language(table(spark, rows), None).collect()} == {"und"}
    assert language_id.language(empty(spark), network).count() == 0
    only = language_id.train(table(spark, [(1, "abc def", "xx"), (2, "ghi", None), (3, None, "yy")]))
    assert only.langs == ["xx"]


def test_paired_tables_and_cut_long_rows_agree_with_the_network(network):
    texts = ["the quick and the dead " * n for n in (1, 40, 3000)] + ["", "é", "x" * 256, "y" * 257]
    data, offsets = string_buffers(pa.array(texts))
    x, rows = language_id.windows_of(data, offsets)
    pooled, _ = language_id._pooled(x, network.tables, network.bias)
    logp = language_id._log_softmax(pooled @ network.dense + network.dense_bias)
    mean = np.array([logp[rows == r].mean(axis=0) if (rows == r).any() else np.zeros(len(network.langs)) for r in range(len(texts))])
    best, score = language_id.predict_batch(pa.array(texts), network.paired())
    live = np.array([bool(t) for t in texts])
    assert (best[live] == mean.argmax(axis=1)[live]).all() and best[3] == -1
    assert np.allclose(score[live], np.exp(language_id._log_softmax(mean)).max(axis=1)[live], atol=1e-3)


def test_held_out_flag(spark):
    import zlib


    from wardline.llm.common import crc32_mod3
    got = spark.range(50).select("id", crc32_mod3(F.col("id")).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 3 for r in got)


def test_samples_are_bounded_in_rows_when_ids_repeat(spark, monkeypatch):
    rows = [(n, f"words of document {n}", "en") for n in range(4)] + [(n, "words of the other kind", "de") for n in (10, 11, 12)]
    docs = table(spark, rows + rows * 20 + [(0, "a second text of id zero", "en"), (None, "no id", "en")])
    sizes = []
    monkeypatch.setattr(language_id, "fit", lambda x, y, langs: sizes.append(np.bincount(y).tolist()))
    monkeypatch.setattr(toxicity, "fit", lambda lists, y: sizes.append([int((y == 0).sum()), int((y == 1).sum())]))
    monkeypatch.setattr(language_id, "SAMPLE_PER_LANG", 3)
    language_id.train(docs)
    labels = spark.createDataFrame([(n, int(n < 2)) for n in (0, 1, 2, 3, 10, 11, 12)], "doc_id long, toxic int")
    toxicity.train(docs, labels)
    assert sizes == [[3, 3], [4, 2]]  # documents by language (a window each), then by label
