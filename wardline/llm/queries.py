"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them.

SQL words and patterns follow the contracts of the queries; ``[^\\x00-...]``
ranges are written out because DuckDB's engine works on UTF-8 as Spark's does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@_register("op5_exact_dedup", f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
""")
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.exact_dedup import exact_groups
    return exact_groups(table(spark, sf_dir, "documents"), digest_all=True)


_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@_register("op7_decontamination", f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iwin AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[j:j + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS j FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM iwin),
dwin AS (
  SELECT doc_id, m, j, array_to_string(w[j:j + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS j FROM dw, sizes WHERE len(w) >= m)),
hit AS (SELECT doc_id, m, j, item_id FROM dwin JOIN iwin USING (m, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(j, j + m)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                 string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.decontaminate import contamination
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@_register("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from wardline.llm.token_counts import token_counts
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, model).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens",
        (F.col("n_tokens") > 4096).alias("over_limit"))


@_register("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.common import crc32_mod3
    from wardline.llm.toxicity import toxicity, train
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc32_mod3(F.col("doc_id")) == 1
    weights = train(docs, table(spark, sf_dir, "labels").filter(~held_out))
    scored = toxicity(docs, weights)
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@_register("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.common import crc32_mod3
    from wardline.llm.language_id import language, train
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc32_mod3(F.col("doc_id")) == 1
    net = train(docs.filter(~held_out))
    return language(docs.select("doc_id", "text"), net).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")


@_register("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.simhash import hex_fingerprint, near_groups
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@_register("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.pii_crf import find_personal_data
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "pii.n_email", "pii.n_ip", "pii.n_card", "pii.n_phone",
                        F.sha2("pii.base", 256).alias("base_sha256"), "pii.spans")


@_register("op8_sharding")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.sharding import balanced_shards, equal_text_links
    docs = table(spark, sf_dir, "documents")
    placed = balanced_shards(docs, equal_text_links(docs))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@_register("op4_piece_nbest")
def op4_piece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the best segmentation, the n best scores, what the alternatives change, and the decoded text's digest."""
    import public_tokenizers

    from wardline.llm.piece_nbest import encode_pieces
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    docs = encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), model, with_text=True)
    docs = docs.select("doc_id", "text", "pieces.*")
    # U+2581 stands for a space in the vocabulary
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("▁"), F.lit(" "))
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "scores", "others",
                       F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == text).alias("round_trip"))


# bytes as pairs of hex digits, so that positions count bytes
@_register("op6_suffix_dedup", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS s
      FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS k FROM d WHERE len(h) >= 100)),
hits AS (SELECT doc_id, k FROM (SELECT doc_id, k, doc_id > min(doc_id) OVER (PARTITION BY s) AS hit FROM w) WHERE hit),
steps AS (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 50 THEN 0 ELSE 1 END AS fresh FROM hits),
runs AS (SELECT doc_id, k, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM steps),
spans AS (SELECT doc_id, min(k) AS s, max(k) + 50 AS e FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS since FROM spans),
kept AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans,
                string_agg(substr(h, 2 * since + 1, 2 * (s - since)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS rest
         FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""")
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.suffix_dedup import repeated_spans
    found = repeated_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


# crc32 of a decimal number in SQL: the table of 256 remainders, folded over its digits
_CRC = """
step(b, c, k) AS (SELECT range, range, 0 FROM range(256)
                  UNION ALL SELECT b, xor(c >> 1, (c & 1) * 3988292384), k + 1 FROM step WHERE k < 8),
crcs AS (SELECT list(c ORDER BY b) AS crcs FROM step WHERE k = 8)"""


def _crc32_sql(number: str) -> str:
    digits = f"list_transform(string_split({number}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], {digits}), lambda c, x: xor(c >> 8, crcs[1 + (xor(c, x) & 255)])), "
            "4294967295)")


@_register("op11_periodic_runs", f"""
WITH RECURSIVE {_CRC},
split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {_crc32_sql('doc_id')} AS h FROM documents, crcs),
planted AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE
        list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) END AS w
      FROM planted),
words AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS x FROM d),
pairs AS (SELECT l.doc_id, r.i - l.i AS q, l.i
          FROM words l JOIN words r ON l.doc_id = r.doc_id AND l.x = r.x AND r.i > l.i AND 3 * (r.i - l.i) <= l.n),
steps AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
found AS (SELECT doc_id, min(i) AS s, count(*) + q AS l, q FROM steps GROUP BY doc_id, q, island
          HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT doc_id, s, l, min(q) AS q FROM found GROUP BY doc_id, s, l),
best AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q)) AS runs_sha256,
                arg_min((s, l, q), (-l::DOUBLE / q, s, q)) AS r
         FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, r[1] AS start, r[2] AS length, r[3] AS period, 1000 * r[2] // r[3] AS exponent_milli,
       coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
""")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text; where crc32 of the id ends in 0, what follows a word of the text is made periodic first (null id: no)."""
    from wardline.llm.periodic_runs import periodic_runs
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    docs = docs.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)))
    docs = docs.withColumn("n", F.size("w")).withColumn("a", F.expr("if(n > 0, h div 10 % n, 0)"))
    docs = docs.withColumn("p", F.expr("1 + (n - a) div (3 + h div 10 % 8)"))
    # the words before a, then the p words from a on over and over
    periods = F.expr("flatten(array_repeat(slice(w, int(a) + 1, int(p)), int((n - a) div p) + 1))")
    planted = F.array_join(F.slice(F.concat(F.expr("slice(w, 1, int(a))"), periods), F.lit(1), F.col("n")), " ")
    text = F.when(F.col("n") > 0, planted).otherwise(F.col("text"))
    found = periodic_runs(docs.select("doc_id", text.alias("text"))).select("doc_id", "periodic.*")
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    # runs stand by start and period, so of equal exponents the first stays
    best = F.reduce("runs", none, lambda b, r: F.when(
        b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


_CONV_HEAD = 8  # a conversation shares at most this many first turns with its base


@_register("op13_prefix_trie", f"""
WITH RECURSIVE {_CRC},
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(r) || ':' || r || x)) - 1 AS k, r, x
      FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
sizes AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
c AS (SELECT s.conv_id, s.conv_id - s.conv_id % 5 AS base, {_crc32_sql('s.conv_id')} % 9 AS h,
             least({_crc32_sql('s.conv_id')} % 9, coalesce(b.n, 0)) AS lent
      FROM sizes s LEFT JOIN sizes b ON b.conv_id = s.conv_id - s.conv_id % 5, crcs),
rebuilt AS (SELECT c.conv_id, k + 1 AS d, r, x FROM c JOIN t ON t.conv_id = c.base AND k < lent
            UNION ALL SELECT c.conv_id, lent + k - h + 1, r, x FROM c JOIN t ON t.conv_id = c.conv_id AND k >= h),
keyed AS (SELECT conv_id, d, strlen(x) AS b, md5(string_agg(md5(strlen(r) || ':' || r || x), '' ORDER BY d)
                 OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)) AS p FROM rebuilt
          UNION ALL SELECT conv_id, 0, 0, '' FROM c),
named AS (SELECT conv_id, d, b, min(conv_id) OVER w AS name, count(*) OVER w AS n_convs,
                 d = max(d) OVER (PARTITION BY conv_id) AS ends FROM keyed WINDOW w AS (PARTITION BY d, p)),
nodes AS (SELECT name, d, max(b) AS b, max(n_convs) AS n_convs,
                 sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
          FROM named GROUP BY name, d),
edges AS (SELECT n.name, n.d, u.name AS parent FROM nodes n LEFT JOIN named u ON u.conv_id = n.name AND u.d = n.d - 1),
kids AS (SELECT parent AS name, d - 1 AS d, count(*) AS n FROM edges WHERE parent IS NOT NULL GROUP BY ALL),
full_nodes AS (SELECT nodes.*, parent, coalesce(kids.n, 0) AS n_children
               FROM nodes JOIN edges USING (name, d) LEFT JOIN kids USING (name, d)),
sums AS (SELECT u.name, u.d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.b) AS saved
         FROM full_nodes f JOIN named u ON u.conv_id = f.name AND u.d <= f.d GROUP BY u.name, u.d)
SELECT name AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM full_nodes JOIN sums USING (name, d)
""")
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of the conversations after their first turns are replaced by those of the first conversation of their five."""
    from wardline.llm.prefix_trie import conversation_trie, ordered_turns, with_shared_heads
    turns = ordered_turns(table(spark, sf_dir, "conversations"))
    head = F.crc32(F.col("conv_id").cast("string")) % (_CONV_HEAD + 1)
    return conversation_trie(*with_shared_heads(turns, F.col("conv_id") - F.col("conv_id") % 5, head, _CONV_HEAD))


@_register("op12_secret_scan")
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.secret_scan import scan_secrets
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "secrets.n_assign", "secrets.n_access", "secrets.n_hex",
                        F.sha2("secrets.base", 256).alias("base_sha256"), "secrets.spans")
