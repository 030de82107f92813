"""Prefix trie of conversations, with sums over subtrees by centroid decomposition.

A node is a distinct sequence of the first d turns (role and text) of some conversation; it
is named by (smallest conversation that starts with it, d). The textless root has d = 0.

- **Order.** Equal rows are counted first; the distinct ones are range-partitioned by
  (conversation, turn, digest) and numbered by prefix sums of partition totals, so no task
  holds a conversation. Rows of equal turn stand by the digest of role and text.
- **Prefixes.** A prefix is keyed by its length and two 64-bit sums (exclusive or) of hashes of
  (place, turn); sums are carried across blocks of BLOCK turns. Nodes are one aggregation
  over these keys, with map-side combine.
- **Roll-up.** The parent edges form a forest of components, one at first. A node weighs as many
  conversations as pass through it, so the weight of each whole subtree is known from the same
  aggregation. A round takes the centroid of every component: the deepest node whose subtree has half
  the component's weight at least. The nodes with so heavy a subtree are just those
  from the centroid to the top. The centroid's subtree is cut off: its total is due to
  each node of that path, whose weights fall by it, and the centroid's children become tops. No part
  is heavier than half of its component, so there are at most log2(turns) + 1 rounds,
  also for a path of any length; single nodes leave at once. Each round writes one table; the
  totals meet their paths in one join at the end.
- **Ends.** The digest of a node's conversations is made in order from chunks of at most 65,536
  ids; a task holds one chunk at a time.

Defined results: rows without conversation id belong to no conversation; null turn comes
first; null role or text is empty; repeated rows are turns of their own; a conversation without
turns is a member of the root; an empty table has no nodes; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import BROADCAST_BYTES, Landed, broadcast_if_small

# Turns of a conversation that are numbered or summed in one task.
BLOCK = 4096
# Ids of a chunk of conversations that end at one node: 2 to this power.
CHUNK_BITS = 16
# Widths of a row of a broadcast table of centroids, and of path steps.
CENTROID_BYTES = 64
STEP_BYTES = 48


def _block(place: Column) -> Column:
    return F.floor(place / BLOCK)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, k, digest, n_bytes): turns numbered from 0 by turn, null first, then by digest of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"))
    rows = rows.groupBy("conv_id", "turn", "digest").agg(F.count("*").alias("m"), F.max("n_bytes").alias("n_bytes"))
    order = ["conv_id", "turn", "digest"]
    dealt = Landed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "trie-dealt")
    own = Window.partitionBy("conv_id", "part").orderBy("turn", "digest").rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.df.groupBy("conv_id", "part").agg(F.sum("m").alias("m"))
               .select("conv_id", "part", F.coalesce(F.sum("m").over(parts), F.lit(0)).alias("offset")))
    placed = dealt.df.withColumn("before", F.coalesce(F.sum("m").over(own), F.lit(0))).join(offsets, ["conv_id", "part"])
    placed = placed.withColumn("first", F.col("offset") + F.col("before")).withColumn("last", F.col("first") + F.col("m") - 1)
    # a row that stands many times is dealt out by block before it is written out
    blocks = placed.withColumn("block", F.explode(F.sequence(_block(F.col("first")), _block(F.col("last"))))).repartition("conv_id", "block")
    k = F.sequence(F.greatest("first", F.col("block") * BLOCK), F.least("last", F.col("block") * BLOCK + BLOCK - 1))
    out = Landed(blocks.select("conv_id", F.explode(k).alias("k"), "digest", "n_bytes"), "trie-turns")
    dealt.drop()
    return out.df


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (turns with ``d`` from 1 and ``total``, conversations with ``total``)."""
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("total"))
    return _with_totals(turns, convs, F.col("k") + 1), convs


def _with_totals(turns: DataFrame, convs: DataFrame, d: Column) -> DataFrame:
    """Join conversations to their turns block by block, so that a long conversation's rows meet in many tasks."""
    most = turns.groupBy("conv_id").agg(F.max(_block(F.col("k"))).alias("most"))
    dealt = convs.join(most, "conv_id").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most"))))
    joined = turns.withColumn("block", _block(F.col("k"))).join(dealt, ["conv_id", "block"])
    return joined.select("conv_id", d.alias("d"), "digest", "n_bytes", "total")


def with_shared_heads(turns: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of another one.

    The first ``head`` turns (0 to ``most``; functions of ``conv_id``) of each conversation are replaced by the first
    ``head`` turns of conversation ``base``, by all if it has fewer, by none if there is none.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = sizes.withColumns({"base": base, "head": head})
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(bases, "base", "left").withColumn("lent", F.least("head", F.coalesce("n_base", F.lit(0))))
    convs = Landed(convs.select("conv_id", "base", "head", "lent", (F.col("lent") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("total")), "trie-convs").df
    heads = (turns.filter(F.col("k") < most).withColumnRenamed("conv_id", "base").join(convs, "base").filter(F.col("k") < F.col("lent"))
             .select("conv_id", (F.col("k") + 1).alias("d"), "digest", "n_bytes", "total"))
    rest = _with_totals(turns, convs, F.when(F.col("k") >= F.col("head"), F.col("lent") + F.col("k") - F.col("head") + 1))
    return heads.unionByName(rest.filter(F.col("d").isNotNull())), convs.select("conv_id", "total")


def _prefixes(turns: DataFrame) -> DataFrame:
    """Keys (a, b) of the prefix up to each turn and (pa, pb) of the one before it."""
    z = [F.xxhash64(F.lit(seed), F.col("d"), F.col("digest")) for seed in (1, 2)]
    rows = turns.select("conv_id", "d", "n_bytes", "total", z[0].alias("za"), z[1].alias("zb"), _block(F.col("d") - 1).alias("block"))
    within = Window.partitionBy("conv_id", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("conv_id", "block").agg(F.bit_xor("za").alias("ta"), F.bit_xor("zb").alias("tb")).select(
        "conv_id", "block", *[F.coalesce(F.bit_xor(t).over(before), F.lit(0)).alias(c) for t, c in (("ta", "ca"), ("tb", "cb"))])
    rows = rows.withColumns({"a": F.bit_xor("za").over(within), "b": F.bit_xor("zb").over(within)}).join(carried, ["conv_id", "block"])
    a, b = F.col("a").bitwiseXOR(F.col("ca")), F.col("b").bitwiseXOR(F.col("cb"))
    return rows.select("conv_id", "d", "n_bytes", "total", a.alias("a"), b.alias("b"),
                       a.bitwiseXOR(F.col("za")).alias("pa"), b.bitwiseXOR(F.col("zb")).alias("pb"))


def prefix_nodes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, paths, ends).

    nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_bytes of the last text, weight (that of the subtree);
    paths: for each conversation that names a node the nodes (node_conv_id, depth) it passes, with their parents;
    ends: conversations with the node (node_conv_id, depth) at which they end.
    """
    prefixes = Landed(_prefixes(turns), "trie-prefixes").df
    key = ["d", "a", "b"]
    keys = prefixes.groupBy(*key).agg(
        F.min("conv_id").alias("name"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"),
        F.sum(F.col("total") - F.col("d") + 1).alias("weight"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    zero = F.lit(0).cast("long")
    root = (convs.agg(F.min("conv_id").alias("name"), F.count("*").alias("n_convs"), F.sum(F.col("total") + 1).alias("weight"))
            .filter("n_convs > 0").select(*[zero.alias(c) for c in key], "name", "n_convs", zero.alias("n_bytes"), "weight",
                                          *[F.lit(None).cast("long").alias(c) for c in ("pa", "pb")]))
    keys = Landed(keys.unionByName(root), "trie-keys").df
    parents = keys.select((F.col("d") + 1).alias("d"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("name").alias("parent"))
    keys = Landed(keys.join(parents, ["d", "pa", "pb"], "left").select(*key, "name", "parent", "n_convs", "n_bytes", "weight"), "trie-named").df
    children = keys.filter("d > 0").groupBy(F.col("parent").alias("conv_id"), (F.col("d") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = keys.select(F.col("name").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"),
                        "n_convs", "n_bytes", "weight").join(children, ["conv_id", "depth"], "left").fillna(0, "n_children")
    naming = keys.filter("d > 0").select(F.col("name").alias("conv_id")).distinct()
    names = keys.select(*key, F.col("name").alias("node_conv_id"), "parent")
    paths = prefixes.join(naming, "conv_id", "left_semi").join(names, key).select(
        "conv_id", F.col("d").alias("depth"), "node_conv_id", "parent")
    last = prefixes.filter(F.col("d") == F.col("total")).select("conv_id", *key)
    none = convs.filter("total = 0").select("conv_id", *[zero.alias(c) for c in key])
    ends = last.unionByName(none).join(names, key).select("conv_id", "node_conv_id", F.col("d").alias("depth"))
    return Landed(nodes, "trie-nodes").df, Landed(paths, "trie-paths").df, ends


def subtree_sums(nodes: DataFrame, paths: DataFrame, values: list[str]) -> DataFrame:
    """(conv_id, depth, sums of ``values`` over the subtree) by centroid decomposition; ``values`` are long columns of ``nodes``."""
    spark = nodes.sparkSession
    top, me = ["top_conv", "top_depth"], ["conv_id", "depth"]
    at_top = (F.col("conv_id") == F.col("top_conv")) & (F.col("depth") == F.col("top_depth"))
    alone = at_top & (F.col("weight") == F.col("n_convs"))
    root = nodes.filter("depth = 0").select("conv_id").head()
    state = nodes.select(*me, "n_convs", "weight", *values, F.when(F.col("conv_id").isNotNull(), F.lit(root and root[0])).cast("long").alias("top_conv"),
                         F.when(F.col("depth").isNotNull(), F.lit(0)).cast("long").alias("top_depth"))
    steps = paths.select("conv_id", (F.col("depth") - 1).alias("cd"), F.col("node_conv_id").alias("child"), F.col("parent").alias("above"))
    steps = broadcast_if_small(steps, STEP_BYTES)
    rounds, single = [], [state.filter(alone).select(*me, *values)]
    state = state.filter(~alone)
    while not state.isEmpty():
        tops = state.filter(at_top).select(*top, F.col("weight").alias("all"))
        few = tops.count() * CENTROID_BYTES <= BROADCAST_BYTES  # as many centroids as tops
        path = state.join(F.broadcast(tops) if few else tops, top).filter(2 * F.col("weight") >= F.col("all"))
        # grouped by a key of its own, so that the rows of a large component need not stay together after a join
        centroids = path.groupBy(F.struct(*top).alias("t")).agg(F.max(F.struct("depth", "conv_id", "weight")).alias("c"), F.max("all").alias("all")).select(
            "t.*", "all", F.col("c.depth").alias("cd"), F.col("c.conv_id").alias("cc"), F.col("c.weight").alias("cw"))
        centroids = F.broadcast(centroids) if few else Landed(centroids, "trie-centroids").df
        is_centroid = (F.col("conv_id") == F.col("cc")) & (F.col("depth") == F.col("cd"))
        cut = state.join(centroids, top).join(steps, ["conv_id", "cd"], "left")
        under = F.coalesce((F.col("depth") > F.col("cd")) & (F.col("above") == F.col("cc")), F.lit(False))
        cut = cut.select(*me, "n_convs", "weight", *values, *top, F.lit(len(rounds)).alias("round"), "cw", is_centroid.alias("centroid"),
                         (2 * F.col("weight") >= F.col("all")).alias("on_path"), (is_centroid | under).alias("below"),
                         F.when(under, F.col("child")).otherwise(F.col("top_conv")).alias("next_conv"),
                         F.when(under, F.col("cd") + 1).otherwise(F.col("top_depth")).alias("next_depth"))
        landed = Landed(cut, "trie-round")
        rounds.append(landed)
        left = F.col("weight") - F.when(F.col("on_path"), F.col("cw")).otherwise(0)
        state = landed.df.filter(~F.col("centroid")).select(
            *me, "n_convs", left.alias("weight"), *values, F.col("next_conv").alias("top_conv"), F.col("next_depth").alias("top_depth"))
        single.append(state.filter(alone).select(*me, *values))
        state = state.filter(~alone)
    due = single[0]
    for more in single[1:]:
        due = due.unionByName(more)
    if rounds:
        every = spark.read.schema(rounds[0].df.schema).parquet(*[r.path for r in rounds])
        totals = every.filter("below").groupBy("round", *top).agg(*[F.sum(v).alias(v) for v in values])
        due = due.unionByName(every.filter("on_path").select(*me, "round", *top).join(totals, ["round", *top]).select(*me, *values))
    sums = Landed(due.groupBy(*me).agg(*[F.sum(v).alias(v) for v in values]), "trie-sums")
    for landed in rounds:
        landed.drop()
    return sums.df


def ends_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): digest of the ids that end at each node, ascending, comma-joined."""
    chunks = (ends.groupBy(F.col("node_conv_id").alias("conv_id"), "depth", F.shiftright("conv_id", CHUNK_BITS).alias("chunk"))
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")))
    dealt = chunks.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "chunk")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for conv, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
                if (conv, depth) == node:
                    state.update(b",")
                else:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (conv, depth), hashlib.sha256()
                state.update(ids.encode())
            yield _digest_rows(out)
        if node:
            yield _digest_rows([(*node, state.hexdigest())])

    return dealt.mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)],
                                      ["conv_id", "depth", "ends_sha256"])


def conversation_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node of the trie of ``turns`` (conv_id, d from 1, digest, n_bytes, total) of ``convs`` (conv_id, total).

    conv_id and depth name the node, parent_conv_id its parent (null: root); n_convs conversations start with it;
    n_children; n_leaves childless nodes in its subtree; saved_tokens, over its subtree, bytes of last texts that
    storing each node once saves; ends_sha256, digest of the ids of the conversations that end here.
    """
    nodes, paths, ends = prefix_nodes(turns, convs)
    nodes = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes")})
    sums = subtree_sums(nodes, paths, ["n_leaves", "saved_tokens"])
    found = nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children").join(sums, ["conv_id", "depth"])
    found = found.join(ends_digests(ends), ["conv_id", "depth"], "left")
    return found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
