"""Sharding by balanced label propagation.

Linked documents start in the shard of their id hash. In each round every one
counts its neighbours' shards (a join and a count) and asks to move to the
shard that most of them are in; in odd rounds the followers (documents with a
neighbour of smaller id) may move, in even rounds the others, so that two
neighbours do not change places. A shard admits movers up to its free room:
those of largest gain first, then those of small groups, the marginal groups by
a hash draw for the whole group. Each round is a written table of the linked
documents.

A group of at least a shard's room is cut by rank before that: each full piece
has a shard of its own, where no other group starts, and what is left of the
group is a smaller star with its own leader. So it touches as few shards as its
size allows, and the shards that others ask for are not full of it. An id that stands
on several texts belongs to one large group; the links of documents whose shard is
settled so no longer vote.

The law is ``rows``: shard sizes differ by one row at most. Documents without
links, and the few a full shard can't hold, are dealt out to the rest of the
places, by rank. Ranks come from counts of hash buckets and row numbers within
a bucket, so no task holds a shard.

Defined results: repeated rows are rows of their own, linked like any other
equal texts; a null text has no bytes and equals the empty text; a null id has
no links; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import Landed

SHARDS = 8
ROUNDS = 6
BUCKET_ROWS = 20_000


def _draw(*cols):
    """A number in [0, 1) fixed by the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def cut_stars(edges: DataFrame, room: int, shards: int = SHARDS) -> tuple[DataFrame | None, DataFrame, int]:
    """Full pieces (id, shard) of the stars ``edges`` with ``room`` documents or more, the other links, and how many
    shards the pieces fill (the first ones). An id of several such stars belongs to that of the smallest leader."""
    # at most total / room groups have that size, so they are a bounded list
    large = [r["b"] for r in edges.groupBy("b").count().filter(F.col("count") + 1 >= room).collect()]
    if not large:
        return None, edges, 0
    followers = edges.filter(F.col("b").isin(large)).select(F.col("a").alias("id"), F.col("b").alias("hub"))
    leaders = edges.sparkSession.createDataFrame([(h, h) for h in large], followers.schema)
    members = Landed(followers.unionByName(leaders).groupBy("id").agg(F.min("hub").alias("hub")), "shard-members")
    counts = members.df.groupBy("hub").count().collect()
    sizes = {r["hub"]: r["count"] for r in sorted(counts, key=lambda r: (-r["count"], r["hub"]))}
    pieces = ranked(members.df, "hub", ["id"], sum(sizes.values()))
    pieces = pieces.withColumn("piece", F.floor(F.col("rank") / room).cast("int"))
    shard, taken = F.lit(None).cast("int"), 0
    for hub, size in sizes.items():
        full = min(size // room, shards - taken)
        shard = F.when((F.col("hub") == hub) & (F.col("piece") < full), F.col("piece") + taken).otherwise(shard)
        taken += full
    pieces = Landed(pieces.select("id", "hub", "piece", shard.alias("shard")), "shard-pieces").df
    members.drop()
    left, whole = pieces.filter(F.col("shard").isNull()), pieces.filter(F.col("shard").isNotNull()).select("id", "shard")
    least = left.groupBy("hub", "piece").agg(F.min("id").alias("b"))
    stars = left.join(F.broadcast(least), ["hub", "piece"]).filter("id > b").select(F.col("id").alias("a"), "b")
    others = edges.filter(~F.col("b").isin(large)).select("a", "b").unionByName(stars)
    # documents of full pieces have their shard
    placed = whole.select("id")
    others = (others.join(placed.withColumnRenamed("id", "a"), "a", "left_anti")
              .join(placed.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b"))
    return whole, others, taken


def propagate(edges: DataFrame, room: int, shards: int = SHARDS, rounds: int = ROUNDS, taken: int = 0) -> Landed:
    """(id, shard) of every end of ``edges`` (columns a, b; links count both ways).

    ``room`` is the number of documents that a shard may hold; the first ``taken`` shards are full.
    """
    both = Landed(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "shard-edges")
    nodes = both.df.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least"))
    nodes = Landed(nodes.select("id", (F.col("least") < F.col("id")).alias("follower"), F.least("id", "least").alias("unit")),
                   "shard-nodes")
    sizes = nodes.df.groupBy("unit").agg(F.floor(F.log2(F.count(F.lit(1)))).cast("int").alias("class"))
    start = F.pmod(F.xxhash64("id"), F.lit(shards - taken)).cast("int") + taken
    now = Landed(nodes.df.join(sizes, "unit").select("id", "follower", "unit", "class", start.alias("shard")), "shard-labels")
    nodes.drop()
    for turn in range(1, rounds + 1):
        votes = (both.df.join(now.df.select(F.col("id").alias("b"), "shard"), "b")
                 .groupBy(F.col("a").alias("id"), F.col("shard").alias("to")).agg(F.count(F.lit(1)).alias("n")))
        wish = votes.groupBy("id").agg(F.max_by("to", F.struct("n", -F.col("to"))).alias("to"), F.max("n").alias("n"))
        own = votes.select("id", F.col("to").alias("shard"), F.col("n").alias("here"))
        asks = (now.df.join(wish, "id").join(own, ["id", "shard"], "left")
                .withColumn("gain", F.col("n") - F.coalesce("here", F.lit(0)))
                .withColumn("asks", (F.col("to") != F.col("shard")) & (F.col("gain") > 0)
                            & (F.col("follower") == F.lit(turn % 2 == 1))))
        asked = Landed(asks.select("id", "follower", "unit", "class", "shard", "to", "gain", "asks"), "shard-asks")
        now.drop()
        # one row per shard, gain class and group size class (powers of two), so a bounded table decides who is admitted
        level = F.floor(F.log2(F.col("gain"))).cast("int")
        held = {r["shard"]: r["count"] for r in asked.df.groupBy("shard").count().collect()}
        want = asked.df.filter("asks").groupBy("to", level.alias("level"), "class").count().collect()
        admit, free = {}, {s: max(0, room - held.get(s, 0)) for s in range(shards)}
        for r in sorted(want, key=lambda r: (r["to"], -r["level"], r["class"])):
            admit[r["to"], r["level"], r["class"]] = min(1.0, free[r["to"]] / r["count"])
            free[r["to"]] = max(0, free[r["to"]] - r["count"])
        share = F.lit(0.0)
        for to in sorted({k[0] for k in admit}):
            part = F.lit(0.0)
            for (_, lev, size), p in [(k, p) for k, p in admit.items() if k[0] == to and p]:
                part = F.when((level == lev) & (F.col("class") == size), F.lit(p)).otherwise(part)
            share = F.when(F.col("to") == to, part).otherwise(share)
        # the members of a group draw alike, so that it is admitted whole
        moves = F.col("asks") & (_draw("unit", F.lit(turn)) < share)
        now = Landed(asked.df.select("id", "follower", "unit", "class", F.when(moves, F.col("to")).otherwise(F.col("shard")).alias("shard")),
                     "shard-labels")
        asked.drop()
        if turn > 1 and not want:
            break
    both.drop()
    return now


def ranked(rows: DataFrame, part: str, order: list[str], total: int) -> DataFrame:
    """``rows`` with their 0-based rank within ``part``, in the order of a hash of ``order``."""
    buckets = 1 << max(3, (total // BUCKET_ROWS).bit_length())
    rows = rows.withColumn("h", F.xxhash64(*order)).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    counts = rows.groupBy(part, "bucket").count()
    below = Window.partitionBy(part).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(part, "bucket", F.coalesce(F.sum("count").over(below), F.lit(0)).alias("start"))
    within = Window.partitionBy(part, "bucket").orderBy("h", *order)
    return (rows.withColumn("nth", F.row_number().over(within)).join(starts, [part, "bucket"])
            .withColumn("rank", F.col("start") + F.col("nth") - 1).drop("h", "bucket", "nth", "start"))


def equal_text_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (a, b) from each document to the smallest id with the same text (a star, not all pairs)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("a"), F.octet_length(text).alias("n"), F.xxhash64(text).alias("h"))
    first = rows.groupBy("n", "h").agg(F.min("a").alias("b"), F.max("a").alias("last")).filter("b < last")
    return rows.join(first, ["n", "h"]).filter("a > b").select("a", "b").distinct()


def balanced_shards(docs: DataFrame, edges: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shards: int = SHARDS) -> DataFrame:
    """One row per document row: id, size, text_crc32, shard and slot under the law ``rows``.

    ``edges`` are stars (from ``a`` to the smallest id ``b`` of its group), as ``equal_text_links`` makes them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("th"))
    rows = Landed(rows, "shard-rows").df
    total = rows.count()
    room = max(1, total // shards)
    whole, links, taken = cut_stars(edges, room, shards)
    labels = whole
    if taken < shards:
        spread = propagate(links, room, shards, taken=taken).df.select("id", "shard")
        labels = spread if whole is None else whole.unionByName(spread)
    placed = rows.join(labels, "id", "left")
    # part `shards` is the pool of rows without links
    placed = placed.withColumn("part", F.coalesce("shard", F.lit(shards)))
    placed = Landed(ranked(placed.drop("shard"), "part", ["id", "th"], total), "shard-ranks").df
    held = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
    places = [total // shards + (s < total % shards) for s in range(shards)]
    kept = [min(held.get(s, 0), places[s]) for s in range(shards)]
    # rows past a shard's places join the end of the pool; pool[s] is where shard s's share of it begins
    spill, at = [], held.get(shards, 0)
    for s in range(shards):
        spill.append(at)
        at += held.get(s, 0) - kept[s]
    pool, at = [], 0
    for s in range(shards):
        pool.append(at)
        at += places[s] - kept[s]
    fill = F.when(F.col("part") == shards, F.col("rank"))
    for s in range(shards):
        fill = fill.when((F.col("part") == s) & (F.col("rank") >= kept[s]), F.col("rank") - kept[s] + spill[s])
    placed = placed.withColumn("fill", fill)
    shard, slot = F.col("part"), F.col("rank")
    for s in range(shards):
        here = F.col("fill").between(pool[s], pool[s] + places[s] - kept[s] - 1)
        shard, slot = F.when(here, F.lit(s)).otherwise(shard), F.when(here, F.col("fill") - pool[s] + kept[s]).otherwise(slot)
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", shard.cast("int").alias("shard"),
                         slot.cast("long").alias("slot"))
