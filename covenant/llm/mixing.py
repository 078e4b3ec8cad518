"""Mixing sources to target weights, in DataFrame operations alone.

Each source's target is its share by weight of all words, held to a number of times its own size;
the excess goes to the others by weight until none is above. Sources are cut into blocks by a hash of
doc_id, blocks are permuted, and a source's draw is a run of that permutation, passed over as often
as needed: its quota is a number of tickets, one for each block drawn, the last of which may be cut. Of
the block that is cut, documents are taken in random order while they fit in what is left, those that
don't being passed over, in ``ROUNDS`` rounds.

A splitting tree deals the tickets of all sources to output shards. At each node the tickets in it are
put in seeded random order and the first half of them goes left: how many of each source go left is
then a multivariate hypergeometric draw, and the node's quota vector is split exactly. A leaf's quotas
take disjoint runs of each source's permuted blocks, and the documents of a leaf are put in random
order there. What the mix takes of a document is what the tree drew: its copies are counted from those draws.
The tree's root holds a ticket for each block drawn, three for 100,000 documents at most, and no document.

Defined results: a null source is one of its own, after all others; a null text has size 0; documents
of size 0 come as often as others in their block; rows repeated are drawn together; an empty
table, or one without words, has targets of 0 and takes nothing; columns that clash with those added
are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covenant.llm.shared import few, materialized

SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 4
ADDED = ["size", "source_size", "target", "copies", "taken", "shards"]
_OWN = ["_key", "_block", "_h", "_blocks", "_cut_block", "_cuts", "_gaps", "_whole", "_shards", "_pass", "_place", "mix_shard"]


def _key(source: str = "source") -> Column:
    """A source as a key without null."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit(""))


def _order(*cols: Column | str) -> Column:
    return F.md5(F.concat_ws("/", F.lit(SEED), *cols))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_times: int = 3) -> DataFrame:
    """(source_key, source, words) to these and target, a double.

    With sources in order of what they can give for a unit of weight, those before some place are
    held to their limit and the others share the rest by weight: running sums find that place.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = sizes.select("*", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1)).alias("w"))
    everything = Window.partitionBy(F.lit(1))
    before = Window.orderBy(F.col("words") / F.col("w"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    s = w.select(
        "*",
        F.sum("words").over(everything).alias("all_words"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("rest_w"),
        (F.coalesce(F.sum("words").over(before), F.lit(0)) * most_times).alias("held"),
    )
    # with the sources before this one held to their limit, what a unit of weight gets of the rest
    level = (F.col("all_words") - F.col("held")).cast("double") / F.col("rest_w")
    s = s.select("*", F.when(level * F.col("w") <= F.col("words") * most_times, level).alias("level"))
    shared = F.col("w") * F.max("level").over(everything)
    limit = (F.col("words") * most_times).cast("double")
    return s.select("source_key", "words", F.coalesce(F.least(shared, limit), limit).alias("target"))


def _block(blocks: Column) -> Column:
    """The block of a row: blocks are equal ranges of its hash, so their order permutes the documents."""
    return F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * blocks / F.lit(1 << 32)).cast("long")


def splitting_tree(tickets: DataFrame, depth: int) -> DataFrame:
    """(source_key, pass, block) of every draw to these and shard, one of 2 ** depth.

    Random halves at each node split its quotas of all sources hypergeometrically; a shard's quota of
    a source then takes a run of the source's blocks in their permuted order.
    """
    nodes = tickets.select("source_key", F.row_number().over(Window.partitionBy("source_key").orderBy("pass", "block")).alias("ticket"), F.lit(0).alias("node"))
    for level in range(depth):
        here = Window.partitionBy("node")
        rank = F.row_number().over(here.orderBy(_order(F.lit(level), "source_key", F.col("ticket").cast("string")), "source_key", "ticket"))
        right = (rank * 2 > F.count("*").over(here) + F.col("node") % 2).cast("int")
        nodes = nodes.select("source_key", "ticket", (F.col("node") * 2 + right).alias("node"))
    by_leaf = Window.partitionBy("source_key").orderBy("node", "ticket")
    quotas = nodes.select("source_key", F.row_number().over(by_leaf).alias("draw"), F.col("node").alias("shard"))
    in_order = Window.partitionBy("source_key").orderBy("pass", "block")
    return tickets.select("source_key", "pass", "block", F.row_number().over(in_order).alias("draw")).join(quotas, ["source_key", "draw"]).drop("draw")


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_times: int = 3, block_rows: int = 100_000, usual_blocks: int = 16, usual_rows: int = 64, depth: int = 4
) -> DataFrame:
    """One row per row of docs with size, source_size, target, copies, taken and shards added.

    ``shards`` are the output shards of the draws of a document, ``copies`` how many those are, and ``taken``
    its words times that. A block has at most about ``block_rows`` documents; a source has
    ``usual_blocks`` at least, unless they would have fewer than ``usual_rows`` documents each. Nothing
    but block totals and the documents of one block for each source is shuffled; the documents themselves
    are only read.
    """
    docs = docs.drop(*ADDED, *_OWN)
    rows = docs.select(
        "*", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _key().alias("_key"), _order(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("_h"),
    )
    counted = materialized(docs.groupBy(_key().alias("_key")).agg(F.count("*").alias("n")), "mix-sources")
    blocks = few(counted.select("_key", F.greatest(F.ceil(F.col("n") / block_rows), F.least(F.lit(usual_blocks), F.ceil(F.col("n") / usual_rows))).cast("long").alias("_blocks")))
    blocked = rows.join(blocks, "_key").withColumn("_block", _block(F.col("_blocks")))
    totals = materialized(blocked.groupBy("_key", "_block").agg(F.min("source").alias("source"), F.sum("size").alias("words")), "mix-blocks")
    goals = targets(totals.groupBy(F.col("_key").alias("source_key"), "source").agg(F.sum("words").alias("words")), weights, most_times)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most_times))).otherwise(0)
    goals = goals.select(F.col("source_key").alias("_key"), F.col("words").alias("source_size"), "target").withColumn("_whole", whole.cast("int"))
    left = F.col("target") - F.col("_whole") * F.col("source_size")
    end = F.sum("words").over(Window.partitionBy("_key").orderBy("_block"))
    plan = materialized(totals.join(goals, "_key").select("_key", "_block", "words", "source_size", "target", "_whole", left.alias("left"), (end - F.col("words")).alias("begin")), "mix-plan")
    # the block in which a source's last pass ends, and which of its documents still fit: round by round, those
    # after the last one taken, no larger than what is left, as far as their sum isn't either
    ends_in = plan.where("left > 0 and begin <= left and left < begin + words")
    inside = blocked.select("_key", "_block", "_h", "size").join(few(ends_in.select("_key", "_block", (F.col("left") - F.col("begin")).alias("g0"))), ["_key", "_block"])
    in_source = Window.partitionBy("_key")
    inside = inside.withColumn("c0", F.lit(""))
    for k in range(ROUNDS):
        fits = (F.col("_h") > F.col(f"c{k}")) & (F.col("size") <= F.col(f"g{k}"))
        so_far = F.sum(F.when(fits, F.col("size")).otherwise(0)).over(in_source.orderBy("_h"))
        inside = inside.withColumn("taken", fits & (so_far <= F.col(f"g{k}")))
        gone = F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).over(in_source)
        last = F.max(F.when(F.col("taken"), F.col("_h")).otherwise(F.col(f"c{k}"))).over(in_source)
        inside = inside.withColumn(f"c{k + 1}", last).withColumn(f"g{k + 1}", F.col(f"g{k}") - gone)
    cuts = F.first(F.array(*(f"c{k}" for k in range(ROUNDS + 1)))).alias("_cuts")
    cut_h = inside.groupBy("_key").agg(cuts, F.first(F.array(*(f"g{k}" for k in range(ROUNDS)))).alias("_gaps"))
    drawn = F.array_compact(F.array(F.when(F.col("_whole") > 0, 0), F.when(F.col("_whole") > 1, 1), F.when(F.col("_whole") > 2, 2), F.when((F.col("left") > 0) & (F.col("begin") <= F.col("left")), F.col("_whole"))))
    if most_times > 3:
        drawn = F.sequence(F.lit(0), F.col("_whole") - F.when((F.col("left") > 0) & (F.col("begin") <= F.col("left")), 0).otherwise(1))
    tickets = materialized(plan.select(F.col("_key").alias("source_key"), F.explode(drawn).alias("pass"), F.col("_block").alias("block")), "mix-tickets")
    shards = (
        splitting_tree(tickets, depth).groupBy(F.col("source_key").alias("_key"), F.col("block").alias("_block"))
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("_shards"))
    )
    by_source = goals.join(ends_in.select("_key", F.col("_block").alias("_cut_block")), "_key", "left").join(cut_h, "_key", "left")
    by_source = materialized(by_source.join(counted, "_key", "left").drop("n"), "mix-goals")
    out = blocked.drop("_blocks").join(few(by_source), "_key").join(few(materialized(shards, "mix-shards")), ["_key", "_block"], "left")
    fit = F.lit(False)
    for k in range(ROUNDS):
        fit |= (F.col("_h") > F.col("_cuts")[k]) & (F.col("_h") <= F.col("_cuts")[k + 1]) & (F.col("size") <= F.col("_gaps")[k])
    cut = (F.col("_block") < F.col("_cut_block")) | ((F.col("_block") == F.col("_cut_block")) & fit)
    # the tree's draws of the block, of which a document that doesn't fit in what the last pass has left misses the last
    passes = F.col("_whole") + F.coalesce(cut, F.lit(False)).cast("int")
    drawn = out.withColumn("shards", F.slice(F.coalesce("_shards", F.array().cast("array<int>")), F.lit(1), passes))
    copies = F.size("shards")
    return drawn.select(*docs.columns, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "shards")


def mixed_documents(docs: DataFrame, task_bytes: int = 64 << 20, **options) -> DataFrame:
    """The mix itself: each document as often as it is drawn, with its shard, in random order in a shard.

    A shard is put in order in ranges of its random places, and there are so many tasks that each has
    about ``task_bytes`` of texts.
    """
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // task_bytes)
    mix = mix_sources(docs, **options).select(*[c for c in docs.columns if c not in (*ADDED, *_OWN)], F.posexplode("shards").alias("_pass", "mix_shard"))
    place = _order(F.lit("place"), F.col("mix_shard").cast("string"), F.col("_pass").cast("string"), F.col("doc_id").cast("string"))
    placed = mix.withColumn("_place", place).repartition(tasks, "mix_shard", F.substring("_place", 1, 4))
    return placed.sortWithinPartitions("mix_shard", "_place").drop("_pass", "_place")
