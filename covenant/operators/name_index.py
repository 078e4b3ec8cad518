"""Names by trigrams and by prefix: two sorted tables, and a search in tiers that reads only what a name has in common.

The trigram table has a row for each trigram, kind and block of ids: the ids whose name has it, each with the number
of trigrams of its name. A name of a trigrams that shares c with a search of b has similarity c / (a + b - c), so
counting ids in the rows of the search's trigrams gives the similarity of every name that has one, and no name is read.
More than t is c > t (a + b) / (1 + t), the count filter; as c is at most b, names of b / t trigrams or more, and as c is at
most a, those of t b or fewer, are left out before they are counted. The prefix table is sorted by lower-cased name.

Defined results: a null name is in neither table; a name without letters or digits has no trigram; rows repeated with
one kind and id count as one name of their trigrams together, and once in the prefix table for each name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covenant.functions.text import trigrams
from covenant.operators.storage import few, shared_table

#: Ids in a block.
BLOCK = 65536
#: Names more alike than this are found.
LEAST = 0.3


@dataclass(frozen=True)
class Names:
    """The two tables; without ``by_trigram``, ``by_name`` is the rows themselves, which each search goes through."""

    by_trigram: DataFrame | None
    by_name: DataFrame


def scanned(names: DataFrame) -> Names:
    """Names (kind, id, name) for a few searches, of which each reads all names once; nothing is shuffled or written but what they find.
    Rows repeated with one kind and id are names of their own, of which the most alike counts."""
    return Names(None, names.where("name IS NOT NULL").select("kind", F.lower("name").alias("lower"), "id", "name").distinct())


def build(names: DataFrame) -> Names:
    """The two tables of names (kind, id, name)."""
    named = names.where("name IS NOT NULL").select("kind", "id", "name")
    each = named.select("kind", "id", F.explode(trigrams(F.col("name"))).alias("trigram")).distinct()
    sized = each.withColumn("size", F.count("*").over(Window.partitionBy("kind", "id")).cast("int"))
    keys = ["trigram", "kind", "block"]
    blocks = sized.withColumn("block", F.floor(F.col("id") / BLOCK).cast("long")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((F.col("id") - F.col("block") * BLOCK).cast("int").alias("step"), "size"))).alias("ids"))
    lower = named.select("kind", F.lower("name").alias("lower"), "id", "name").distinct()
    return Names(
        shared_table(blocks.repartitionByRange(*keys).sortWithinPartitions(*keys), "trigrams"),
        shared_table(lower.repartitionByRange("kind", "lower", "id").sortWithinPartitions("kind", "lower", "id"), "names"),
    )


def alike(names: Names, q: str, least: float = LEAST) -> DataFrame:
    """(kind, id, similarity) of names more alike to q than ``least``."""
    spark = names.by_name.sparkSession
    asked = [r.t for r in spark.createDataFrame([(q,)], "q string").select(F.explode(trigrams(F.col("q"))).alias("t")).collect()]
    b = len(asked)
    if names.by_trigram is None:
        # each distinct name is taken apart once; generated columns keep that after the names are made distinct
        parts = F.array(F.lit(None).cast("string")) if not asked else F.array(*map(F.lit, asked))
        of = F.transform(F.array(trigrams(F.col("lower"))), lambda t: F.struct(F.size(F.array_intersect(t, parts)).alias("shared"), F.size(t).alias("size")))
        counted = names.by_name.select("lower").distinct().select("lower", F.inline(of))
        near = counted.where((F.col("shared") > 0) & (F.col("shared") * (1 + least) > least * (F.col("size") + b)))
        near = few(shared_table(near.select("lower", (F.col("shared") / (F.col("size") + b - F.col("shared"))).alias("similarity")), "names-alike"))
        return names.by_name.join(near, "lower").groupBy("kind", "id").agg(F.max("similarity").alias("similarity"))
    ids = names.by_trigram.where(F.col("trigram").isin(*asked)).select("kind", "block", F.inline("ids"))
    # no name of other sizes can share enough
    sized = ids.where((F.col("size") > least * b) & (F.col("size") * least < b))
    counted = sized.groupBy("kind", (F.col("block") * BLOCK + F.col("step")).alias("id"), "size").agg(F.count("*").alias("shared"))
    enough = counted.where(F.col("shared") * (1 + least) > least * (F.col("size") + b))
    return enough.select("kind", "id", (F.col("shared") / (F.col("size") + b - F.col("shared"))).alias("similarity"))


def beginning(names: Names, q: str) -> DataFrame:
    """(kind, id, lower) of names that begin with q in any case."""
    return names.by_name.where(F.startswith("lower", F.lit(q.lower()))).select("kind", "id", "lower")


def exactly(names: Names, q: str) -> DataFrame:
    """(kind, id) of names that are q in any case."""
    return names.by_name.where(F.col("lower") == q.lower()).select("kind", "id")


def tiers(names: Names, found: DataFrame, q: str, limit: int, kinds: list[str]) -> DataFrame:
    """(kind, id, tier, rank), ``limit`` of each kind: names that begin with q (tier 3, by name), then what full text found
    (tier 2: kind, id, rank, at least twice ``limit`` of each kind where there are), then names alike (tier 1)."""
    of = lambda df: df.where(F.col("kind").isin(*kinds))
    none = F.lit(None).cast("string")
    every = (
        of(beginning(names, q)).select("kind", "id", F.lit(3).alias("tier"), F.lit(2.0).alias("rank"), "lower")
        .unionByName(of(found).select("kind", "id", F.lit(2).alias("tier"), "rank", none.alias("lower")))
        .unionByName(of(alike(names, q)).select("kind", "id", F.lit(1).alias("tier"), F.col("similarity").alias("rank"), none.alias("lower")))
    )
    best = every.groupBy("kind", "id").agg(F.max_by(F.struct("tier", "rank", "lower"), F.struct("tier", "rank")).alias("x")).select("kind", "id", "x.*")
    n = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("tier"), F.desc("rank"), "lower", "id"))
    return best.withColumn("n", n).where(F.col("n") <= limit).select("kind", "id", "tier", "rank")
