"""Memberships and their summaries kept by a feed of changes, without counting again.

A batch of changes is folded onto the members that it touches, in order: an add makes a member, or upgrades one that is there;
a remove takes it away; an upgrade raises the verification of a member and never lowers it. What that changes in the counts of a
collection is added to its summary. Only the members and collections touched are written; the rest of both stores stay as
they are. Changes are dealt by member and sorted, and a task goes through them once with the state of one member, so a member
of any number of changes takes no memory.

Defined results: an upgrade or remove of what isn't a member changes nothing; changes of one ``seq`` go in the order of their action
and rank; a batch that is replayed changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covenant.sources.store import Store

MEMBER = ["collection_id", "issuer_id"]
#: The verification that counts as verified.
VERIFIED = 2


class Memberships:
    """Members (collection_id, issuer_id, rank, present) and summaries (collection_id, members, verified)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.members = Store(spark, f"{path}/members", "collection_id long, issuer_id long, rank int, present boolean", MEMBER)
        self.summaries = Store(spark, f"{path}/summaries", "collection_id long, members long, verified long", ["collection_id"])

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Fold changes (collection_id, issuer_id, seq, action, rank) onto members and summaries."""
        if batch in self.summaries.manifest().batches:
            return
        touched = changes.select(*MEMBER).distinct()
        before = self.members.newest(before=batch).join(touched, MEMBER, "left_semi")
        self.members.append(_folded(before, changes), batch)
        after = self.members.read().where(F.col("_batch") == batch)
        counted = lambda df, sign: df.select("collection_id", (F.col("present").cast("long") * sign).alias("members"), ((F.col("present") & (F.col("rank") >= VERIFIED)).cast("long") * sign).alias("verified"))
        change = counted(after, 1).unionByName(counted(before, -1)).groupBy("collection_id").agg(F.sum("members").alias("dm"), F.sum("verified").alias("dv"))
        had = self.summaries.newest(before=batch).withColumnsRenamed({"members": "m", "verified": "v"})
        now = change.join(had, "collection_id", "left")
        self.summaries.append(now.select("collection_id", (F.coalesce("m", F.lit(0)) + F.col("dm")).alias("members"), (F.coalesce("v", F.lit(0)) + F.col("dv")).alias("verified")), batch)


def _folded(before: DataFrame, changes: DataFrame) -> DataFrame:
    """The members touched as they are after the changes; those that never were members are left out."""
    state = before.where("present").select(*MEMBER, F.lit(-1).cast("long").alias("seq"), F.lit("add").alias("action"), "rank", F.lit(0).alias("nth"))
    rows = state.unionByName(changes.select(*MEMBER, F.col("seq").cast("long").alias("seq"), "action", F.col("rank").cast("int").alias("rank"), F.lit(1).alias("nth")))
    dealt = rows.repartition(*MEMBER).sortWithinPartitions(*MEMBER, "nth", "seq", "action", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rank, ever, out = None, None, False, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.bool_()), strict=True)], [*MEMBER, "rank", "present"])

        def close() -> None:
            if key is not None and ever:
                out.append((*key, rank, rank is not None))

        for b in batches:
            for collection, issuer, action, given in zip(*(b.column(c).to_pylist() for c in (*MEMBER, "action", "rank")), strict=True):
                if (collection, issuer) != key:
                    close()
                    key, rank, ever = (collection, issuer), None, False
                if action == "remove":
                    rank = None
                elif action == "add" or rank is not None:
                    rank, ever = max(given, -1 if rank is None else rank), True
            yield flush()
        close()
        yield flush()

    return dealt.mapInArrow(run, "collection_id long, issuer_id long, rank int, present boolean")


def seeded(existing: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposed collections (slug, name, collection_type) with what comes of each: created, there already, or refused because its slug is another's."""
    first = proposed.groupBy("slug").agg(F.min(F.struct("name", "collection_type")).alias("first"))
    taken = existing.select("slug", F.struct("name", "collection_type").alias("own"))
    both = proposed.join(first, "slug").join(taken, "slug", "left").withColumn("mine", F.struct("name", "collection_type"))
    outcome = F.when(F.col("own").isNull() & (F.col("mine") == F.col("first")), "created").when(F.coalesce("own", "first") == F.col("mine"), "exists").otherwise("refused")
    return both.select("slug", "name", "collection_type", outcome.alias("outcome"))
