"""Relational operators shared by the queries: pages, latest rows, set differences, running sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def where_all(df: DataFrame, *predicates: Column | None) -> DataFrame:
    """Rows that satisfy all predicates; those that are None aren't asked for."""
    return reduce(lambda d, p: d if p is None else d.where(p), predicates, df)


def page(df: DataFrame, sort: str, descending: bool, key: str, allowed: tuple[str, ...], offset: int, limit: int) -> DataFrame:
    """A page of rows by one of the allowed columns, nulls last, ties by key."""
    if sort not in allowed:
        raise ValueError(f"can't sort by {sort}")
    by = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return df.orderBy(by, F.col(key)).offset(offset).limit(limit)


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order; the order has to be total for a defined result."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time, if there is one.

    Both sides are put in one order by key and time and the last right row is carried forward, so
    nothing but the keys' own rows meet; the right side's rows win at equal times.
    """
    values = [c for c in right.columns if c not in (key, right_time)]
    marked = left.select(F.col(key).alias("_key"), F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(_struct(right, [right_time, *values])).alias("_right"))
    other = right.select(F.col(key).alias("_key"), F.col(right_time).alias("_time"), F.lit(0).alias("_side"), F.lit(None).cast(_struct(left, left.columns)).alias("_left"), F.struct(right_time, *values).alias("_right"))
    w = Window.partitionBy("_key").orderBy("_time", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = marked.unionByName(other).withColumn("_last", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    return carried.select("_left.*", *(F.col("_last")[c].alias(c) for c in [right_time, *values]))


def _struct(df: DataFrame, columns: list[str]) -> str:
    return df.select(F.struct(*columns).alias("s")).schema["s"].dataType.simpleString()


def running_sum(df: DataFrame, amount: str, keys: list[str], *order: Column | str) -> Column:
    return F.sum(amount).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def waterfall(layers: DataFrame, value: Column) -> DataFrame:
    """Layers (issuer_id, rank_order, amount) with what a value covers and pays of each, senior first."""
    total = running_sum(layers, "amount", ["issuer_id"], "rank_order")
    out = layers.withColumn("value", value).withColumn("cumulative", total.cast("decimal(20,4)"))
    before = (F.col("cumulative") - F.col("amount")).cast("decimal(20,4)")
    paid = F.greatest(F.lit(0).cast("decimal(20,4)"), F.least(F.col("amount"), (F.col("value") - before).cast("decimal(20,4)")))
    return out.select(
        "*",
        F.coalesce(F.round(F.try_divide("value", "cumulative"), 2), F.lit(0)).cast("decimal(18,2)").alias("coverage"),
        F.coalesce(F.round(F.try_divide(paid * 100, F.col("amount")), 2), F.lit(0)).cast("decimal(18,2)").alias("recovery"),
    )


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows and those incoming whose key isn't there, with whether they were created."""
    new = incoming.join(existing.select(*keys), keys, "left_anti")
    return existing.withColumn("created", F.lit(False)).unionByName(new.withColumn("created", F.lit(True)))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], keep: tuple[str, ...] = (), only_if: Column | None = None) -> DataFrame:
    """Existing rows overwritten by incoming ones of the same key, and incoming ones that are new.

    ``keep`` columns stay as they are in existing rows; ``only_if`` is a condition on the columns of
    the old and the new row, ``o.x`` and ``n.x``, for overwriting.
    """
    o, n = existing.alias("o"), incoming.alias("n")
    joined = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    there, comes = F.col(f"o.{keys[0]}").isNotNull(), F.col(f"n.{keys[0]}").isNotNull()
    takes = comes & (~there | (only_if if only_if is not None else F.lit(True)))
    cols = [
        F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) if c in keys
        else F.when(there & (F.lit(c in keep) | ~F.coalesce(takes, F.lit(False))), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
        for c in existing.columns
    ]
    return joined.select(*cols)


def patched(existing: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows with the values that changes give and that aren't null."""
    rest = [c for c in existing.columns if c not in keys]
    c = changes.select(*keys, *(F.col(x).alias(f"_{x}") for x in rest if x in changes.columns))
    return existing.join(c, keys, "left").select(*keys, *(F.coalesce(f"_{x}", x).alias(x) if x in changes.columns else x for x in rest))


def membership_actions(expected: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """What makes current memberships (keys, rank, by_hand) those expected (keys, rank): one action a key."""
    e = expected.select(*keys, F.col("rank").alias("expected_rank"))
    c = current.select(*keys, F.col("rank").alias("current_rank"), "by_hand")
    action = (
        F.when(F.col("by_hand"), "keep").when(F.col("current_rank").isNull(), "add").when(F.col("expected_rank").isNull(), "remove")
        .when(F.col("expected_rank") > F.col("current_rank"), "upgrade").when(F.col("expected_rank") < F.col("current_rank"), "downgrade").otherwise("keep")
    )
    return e.join(c, keys, "full_outer").withColumn("action", action)
