"""Running sums of groups of any size, and ceilings on them.

A window over a group puts the group in one task. Here a group's rows are cut by ranges of their order, of bounded
size; the sums of the ranges are few, a window over those gives what each range begins with, and a window inside each
range does the rest. So a group that is a third of the table is summed by as many tasks as it has ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Values of the order that a range spans. The order is a whole number, and distinct inside a group up to ``then``.
RANGE = 10_000


def before_each(rows: DataFrame, group: list[str], order: str, then: list[str], sums: dict[str, Column], span: int = RANGE) -> DataFrame:
    """rows with the sum of each of ``sums`` over the rows of their group that come before them, by ``order`` and ``then``."""
    held = rows.withColumns({f"_{k}": v for k, v in sums.items()}).withColumn("_range", F.floor(F.col(order) / span))
    of_range = held.groupBy(*group, "_range").agg(*(F.sum(f"_{k}").alias(f"_all_{k}") for k in sums))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = of_range.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_range").alias("_r"), *(F.coalesce(F.sum(f"_all_{k}").over(earlier), F.lit(0)).alias(f"_begin_{k}") for k in sums))
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*group, "_range").orderBy(order, *then).rowsBetween(Window.unboundedPreceding, -1)
    summed = held.join(begins, same).withColumns({k: F.col(f"_begin_{k}") + F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0)) for k in sums})
    return summed.select(*rows.columns, *sums)


def within_budget(calls: DataFrame, group: list[str], order: str, then: list[str], cost: str, large: str, most_calls: int | None = None, most_cost: float | None = None, most_large: int | None = None, span: int = RANGE) -> DataFrame:
    """Calls of each group in order, with ``passes``: whether one may be made under ceilings on calls, cost and large calls.

    Whether a call passes depends on which before it did, but that comes down to sums. Of the large calls the first
    ``most_large`` are eligible, as no other ceiling lets a later one take an earlier one's place: calls and cost never
    go down, so once one of these two is reached nothing passes any more. Up to there every eligible call has
    passed, so sums over eligible calls are what was made and spent. A cost that isn't known is none.
    """
    ordinal = before_each(calls, group, order, then, {"_larges": F.col(large).cast("long")}, span)
    eligible = ~F.col(large) | (F.col("_larges") < most_large if most_large is not None else F.lit(True))
    told = ordinal.withColumn("_eligible", eligible).drop("_larges")
    spent = before_each(told, group, order, then, {"calls_before": F.col("_eligible").cast("long"), "cost_before": F.when(F.col("_eligible"), F.coalesce(F.col(cost), F.lit(0))).otherwise(0)}, span)
    passes = F.col("_eligible")
    if most_calls is not None:
        passes = passes & (F.col("calls_before") < most_calls)
    if most_cost is not None:
        passes = passes & (F.col("cost_before") < most_cost)
    return spent.withColumn("passes", passes).drop("_eligible")
