"""Incremental runs: watermarks, replay control and a stream that gives what one run over all would.

A run reads what arrived since the last successful one, keeps the first of each key, skips what it has
handled under the same rules, and appends. As a stream, each micro-batch is one such run; the checkpoint
holds what has been read, and the key of a batch makes its writing idempotent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from covenant.operators.relational import first_by


def since(arrivals: DataFrame, time: str, watermark: DataFrame | None) -> DataFrame:
    """Arrivals after a one-row watermark (``mark``); all of them before the first run."""
    if watermark is None:
        return arrivals
    return arrivals.join(F.broadcast(watermark.select("mark")), F.col("mark").isNull() | (F.col(time) > F.col("mark"))).drop("mark")


def unhandled(arrivals: DataFrame, handled: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Arrivals that no run has handled with this version of the rules."""
    return arrivals.join(handled.where(F.col("rule_version") == version).select(*keys), keys, "left_anti")


def advanced(previous: DataFrame, batch: DataFrame, time: str, failed: DataFrame) -> DataFrame:
    """The next watermark: that of the batch if nothing failed, else the previous one."""
    new = batch.agg(F.max(time).alias("new"))
    errors = failed.agg(F.count("*").alias("errors"))
    return previous.crossJoin(new).crossJoin(errors).select(F.when((F.col("errors") == 0) & F.col("new").isNotNull(), F.greatest("mark", "new")).otherwise(F.col("mark")).alias("mark"))


def isolated(rows: DataFrame, problem: Column | None) -> tuple[DataFrame, DataFrame]:
    """Rows that can be processed and those that can't, with why."""
    checked = rows.withColumn("error", problem if problem is not None else F.lit(None).cast("string"))
    return checked.where("error is null").drop("error"), checked.where("error is not null")


def one_run(arrivals: DataFrame, store: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The store after a run: what it had, and the first arrival of each key it didn't have."""
    new = first_by(arrivals, keys, *(F.asc(c) for c in order)).join(store.select(*keys), keys, "left_anti")
    return store.unionByName(new.select(*store.columns))


def start(source: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], process: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Run over all that has arrived, micro-batch by micro-batch, and stop. ``path`` is the store, one folder a batch."""

    def batch(arrivals: DataFrame, number: int) -> None:
        spark = arrivals.sparkSession
        rows = first_by(arrivals, keys, *(F.asc(c) for c in order))
        rows = process(rows) if process else rows
        # a batch that is run again sees the store without its own folder
        earlier = [f"{path}/batch={i}" for i in range(number)]
        earlier = [p for p in earlier if _exists(spark, p)]
        if earlier:
            rows = rows.join(spark.read.parquet(*earlier).select(*keys), keys, "left_anti")
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
