"""Tables in the folder that all executors share, and which sides of a join are small enough to be sent."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in a session of one machine without it a temporary folder, and on a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="covenant-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """df as a written table. Integers are coded as steps where that is shorter (the second version of the format)."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("parquet.writer.version", "PARQUET_2_0").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A written table, to be sent to the other side of a join if it is counted to have no more than so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
