"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into buckets that fit in a task's memory, by a seeded hash of
doc_id and text checksum. Pass two loads each bucket, puts it in a fixed order, and permutes it with a
seeded Fisher-Yates shuffle. A record's rank over all buckets is its bucket's offset plus its place;
records go to shards in turn by rank, so the counts of any two shards are at most one apart and any
run of records with one key, source or text is spread evenly.

Defined results: a null text has no bytes and checksum 0; a null doc_id is scattered by its checksum;
rows repeated share a bucket and get places of their own; an empty table gives an empty one; columns
that clash with those added are replaced by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SEED = 20240229
ADDED = ["size", "text_crc32", "shard", "slot"]


def _fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A permutation of n by swapping each place, from the last, with one at or before it."""
    order = np.arange(n)
    picks = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    places = order.tolist()
    for i in range(n - 1, 0, -1):
        j = picks[i]
        places[i], places[j] = places[j], places[i]
    return np.asarray(places, np.int64)


def shuffle_into_shards(docs: DataFrame, n_shards: int = 24, seed: int = SEED, bucket_bytes: int = 8 << 20, least_buckets: int = 48) -> DataFrame:
    """docs with size, text_crc32, shard and slot added: shards of equal counts in random order.

    ``bucket_bytes`` is how much of the records one task shuffles in memory; the number of buckets
    follows from the bytes of the whole table, and eight of them or so go to a task.
    """
    docs = docs.drop(*ADDED, "_bucket", "_offset")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long")
    total = docs.agg(F.sum(size).alias("bytes")).first()["bytes"] or 0
    n_buckets = max(least_buckets, -(-total // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "doc_id", crc), F.lit(n_buckets))
    rows = docs.select("*", size.alias("size"), crc.alias("text_crc32"), bucket.alias("_bucket"))
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("n"))
    offsets = counts.select(
        "_bucket", (F.sum("n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("_offset")
    )
    if n_buckets <= 1 << 20:  # sixteen bytes each
        offsets = F.broadcast(offsets)
    schema = T.StructType([*rows.drop("_bucket").schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    names = [f.name for f in schema.fields]

    def shuffled(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(tables))
        if not len(table):
            return
        fixed = pc.sort_indices(table.select(["doc_id", "text_crc32"]), sort_keys=[("doc_id", "ascending"), ("text_crc32", "ascending")]).to_numpy()
        rng = np.random.default_rng([seed, table["_bucket"][0].as_py()])
        place = np.empty(len(table), np.int64)
        place[fixed] = _fisher_yates(len(table), rng)
        rank = place + table["_offset"][0].as_py()
        order = pa.array(np.argsort(place))
        out = table.drop_columns(["_bucket", "_offset"])
        out = out.append_column("shard", pa.array((rank % n_shards).astype(np.int32))).append_column("slot", pa.array(rank // n_shards))
        yield from out.select(names).take(order).combine_chunks().to_batches(max_chunksize=4096)

    def bucketwise(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(shuffled(iter(table.to_batches()))))

    n_tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_buckets // 8)
    return rows.join(offsets, "_bucket").repartition(n_tasks, "_bucket").groupBy("_bucket").applyInArrow(bucketwise, schema)


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the shuffled records to one folder of Parquet files for each shard, in order of slot."""
    sharded = shuffle_into_shards(docs, **options)
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
