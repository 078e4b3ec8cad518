"""A written store: append-only segments under a manifest that is replaced as a whole.

A batch is written to a segment of its own first, and is there once a new manifest names it. Manifests are numbered and
put in place by a rename that fails if the number is taken, so of two writers one wins and the other tries again on
what the first left; a reader sees one manifest or the next, never a part. A batch whose name the manifest has is not
written again, so work that is replayed after a failure changes nothing. What a writer that failed left behind is not
named by any manifest, and ``vacuum`` removes it.

Rows keep the number of their batch (``_batch``), so the store can be read as it was before a batch, which is what
makes a batch that is run again give the same rows, and the newest row of a key wins. Compaction joins segments:
all rows of a log, or the newest row of each key where the store has keys and history isn't asked for.

Defined results: a store that nothing was written to is empty; an empty batch is remembered as done; of the rows of one
key in one batch the largest by ``order`` wins, and of those that are equal in it the largest row.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tries to put a manifest in place before a writer gives up.
TRIES = 20


@dataclass
class Manifest:
    """A version of a store: its segments, and the batches that are in them."""

    version: int = 0
    segments: list[str] = field(default_factory=list)
    batches: list[int] = field(default_factory=list)


class Store:
    """Rows of a schema in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str] | None = None, order: list[str] | None = None) -> None:
        self.spark, self.path, self.keys, self.order = spark, path.rstrip("/"), keys, order or []
        self.schema = schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        root = self._path(self.path)
        self._fs = root.getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests

    def manifest(self) -> Manifest:
        """The newest manifest."""
        folder = self._path(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return Manifest()
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        versions = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")]
        if not versions:
            return Manifest()
        text = self.spark.read.text(f"{self.path}/manifest/{max(versions)}.json", wholetext=True).first().value
        return Manifest(**json.loads(text))

    def _replaced(self, new: Manifest) -> bool:
        """Whether the manifest was put in place as the next version."""
        text = json.dumps(new.__dict__)
        scratch, place = self._path(f"{self.path}/scratch/{uuid.uuid4().hex}"), self._path(f"{self.path}/manifest/{new.version}.json")
        out = self._fs.create(scratch, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(place.getParent())
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = gateway.new_array(rename, 1)
        options[0] = rename.NONE  # fails if the version is there
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(place).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._fs.makeQualified(scratch), self._fs.makeQualified(place), options)
        except Exception as e:  # noqa: BLE001 - py4j wraps the file system's errors
            if self._fs.exists(place):
                return False
            raise e
        return True

    # rows

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/segments/{name}")
        return name

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Add rows as a batch; False, and nothing written, if that batch is there."""
        if batch in self.manifest().batches:
            return False
        named = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields))
        segment = self._write(named.withColumn("_batch", F.lit(batch).cast("long")))
        for _ in range(TRIES):
            now = self.manifest()
            if batch in now.batches:
                return False
            if self._replaced(Manifest(now.version + 1, [*now.segments, segment], [*now.batches, batch])):
                return True
        raise RuntimeError(f"{self.path} is written by too many at once")

    def append_to(self, seen: Manifest, rows: DataFrame, batch: int) -> bool:
        """Add rows as a batch if the store is still as it was seen, on which they are based; False, and nothing added, if it isn't."""
        named = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields))
        segment = self._write(named.withColumn("_batch", F.lit(batch).cast("long")))
        return self._replaced(Manifest(seen.version + 1, [*seen.segments, segment], [*seen.batches, batch]))

    def read(self, before: int | None = None, manifest: Manifest | None = None) -> DataFrame:
        """All rows with their batch, or those of batches before one."""
        now = manifest or self.manifest()
        schema = T.StructType([*self.schema.fields, T.StructField("_batch", T.LongType())])
        if not now.segments:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/segments/{s}" for s in now.segments))
        return rows if before is None else rows.where(F.col("_batch") < before)

    def newest(self, before: int | None = None, manifest: Manifest | None = None) -> DataFrame:
        """The newest row of each key, without its batch."""
        return self._newest(self.read(before, manifest)).drop("_batch")

    def _newest(self, rows: DataFrame) -> DataFrame:
        row = F.struct("_batch", *self.order, *(f.name for f in self.schema.fields if f.name not in self.order))
        return rows.groupBy(*self.keys).agg(F.max(row).alias("_row")).select(*(F.col(f"_row.{f.name}").alias(f.name) for f in self.schema.fields), "_row._batch")

    def compact(self, history: bool = True) -> bool:
        """Join all segments to one, which keeps only the newest row of each key unless history is kept. False if another writer came between."""
        now = self.manifest()
        rows = self.read(manifest=now)
        segment = self._write(rows if history or not self.keys else self._newest(rows))
        return self._replaced(Manifest(now.version + 1, [segment], now.batches))

    def vacuum(self) -> int:
        """Remove segments that the newest manifest doesn't name; how many. Readers of earlier manifests must be done."""
        named, folder = set(self.manifest().segments), self._path(f"{self.path}/segments")
        if not self._fs.exists(folder):
            return 0
        old = [f.getPath() for f in self._fs.listStatus(folder) if f.getPath().getName() not in named]
        return sum(bool(self._fs.delete(p, True)) for p in old)


#: What is known of an entity's attempts at a provider.
ATTEMPT_STATE = "issuer_id long, provider string, status string, last_attempt_at timestamp, last_success_at timestamp, next_retry_at timestamp, attempt_count long, records_found long, error string, checkpoint string"


def record_attempts(state: Store, attempts: DataFrame, batch: int) -> bool:
    """Outcomes of attempts (issuer_id, provider, at, n, status, success_at, retry_at, records, error, checkpoint) onto the state of each
    issuer and provider: the last one's status, wait and error; last success, records and checkpoint stay where an attempt has none;
    attempts add up. ``n`` orders attempts of one time."""
    keys, order = ["issuer_id", "provider"], F.struct("at", "n")
    last = lambda c: F.max_by(c, order).alias(c)
    given = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), order)).alias(c)
    new = attempts.groupBy(*keys).agg(last("status"), F.max("at").alias("at"), given("success_at"), last("retry_at"), F.count("*").alias("made"), given("records"), last("error"), given("checkpoint"))
    old = state.newest(before=batch).select(*keys, "last_success_at", "attempt_count", "records_found", F.col("checkpoint").alias("old_checkpoint"))
    both = new.join(old, keys, "left")
    return state.append(
        both.select(
            *keys, "status", F.col("at").alias("last_attempt_at"), F.coalesce("success_at", "last_success_at").alias("last_success_at"), F.col("retry_at").alias("next_retry_at"),
            (F.coalesce("attempt_count", F.lit(0)) + F.col("made")).alias("attempt_count"), F.coalesce("records", "records_found", F.lit(0)).alias("records_found"), "error", F.coalesce("checkpoint", "old_checkpoint").alias("checkpoint"),
        ),
        batch,
    )
