"""A queue of jobs with leases, in a written store.

Every change of a job is a row of a log: submitted, claimed by a worker until a time, done. The newest row of a job is
its state. A claim takes the first jobs, in the order in which they were submitted, that are pending or whose lease has
run out; a job whose last allowed attempt ran out fails instead. A claim is one batch of the store, based on what it
has read: where another writer came in between, the batch isn't put in place, and the claim is made anew on what that
one left. So of several claimers that began from the same state no two get one job, and a claim that is repeated under
its number gives what it gave.

Defined results: a job submitted twice is there once; a job done by a worker whose lease has gone to another stays
with the other; a claim of more jobs than there are takes those there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covenant.sources.store import TRIES, Store

LEASE_SECONDS, ATTEMPTS = 900, 3
_SCHEMA = "job long, place long, status string, worker string, until double, attempts int"


class Queue:
    """Jobs by number; ``place`` is their order."""

    def __init__(self, spark: SparkSession, path: str, lease: float = LEASE_SECONDS, attempts: int = ATTEMPTS) -> None:
        self.log = Store(spark, path, _SCHEMA, ["job"])
        self.lease, self.attempts = lease, attempts

    def jobs(self, before: int | None = None) -> DataFrame:
        """The state of each job."""
        return self.log.newest(before=before)

    def submit(self, jobs: DataFrame, batch: int) -> bool:
        """Jobs (job, place) that aren't there yet."""
        new = jobs.dropDuplicates(["job"]).join(self.jobs(before=batch).select("job"), "job", "left_anti")
        rows = new.select("job", "place", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("worker"), F.lit(None).cast("double").alias("until"), F.lit(0).alias("attempts"))
        return self.log.append(rows, batch)

    def claim(self, worker: str, now: float, most: int, batch: int) -> DataFrame:
        """The jobs (job, attempts) that a worker gets, ``most`` of them."""
        for _ in range(TRIES):
            seen = self.log.manifest()
            if batch in seen.batches:
                break
            state = self.log.newest(manifest=seen)
            open_ = state.where((F.col("status") == "pending") | ((F.col("status") == "claimed") & (F.col("until") <= now)))
            spent = open_.where(F.col("attempts") >= self.attempts)
            first = open_.where(F.col("attempts") < self.attempts).orderBy("place", "job").limit(most)
            claimed = first.select("job", "place", F.lit("claimed").alias("status"), F.lit(worker).alias("worker"), F.lit(float(now + self.lease)).alias("until"), (F.col("attempts") + 1).alias("attempts"))
            failed = spent.select("job", "place", F.lit("failed").alias("status"), "worker", F.lit(None).cast("double").alias("until"), "attempts")
            if self.log.append_to(seen, claimed.unionByName(failed), batch):
                break
        else:
            raise RuntimeError("too many claimers at once")
        return self.log.read().where((F.col("_batch") == batch) & (F.col("status") == "claimed")).select("job", "attempts")

    def done(self, worker: str, jobs: DataFrame, batch: int) -> bool:
        """Jobs (job) that a worker has done, as far as they are still its own."""
        for _ in range(TRIES):
            seen = self.log.manifest()
            if batch in seen.batches:
                return False
            own = self.log.newest(manifest=seen).where((F.col("status") == "claimed") & (F.col("worker") == worker)).join(jobs.select("job"), "job", "left_semi")
            if self.log.append_to(seen, own.select("job", "place", F.lit("done").alias("status"), "worker", F.lit(None).cast("double").alias("until"), "attempts"), batch):
                return True
        raise RuntimeError("too many writers at once")
