"""Discovery and evidence as streams: each micro-batch is a run, written to stores so that running it again changes nothing.

A run sees the stores as they were before its batch. It takes each filing key once, leaves those that an earlier run
has handled, sets apart those that fail, resolves the rest to issuers, and gathers evidence of each issuer it resolved
and alerts of bundles that have none. All that it writes goes by the number of its batch; the row of the run comes
last, and a batch that was cut off before that is done again by the restarted stream from the same arrivals.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from covenant.operators.relational import first_by
from covenant.sources.store import Store

FILING = ["issuer_id", "accession"]


@dataclass
class Stores:
    """What discovery writes: candidates, bundles of evidence that have an alert, and runs."""

    candidates: Store
    bundles: Store
    runs: Store

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> Stores:
        return cls(
            Store(spark, f"{path}/candidates", "issuer_id long, accession string, hit_id long, provider string, outcome string", FILING),
            Store(spark, f"{path}/bundles", "issuer_id long, provider string, evidence long", ["issuer_id", "provider"]),
            Store(
                spark, f"{path}/runs",
                "run long, examined long, candidates long, resolved_existing long, resolved_new long, ambiguous long, rejected long, evidence long, alerts long, errors long, status string, mark timestamp_ntz", ["run"],
            ),
        )


def discovery_run(hits: DataFrame, known: DataFrame, stores: Stores, batch: int) -> None:
    """A run over hits (hit_id, issuer_id, accession, provider, at, problem, verdict, relevant).

    ``known`` are the issuers (issuer_id) that were there before any run. ``problem`` says why a hit can't be resolved,
    ``verdict`` is ambiguous or rejected where it can't be told whose it is. An issuer that isn't known is new at its first hit.
    """
    if batch in stores.runs.manifest().batches:
        return
    handled = stores.candidates.read(before=batch).select(*FILING, "outcome")  # each filing is a candidate once
    first = F.min(F.struct("hit_id", "provider", "problem", "verdict")).alias("first")
    filings = hits.groupBy(*FILING).agg(first).select(*FILING, "first.*").join(handled.select(*FILING, F.lit(True).alias("done")), FILING, "left").persist()
    fresh = filings.where("done IS NULL")
    resolvable = fresh.where("problem IS NULL AND verdict IS NULL")
    met = known.select("issuer_id").union(handled.where("outcome IN ('matched_existing', 'verified_new')").select("issuer_id")).distinct()
    first = resolvable.join(met, "issuer_id", "left_anti").groupBy("issuer_id").agg(F.min("hit_id").alias("hit_id")).withColumn("new", F.lit(True))
    outcome = F.coalesce("verdict", F.when(F.col("new"), "verified_new").otherwise("matched_existing")).alias("outcome")
    stores.candidates.append(fresh.where("problem IS NULL").join(first, ["issuer_id", "hit_id"], "left").select(*FILING, "hit_id", "provider", outcome), batch)

    mine = stores.candidates.read().where(F.col("_batch") == batch)
    processed = mine.where("outcome IN ('matched_existing', 'verified_new')").select("issuer_id").distinct()
    evidence = hits.where("relevant").join(processed, "issuer_id", "left_semi").groupBy("issuer_id", "provider").agg(F.count("*").alias("evidence"))
    had = stores.bundles.read(before=batch).select("issuer_id", "provider")
    stores.bundles.append(evidence, batch)
    gathered = stores.bundles.read().where(F.col("_batch") == batch)
    alerts = gathered.join(had, ["issuer_id", "provider"], "left_anti")

    n = lambda name: F.count_if(F.col("outcome") == name)
    of_hits = hits.agg(F.count("*").alias("examined"), F.max("at").alias("last"))
    of_filings = filings.agg(F.count("*").alias("candidates"), F.count_if(F.col("done").isNull() & F.col("problem").isNotNull()).alias("errors"))
    of_mine = mine.agg(n("matched_existing").alias("resolved_existing"), n("verified_new").alias("resolved_new"), n("ambiguous").alias("ambiguous"), n("rejected").alias("rejected"))
    counts: dict = {}
    for row in (of_hits, of_filings, of_mine, gathered.agg(F.coalesce(F.sum("evidence"), F.lit(0)).alias("evidence")), alerts.agg(F.count("*").alias("alerts"))):
        counts |= row.first().asDict()
    previous = stores.runs.read(before=batch).agg(F.max("mark").alias("mark")).first().mark
    counts |= {"run": batch, "status": "success" if not counts["errors"] else "completed_with_errors", "mark": counts.pop("last") if not counts["errors"] else previous}
    schema = stores.runs.schema
    stores.runs.append(hits.sparkSession.createDataFrame([tuple(counts[f.name] for f in schema.fields)], schema), batch)
    filings.unpersist()


def evidence_run(texts: DataFrame, keys: list[str], find: Callable[[DataFrame], DataFrame], done: Store, found: Store, batch: int) -> None:
    """Evidence in texts (keys, text) that no earlier run has looked at. ``find`` gives rows of texts; texts without any are remembered as well."""
    new = first_by(texts, keys, F.asc("text")).join(done.read(before=batch).select(*keys), keys, "left_anti")
    found.append(find(new), batch)
    done.append(new.select(*keys), batch)  # last: without it the batch is done again


def stream(source: DataFrame, checkpoint: str, run: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run over all that has arrived, a micro-batch at a time, and stop. The checkpoint holds what has been read."""
    return source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
