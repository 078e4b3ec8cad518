"""Enrichment as a state machine: each issuer and provider's attempts in order, each allowed or not by the state before it.

An attempt that the state doesn't allow changes nothing, so what a later one finds depends on all before it: a fold
with state, and not a window. Rows are dealt by issuer and provider and sorted by time in their partition, and a task
goes through them once, holding the state of one key, so a key of any number of attempts takes no memory. That is
Python on Arrow batches, a comparison or two for an attempt.

Defined results: a null issuer or provider is one of its own; attempts of one time go in the order of ``n``; an attempt
without an outcome is a failure to be tried again after ``RETRY_HOURS``; an unknown provider has a day to settle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.functions.dates import OPEN_STATES, SETTLED_STATES, STUCK_HOURS, UNRESOLVED_HOURS

#: Hours for which a provider's data stay fresh. Fixed values.
TTL_HOURS = {"filings": 12, "dockets": 168, "bonds": 720}
#: Hours after which a failure may be tried again. Fixed value.
RETRY_HOURS = 6


@dataclass(frozen=True)
class State:
    """What is known of an issuer's data at a provider."""

    status: str | None = None
    last_attempt: datetime | None = None
    last_success: datetime | None = None
    next_retry: datetime | None = None
    attempts: int = 0
    records: int = 0

    def allows(self, provider: str | None, now: datetime) -> bool:
        """Whether an attempt may be made."""
        past = lambda since, hours: since is None or now - since > timedelta(hours=hours)
        if self.status is None:
            return True
        if self.status == "failed_retryable":
            return self.next_retry is None or self.next_retry <= now
        if self.status == "running":
            return past(self.last_attempt, STUCK_HOURS)
        if self.status in SETTLED_STATES:
            return past(self.last_success, TTL_HOURS.get(provider, 24))
        if self.status in OPEN_STATES:
            return past(self.last_attempt, UNRESOLVED_HOURS)
        return False

    def after(self, now: datetime, outcome: str | None, records: int | None) -> State:
        """The state that an attempt leaves."""
        failed = outcome is None
        return replace(
            self, status="failed_retryable" if failed else outcome, last_attempt=now, last_success=now if outcome in SETTLED_STATES else self.last_success,
            next_retry=now + timedelta(hours=RETRY_HOURS) if failed else None, attempts=self.attempts + 1, records=self.records if records is None else records,
        )


def enriched(attempts: DataFrame) -> DataFrame:
    """Attempts (issuer_id, provider, at, n, outcome, records) with what came of them: allowed, and the state after each."""
    names = ["issuer_id", "provider", "at", "n"]
    added = {"allowed": pa.bool_(), "status": pa.string(), "last_success": pa.timestamp("us"), "next_retry": pa.timestamp("us"), "attempts": pa.int64(), "total": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), State()
        for b in batches:
            out = []
            for issuer, provider, at, outcome, records in zip(*(b.column(c).to_pylist() for c in ("issuer_id", "provider", "at", "outcome", "records")), strict=True):
                if (issuer, provider) != key:
                    key, state = (issuer, provider), State()
                allowed = state.allows(provider, at)
                state = state.after(at, outcome, records) if allowed else state
                out.append((allowed, state.status, state.last_success, state.next_retry, state.attempts, state.records))
            columns = zip(*out, strict=True) if out else [[]] * len(added)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(c, k) for c, k in zip(columns, added.values(), strict=True))], [*names, *added])

    rows = attempts.select("issuer_id", "provider", F.col("at").cast("timestamp_ntz").alias("at"), F.col("n").cast("long").alias("n"), "outcome", F.col("records").cast("long").alias("records"))
    dealt = rows.repartition("issuer_id", "provider").sortWithinPartitions("issuer_id", "provider", "at", "n")
    kind = rows.schema
    schema = f"issuer_id {kind['issuer_id'].dataType.simpleString()}, provider string, at timestamp_ntz, n long, allowed boolean, status string, last_success timestamp_ntz, next_retry timestamp_ntz, attempts long, total long"
    return dealt.mapInArrow(run, schema).withColumnRenamed("total", "records")
