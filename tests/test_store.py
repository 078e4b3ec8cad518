"""The written store: replays, newest rows, compaction, writers that meet, and streams cut off in the middle."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from covenant.bindings import Roles
from covenant.plans import runs
from covenant.sources.store import Manifest, Store
from covenant.streaming.discovery import Stores, discovery_run


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "s"), "k long, v string, n long", ["k"], ["n"])


def rows(spark, *values):
    return spark.createDataFrame(list(values), "k long, v string, n long")


def as_set(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_batches_are_written_once(spark, store):
    assert store.read().count() == 0 and store.newest().count() == 0 and store.vacuum() == 0
    assert store.append(rows(spark, (1, "a", 1), (2, "b", 1), (1, "c", 2), (None, "d", 1)), 0)
    assert not store.append(rows(spark, (9, "again", 1)), 0)
    assert store.append(rows(spark, (2, None, 0), (3, "e", 5), (3, "f", 5)), 7)
    assert store.append(rows(spark).limit(0), 8) and store.manifest().batches == [0, 7, 8]
    newest = [(1, "c", 2), (2, None, 0), (3, "f", 5), (None, "d", 1)]
    assert as_set(store.newest()) == sorted(newest, key=repr)
    assert as_set(store.newest(before=7)) == sorted([(1, "c", 2), (2, "b", 1), (None, "d", 1)], key=repr)
    every = as_set(store.read())
    assert store.compact() and as_set(store.read()) == every and len(store.manifest().segments) == 1
    assert store.vacuum() == 3 and as_set(store.read()) == every
    assert store.compact(history=False) and as_set(store.read().drop("_batch")) == sorted(newest, key=repr)
    assert not store.append(rows(spark, (9, "again", 1)), 7)


def test_of_two_writers_one_wins_and_the_other_tries_again(spark, store, monkeypatch):
    store.append(rows(spark, (1, "a", 1)), 0)
    stale = store.manifest()
    store.append(rows(spark, (2, "b", 1)), 1)
    assert not store._replaced(Manifest(stale.version + 1, [], []))  # the version is taken
    real, seen = Store.manifest, []
    monkeypatch.setattr(Store, "manifest", lambda self: seen.append(1) or (stale if len(seen) <= 2 else real(self)))  # reads what was there before the other came
    assert store.append(rows(spark, (3, "c", 1)), 2)
    monkeypatch.undo()
    assert as_set(store.newest()) == [(1, "a", 1), (2, "b", 1), (3, "c", 1)] and store.manifest().batches == [0, 1, 2]


def test_what_a_cut_off_writer_left_is_not_read(spark, store):
    store.append(rows(spark, (1, "a", 1)), 0)
    store._write(rows(spark, (5, "left behind", 1)).withColumn("_batch", F.lit(1).cast("long")))
    assert as_set(store.newest()) == [(1, "a", 1)]
    assert store.vacuum() == 1 and as_set(store.newest()) == [(1, "a", 1)]


def test_a_run_cut_off_between_its_stores_is_done_again(spark, sf_dir, monkeypatch):
    r = Roles(spark, sf_dir)
    whole = runs.discovered(r)
    expected = [as_set(s.read()) for s in (whole.candidates, whole.bundles, whole.runs)]
    append, failed = Store.append, []

    def fails_once(self, df, batch):
        if batch == 1 and "/runs" in self.path and not failed:
            failed.append(1)
            raise runs._CutOff
        return append(self, df, batch)

    monkeypatch.setattr(Store, "append", fails_once)
    again = runs.discovered(r)
    assert failed and [as_set(s.read()) for s in (again.candidates, again.bundles, again.runs)] == expected
    assert os.path.isdir(f"{again.runs.path}/manifest")


def test_an_arrival_is_written_and_read_by_many_tasks(spark):
    arrivals = spark.range(0, 3000, numPartitions=4).select("id", (F.col("id") % 3).cast("int").alias("batch"))
    seen = []

    def run(path, df, n):
        seen.append((n, df.count(), df.where(F.col("id") % 3 != n).count(), df.select(F.spark_partition_id()).distinct().count()))

    path = runs._restarted(arrivals, "arrivals", run)
    assert len([f for f in os.listdir(f"{path}/arrivals") if f.endswith(".parquet")]) == 12
    assert [s[:3] for s in seen] == [(0, 1000, 0), (1, 1000, 0), (1, 1000, 0), (2, 1000, 0)]
    assert all(parts > 1 for *_, parts in seen)


def test_arrivals_are_gone_through_once_and_shared_evenly(spark, monkeypatch):
    """Rows lie in the order of their batches, as events do in the order of their days; one batch has none."""
    monkeypatch.setattr(runs, "FILE_ROWS", 100, raising=False)
    gone_through = spark.sparkContext.accumulator(0)

    def passed(n):
        gone_through.add(1)
        return n

    rows = spark.range(0, 2000, numPartitions=4).select(F.udf(passed, "long")("id").alias("id"), F.when(F.col("id") < 500, 0).otherwise(2).alias("batch"))
    seen = []

    def run(path, df, n):
        seen.append((n, df.count(), df.where((F.col("id") < 500) != (n == 0)).count(), df.select(F.spark_partition_id()).distinct().count()))

    runs._restarted(rows, "ordered", run)
    assert [s[:3] for s in seen] == [(0, 500, 0), (1, 0, 0), (1, 0, 0), (2, 1500, 0)]
    assert seen[0][3] > 1 and gone_through.value == 2000


def test_a_discovery_run_does_not_group_again_what_earlier_runs_wrote(spark, tmp_path, monkeypatch):
    stores = Stores.at(spark, str(tmp_path))
    monkeypatch.setattr(Store, "newest", lambda *_, **__: pytest.fail("candidates are grouped again"))
    known = spark.createDataFrame([(2,)], "issuer_id long")
    schema = "hit_id long, issuer_id long, accession string, provider string, at timestamp_ntz, problem string, verdict string, relevant boolean"
    hit = lambda n, issuer, accession, problem=None, verdict=None: (n, issuer, accession, "p" if n % 2 else "q", None, problem, verdict, True)
    arrivals = (
        [hit(3, 1, "a"), hit(1, 1, "b"), hit(2, 1, "a"), hit(4, 2, "a"), hit(5, 3, "x", "bad"), hit(6, 4, "y", verdict="rejected"), hit(7, None, "z", verdict="ambiguous")],
        [hit(8, 1, "a"), hit(9, 1, "c"), hit(10, 3, "x"), hit(11, 3, "w"), hit(12, 4, "y"), hit(13, 2, "v", "bad")],
    )
    for n, hits in enumerate((*arrivals, arrivals[1])):
        discovery_run(spark.createDataFrame(hits, schema), known, stores, min(n, 1))
    assert as_set(stores.candidates.read()) == sorted(
        [
            (1, "b", 1, "p", "verified_new", 0), (1, "a", 2, "q", "matched_existing", 0), (2, "a", 4, "q", "matched_existing", 0), (4, "y", 6, "q", "rejected", 0), (None, "z", 7, "p", "ambiguous", 0),
            (1, "c", 9, "p", "matched_existing", 1), (3, "x", 10, "q", "verified_new", 1), (3, "w", 11, "p", "matched_existing", 1),
        ],
        key=repr,
    )
    runs_written = sorted(stores.runs.read().select("run", "examined", "candidates", "resolved_existing", "resolved_new", "ambiguous", "rejected", "evidence", "alerts", "errors").collect())
    assert [tuple(r) for r in runs_written] == [(0, 7, 6, 2, 1, 1, 1, 4, 3, 1), (1, 6, 6, 2, 1, 0, 0, 4, 2, 1)]
