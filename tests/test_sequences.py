"""Budgets and states against plain loops, and merges of arrays."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from covenant.operators.nested import merged
from covenant.operators.running import before_each, within_budget
from covenant.operators.states import State, enriched


@pytest.mark.parametrize("ceilings", [(None, None, None), (9, None, None), (None, 12, None), (None, None, 3), (14, 15, 4), (0, 5, 5)])
def test_budget_is_that_of_a_loop(spark, ceilings):
    rng = random.Random(6)
    calls = [(rng.choice(["a", "b", None]), i, step, rng.choice([None, 1, 2, 3]), rng.random() < 0.4) for i in range(60) for step in range(rng.randint(1, 2))]
    expected, made = {}, {}
    for group, i, step, cost, large in calls:
        n, spent, larges = made.get(group, (0, 0, 0))
        most, dear, most_large = (float("inf") if c is None else c for c in ceilings)
        ok = n < most and spent < dear and not (large and larges >= most_large)
        expected[i, step] = ok
        if ok:
            made[group] = (n + 1, spent + (cost or 0), larges + large)
    df = spark.createDataFrame(calls, "run string, i long, step int, cost int, big boolean")
    found = {(r.i, r.step): r.passes for r in within_budget(df, ["run"], "i", ["step"], "cost", "big", *ceilings, span=7).collect()}
    assert found == expected


def test_running_sums_of_a_group_are_cut_in_ranges(spark):
    df = spark.range(500).selectExpr("if(id % 3 = 0, 'x', 'y') AS g", "id", "id % 7 AS v")
    found = {r.id: r.s for r in before_each(df, ["g"], "id", [], {"s": F.col("v")}, span=16).collect()}
    assert found == {i: sum(j % 7 for j in range(i) if (j % 3 == 0) == (i % 3 == 0)) for i in range(500)}


def test_states_go_on_over_batches_and_allow_by_each_state(spark):
    t = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    rows = [(1, "filings", t(h), h, "complete", h) for h in range(0, 40, 4)] + [(2, "dockets", t(0), 0, None, None), (2, "dockets", t(5), 1, "ambiguous", 3), (2, "dockets", t(6), 2, "ambiguous", None), (2, "dockets", t(79), 3, "unsupported", 1), (2, "dockets", t(9999), 4, "complete", 9), (None, None, t(0), 1, "running", None), (None, None, t(1), 2, "complete", None), (None, None, t(2), 3, "complete", 5)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = {(r.issuer_id, r.n): (r.allowed, r.status, r.attempts, r.records) for r in enriched(spark.createDataFrame(rows, "issuer_id long, provider string, at timestamp_ntz, n long, outcome string, records long")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [found[1, h][0] for h in range(0, 40, 4)] == [h in (0, 16, 32) for h in range(0, 40, 4)]
    assert found[1, 36] == (False, "complete", 3, 32)
    assert [found[2, n] for n in range(5)] == [(True, "failed_retryable", 1, 0), (False, "failed_retryable", 1, 0), (True, "ambiguous", 2, 0), (True, "unsupported", 3, 1), (False, "unsupported", 3, 1)]
    assert [found[None, n][:2] for n in (1, 2, 3)] == [(True, "running"), (False, "running"), (True, "complete")]
    assert not State("failed_permanent").allows("bonds", t(0)) and State("complete", t(0), None).allows("bonds", t(0))


def test_arrays_are_merged_by_key(spark):
    old, new = [(2, "b"), (1, "a"), (None, "n"), (2, "b2")], [(3, "c"), (2, "x"), (3, "c2"), (None, "m")]
    df = spark.createDataFrame([(1, old, new), (2, None, new), (3, old, None), (4, [], [])], "i int, o array<struct<k: int, v: string>>, w array<struct<k: int, v: string>>")
    both = lambda a, b: F.struct(a["k"].alias("k"), F.concat(a["v"], b["v"]).alias("v"))
    kept = {r.i: [tuple(x) for x in r.m] for r in df.select("i", merged(F.col("o"), F.col("w"), "k").alias("m")).collect()}
    assert kept == {1: [(None, "n"), (1, "a"), (2, "b"), (3, "c")], 2: [(None, "m"), (2, "x"), (3, "c")], 3: [(None, "n"), (1, "a"), (2, "b")], 4: []}
    joined = df.select("i", merged(F.col("o"), F.col("w"), "k", both).alias("m")).where("i = 1").first().m
    assert [tuple(x) for x in joined] == [(None, "nm"), (1, "a"), (2, "bx"), (3, "c")]
