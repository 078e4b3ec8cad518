"""Decontamination against trying every window at every place."""

from __future__ import annotations

import random

from odd import ROWS, table
from plain import contamination

from covenant.llm.decontamination import decontaminate

ITEMS = "item_id string, text string"


def check(spark, rows, items, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontaminate(docs, spark.createDataFrame(items, ITEMS), **options).collect()
    got = sorted(((r.doc_id, r.n_words, sorted(i for s in r.spans for i in range(s["start"], s["end"])), r["items"]) for r in found), key=repr)
    want = sorted(((i, n, sorted(hit), sorted(of)) for i, t in rows for n, hit, of in [contamination(t, items)]), key=repr)
    assert got == want


def test_words_that_recur(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["a", "B", "c9"]) for _ in range(n))
    rows = [(i, text(rng.randrange(0, 120))) for i in range(40)]
    items = [(f"i{i}", text(rng.choice([0, 1, 2, 3, 9, 10, 11, 14]))) for i in range(12)] + [("i0", "b a b"), (None, "c9, c9; A"), ("none", None)]
    check(spark, rows, items)
    check(spark, rows, items, part_words=3)  # many parts of tables


def test_odd_rows(spark):
    check(spark, [r for r in ROWS if len(r[1] or "") < 1000], [("a", "repeated row"), ("b", "größer ünïcode"), ("c", "one text of eight"), ("d", "")])
    assert decontaminate(table(spark), spark.createDataFrame([("a", "x")], ITEMS)).where("size(items) > 0").count() == 1
    assert decontaminate(table(spark), spark.createDataFrame([], ITEMS)).where("size(spans) > 0").count() == 0
    assert decontaminate(table(spark).limit(0), spark.createDataFrame([("a", "x")], ITEMS)).collect() == []
