"""Line dedup against a plain version, row by row."""

from __future__ import annotations

import hashlib
import random

from odd import ROWS
from plain import kept_lines

from covenant.llm.line_dedup import line_digests

L = "This is a line of more than forty characters, for sure."


def check(spark, rows, **options):
    found = line_digests(spark.createDataFrame(rows, "doc_id long, text string"), **options)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in found.collect()), key=repr)
    want = sorted(((i, n, gone, hashlib.sha256(t.encode()).hexdigest()) for (i, _), (n, gone, t) in zip(rows, kept_lines(rows), strict=True)), key=repr)
    assert got == want


def test_lines_in_many_documents(spark):
    rng = random.Random(4)
    lines = [f"  {L} Number {i}.\t" for i in range(30)] + ["short", "", "ü" * 39, "ü" * 40, L.upper(), L]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 40)))) for i in range(60)]
    check(spark, rows)
    check(spark, rows, range_rows=7)  # runs that go on over many ranges


def test_odd_rows(spark):
    check(spark, [*ROWS, *((i, L) for i in range(20, 26))])
    # one id with several texts is one document, and each row keeps its own lines
    check(spark, [(1, L + "\nalpha"), (1, L + "\nbeta"), (1, L), (2, L), (3, L), (4, L)])
    check(spark, [(1, L + "\nalpha"), (1, L + "\nbeta"), (1, L), (2, L), (3, L), (4, L), (5, f"a\n{L}\nb"), (None, L)])
    assert line_digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
