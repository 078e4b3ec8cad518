"""Exact dedup against groups of equal texts, with and without equal fingerprints."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from odd import ROWS, table

from covenant.llm.exact_dedup import exact_dedup


def check(found, rows) -> None:
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    most = lambda ids: max((i for i in ids if i is not None), default=None)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found.collect()), key=repr)
    assert got == sorted(((i, (k := most(groups[t or ""])), len(groups[t or ""]), i == k, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr)


def test_odd_rows(spark):
    check(exact_dedup(table(spark)), ROWS)
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_doc_id_in_several_groups(spark):
    rows = [(9, "aaa"), (9, "bbb"), (1, "aaa"), (2, "aaa"), (3, "bbb"), (4, "bbb")]
    check(exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")), rows)


@pytest.mark.parametrize("moduli", [(2, 3)])
def test_equal_fingerprints_of_different_texts(spark, moduli):
    """Hashes so weak that most texts of one length collide: the comparison of chunks decides."""
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.choice([3, 4, 40])))) for i in range(24)] + [(None, "aba"), (3, "abb"), (3, "abb")]
    check(exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), salt_rows=4, compare_bytes=16, segment_bytes=8, moduli=moduli), rows)
