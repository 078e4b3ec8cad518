"""Every query of the research model against its SQL, on whole tables."""

from __future__ import annotations

import pytest
from compared import assert_same, tables

from covenant import registry
from covenant.operators.rules import phrase_hits

QUERIES = registry.all_queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return tables(sf_dir)


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_query_equals_its_sql(spark, con, sf_dir, name):
    assert_same(registry.queries()[name](spark, sf_dir), QUERIES[name].sql, con)


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if not q.sql))
def test_query_without_sql_runs(spark, sf_dir, name):
    found = registry.queries()[name](spark, sf_dir).count()
    assert found > 0


def test_rules_on_texts_with_their_phrases(spark):
    texts = spark.createDataFrame(
        [(1, "The company filed a voluntary petition on Monday."), (2, "As in chapter 11 of the manual."), (3, "CHAPTER 7 liquidation"), (4, None), (5, "")], "doc_id long, text string"
    )
    found = {(r.doc_id, r.rule) for r in phrase_hits(texts, "text").collect()}
    assert (1, "phrase_chapter_11_petition") in found
    assert (3, "phrase_chapter_7_petition") in found
    assert not {d for d, _ in found} & {2, 4, 5}


def test_flagship_has_a_stable_schema(spark, sf_dir):
    one, two = (registry.flagship(spark, sf_dir).schema for _ in range(2))
    assert one == two
