"""Aggregations on rows that the small tables don't have."""

from __future__ import annotations

import datetime

from compared import assert_same, tables

from covenant import registry


def test_bundles_of_ids_over_a_million(spark, tmp_path):
    at = datetime.datetime(2024, 1, 9)
    rows = [(9, at, 1, "click", 1.0, '{"k": 1}'), (1_500_009, at, 1, "purchase", 1.0, '{"k": 1}'), (2_700_009, at, 1, "error", 1.0, '{"k": 1}'), (3, at, 2, "click", 1.0, '{"k": 1}'), (1_000_002, at, 2, "error", 1.0, '{"k": 1}')]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    query = registry.all_queries()["a14_bundles"]
    found = registry.queries()["a14_bundles"](spark, str(tmp_path))
    assert {r.bundle_key: r.first_id for r in found.collect()} == {"1:dockets:1": 9, "2:dockets:1": 1_000_002}
    con = tables(str(tmp_path))
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert_same(found, query.sql, con)
