"""Sharding: the law of equal counts, places without gaps, and files that hold every row once."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from odd import ROWS, table

from covenant.llm.sharding import _fisher_yates, shuffle_into_shards, write_shards


def check(rows, docs, n_shards: int) -> None:
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(docs)
    slots = defaultdict(list)
    for r in rows:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(n_shards)]
    assert set(slots) <= set(range(n_shards)) and max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_whole_table_in_small_buckets(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows = shuffle_into_shards(docs, n_shards=7, bucket_bytes=4096).collect()
    check(rows, plain, 7)
    again = shuffle_into_shards(docs.repartition(3), n_shards=7, bucket_bytes=4096).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}
    assert {(r.doc_id, r.shard, r.slot) for r in rows} != {(r.doc_id, r.shard, r.slot) for r in shuffle_into_shards(docs, n_shards=7, seed=1).collect()}
    write_shards(docs, str(tmp_path / "shards"), n_shards=7)
    check(spark.read.parquet(str(tmp_path / "shards")).collect(), plain, 7)


def test_odd_rows(spark):
    check(shuffle_into_shards(table(spark), n_shards=5).collect(), ROWS, 5)
    copies = [(3, "same")] * 50 + [(None, None)] * 50
    check(shuffle_into_shards(spark.createDataFrame(copies, "doc_id long, text string"), n_shards=24).collect(), copies, 24)
    assert shuffle_into_shards(table(spark).limit(0)).collect() == []


def test_permutations_are_uniform():
    import numpy as np

    rng = np.random.default_rng(1)
    seen = Counter(tuple(_fisher_yates(3, rng).tolist()) for _ in range(6000))
    assert len(seen) == 6 and all(850 < n < 1150 for n in seen.values())
