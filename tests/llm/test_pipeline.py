"""Each stage of the pipeline against a plain version on its own input, with odd rows and clashing columns."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import corpus_pipeline as cp
import pytest
from odd import CLASHING, ROWS, table
from plain import components, contamination, similar_pairs

from covenant.llm import toxicity

ITEMS = [("i1", "the quick brown fox jumps over the lazy dog near here today"), ("i2", "largest text of eight"), (None, None)]


@pytest.fixture(scope="module")
def tables_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(500)}"
    rows = [(100 + i, " ".join(word() for _ in range(12)) + (" you scumbag and scumbag" if i % 6 == 0 else "")) for i in range(150)]
    rows += [(300 + i, f"Before that {ITEMS[0][1]}, {word()} {word()}") for i in range(3)]
    rows += [(400 + i, "a text that has a few copies with one word of its own at the very end of it " + (f"n{i}" if i else "")) for i in range(5)]
    docs = table(spark, [*ROWS, *rows])
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(100 + i, int(i % 6 == 0)) for i in range(0, 150)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, tables_dir):
    return spark.read.parquet(f"{tables_dir}/documents.parquet")


def keys(df) -> Counter:
    return Counter((r.doc_id, r.text) for r in df.collect())


def whole(df, of) -> None:
    """Rows come with all their columns as they were."""
    before = {(r.doc_id, r.text): r for r in of.collect()}
    assert df.columns == of.columns
    for r in df.collect():
        known = before[r.doc_id, r.text]
        assert all(r[c] == known[c] for c in CLASHING)


def test_toxicity(spark, docs, tables_dir):
    found = cp.drop_toxic(spark, docs, tables_dir)
    whole(found, docs)
    assert keys(found) == Counter({k: n for k, n in keys(docs).items() if "scumbag" not in (k[1] or "")})
    assert toxicity.THRESHOLD == 0.3


def test_near_copies(spark, docs, tables_dir):
    found = cp.drop_near_copies(spark, docs, tables_dir)
    whole(found, docs)
    kept, rows = keys(found), sorted(keys(docs), key=repr)
    group = components(list(range(len(rows))), similar_pairs({i: t for i, (_, t) in enumerate(rows)}))
    members = defaultdict(list)
    for i, g in group.items():
        members[g].append(rows[i])
    assert set(kept.values()) == {1} and sum(kept.values()) == len(members)
    for some in members.values():
        left = [m for m in some if m in kept]
        assert len(left) == 1
        ids = [i for i, _ in some if i is not None]
        once = [i for i in ids if Counter(i for i, _ in keys(docs).elements())[i] == 1]
        assert left[0][0] == min(once) if once else True


def test_decontamination(spark, docs, tables_dir):
    found = cp.drop_contaminated(spark, docs, tables_dir)
    whole(found, docs)
    clean = {k: n for k, n in keys(docs).items() if len(k[1] or "") > 10_000 or not contamination(k[1], ITEMS)[1]}
    assert keys(found) == Counter(clean) and len(clean) == len(keys(docs)) - 3


def test_mix_and_shard(spark, docs, tables_dir):
    found = cp.mix(spark, docs, tables_dir)
    whole(found, docs)
    assert keys(found) <= Counter({k: 3 * n for k, n in keys(docs).items()})
    sharded = cp.shard(spark, docs, tables_dir)
    assert keys(sharded) == keys(docs)
    assert set(sharded.columns) == {*docs.columns, "shard", "slot", "size", "text_crc32"}
    assert max(Counter(r.shard for r in sharded.collect()).values()) - len(docs.collect()) // 24 <= 1


def test_run_and_empty_tables(spark, docs, tables_dir):
    rows = cp.run(spark, tables_dir).collect()
    left = Counter((r.doc_id, r.text) for r in rows)
    assert not any("scumbag" in (t or "") or "quick brown fox" in (t or "") for _, t in left) and max(left.values()) <= 3
    assert sum(i is not None and 400 <= i < 405 for i, _ in left) <= 1
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), tables_dir).collect() == []
