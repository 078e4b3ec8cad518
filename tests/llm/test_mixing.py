"""Mixing: targets by filling up step by step, and what is taken."""

from __future__ import annotations

from collections import Counter, defaultdict

from odd import ROWS, table
from plain import SPACED

from covenant.llm import mixing
from covenant.llm.mixing import mix_sources, mixed_documents


def plain_targets(words: dict[str | None, int]) -> dict[str | None, float]:
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    held: set = set()
    while True:
        free = [s for s in words if s not in held]
        left = sum(words.values()) - sum(3 * words[s] for s in held)
        target = {s: 3.0 * words[s] if s in held else left * weight[s] / sum(weight[x] for x in free) for s in words}
        over = {s for s in free if target[s] > 3 * words[s]}
        if not over:
            return target
        held |= over


def check(rows) -> None:
    """Sizes, sources' sizes and targets are right, copies are three at most, and shards are those of the copies."""
    words = defaultdict(int)
    for r in rows:
        assert r.size == len(SPACED.findall(r.text or ""))
        words[r.source] += r.size
    want = plain_targets(dict(words))
    for r in rows:
        assert r.source_size == words[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size and len(r.shards) == r.copies


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mix_sources(docs).collect()
    check(rows)
    assert sorted(map(str, rows)) == sorted(map(str, mix_sources(docs.repartition(5)).collect()))
    taken, target, most = Counter(), {}, Counter()
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        most[r.source] = max(most[r.source], r.size)
    assert all(-1e-6 <= target[s] - taken[s] < max(most[s], 0.1 * target[s]) for s in target)
    assert sum(taken.values()) > 0.9 * sum(target.values())


def test_one_source_holds_most_and_many_blocks(spark):
    docs = spark.createDataFrame([(i, " ".join("w" * (i % 7 + 1)), "big" if i % 10 else f"small{i % 30}") for i in range(3000)], "doc_id long, text string, source string")
    rows = mix_sources(docs, block_rows=50).collect()
    check(rows)
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
    assert all(abs(taken[r.source] - r.target) <= 4 for r in rows)
    per_shard = Counter(s for r in rows for s in r.shards)
    assert len(per_shard) == 16


def test_odd_rows(spark):
    found = mix_sources(table(spark)).collect()
    assert len(found) == len(ROWS)
    check(found)
    # several texts with one doc_id and rows repeated are drawn together
    assert {(r.doc_id, r.source): r.copies for r in found}.items() >= {(r.doc_id, r.source): r.copies for r in found if r.doc_id == 7}.items()
    out = mixed_documents(table(spark)).collect()
    assert len(out) == sum(r.copies for r in found)
    nothing = table(spark).limit(0)
    assert mix_sources(nothing).collect() == [] and mixed_documents(nothing).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mix_sources(blank).collect()] == [(0, 0.0, 0)] * 2


def test_what_is_taken_comes_from_the_tree(spark, sf_dir, monkeypatch):
    """With a tree that draws nothing, or leaves draws out, the mix takes nothing, or less."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = {r.doc_id: r.taken for r in mix_sources(docs).collect()}
    real = mixing.splitting_tree
    monkeypatch.setattr(mixing, "splitting_tree", lambda tickets, depth: real(tickets, depth).limit(0))
    assert sum(r.taken for r in mix_sources(docs).collect()) == 0 < sum(whole.values())
    monkeypatch.setattr(mixing, "splitting_tree", lambda tickets, depth: real(tickets, depth).where("shard >= 8"))
    less = {r.doc_id: r.taken for r in mix_sources(docs).collect()}
    assert all(less[i] <= whole[i] for i in whole) and 0 < sum(less.values()) < sum(whole.values())
