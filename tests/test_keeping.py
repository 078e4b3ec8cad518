"""Claimers that meet, and memberships against folding every change in a loop."""

from __future__ import annotations

import random

from covenant.operators.views import Memberships
from covenant.sources.queue import Queue
from covenant.sources.store import Store


def test_claimers_that_began_from_one_state_get_different_jobs(spark, tmp_path, monkeypatch):
    queue = Queue(spark, str(tmp_path / "q"))
    queue.submit(spark.range(10).selectExpr("id AS job", "9 - id AS place"), 0)
    stale = queue.log.manifest()
    ann = {r.job for r in queue.claim("ann", 0, 4, 1).collect()}
    assert ann == {9, 8, 7, 6}
    real, seen = Store.manifest, []
    monkeypatch.setattr(Store, "manifest", lambda self: seen.append(1) or (stale if len(seen) == 1 else real(self)))
    bob = {r.job for r in queue.claim("bob", 0, 4, 2).collect()}
    monkeypatch.undo()
    assert bob == {5, 4, 3, 2} and len(seen) > 1
    assert {r.job for r in queue.claim("bob", 0, 4, 2).collect()} == bob  # under the same number again
    assert {r.job for r in queue.claim("cy", 899, 4, 3).collect()} == {1, 0}
    assert {r.job: r.attempts for r in queue.claim("dan", 900, 3, 4).collect()} == {9: 2, 8: 2, 7: 2}
    queue.done("ann", spark.range(10).selectExpr("id AS job"), 5)
    assert {r.job for r in queue.jobs().where("status = 'done'").collect()} == {6}
    assert queue.submit(spark.createDataFrame([(9, 0), (10, 0), (10, 0)], "job long, place long"), 6) and queue.jobs().count() == 11


def test_memberships_are_those_of_a_loop(spark, tmp_path):
    rng = random.Random(11)
    changes = [(rng.randrange(3), rng.randrange(4), n, rng.choice(["add", "remove", "upgrade"]), rng.randrange(3)) for n in range(120)]
    kept = Memberships(spark, str(tmp_path / "m"))
    members: dict[tuple[int, int], int] = {}
    schema = "collection_id long, issuer_id long, seq long, action string, rank int"
    for batch in range(4):
        part = changes[batch * 30 : batch * 30 + 30]
        for collection, issuer, _, action, rank in part:
            key = (collection, issuer)
            if action == "remove":
                members.pop(key, None)
            elif action == "add" or key in members:
                members[key] = max(rank, members.get(key, -1))
        shuffled = rng.sample(part, len(part))
        for _ in range(2):
            kept.apply(spark.createDataFrame(shuffled, schema), batch)
        assert {(r.collection_id, r.issuer_id): r["rank"] for r in kept.members.newest().where("present").collect()} == members
        counts = {c: (sum(k[0] == c for k in members), sum(k[0] == c and v >= 2 for k, v in members.items())) for c in range(3)}
        found = {r.collection_id: (r.members, r.verified) for r in kept.summaries.newest().collect()}
        assert {c: found.get(c, (0, 0)) for c in range(3)} == counts
    kept.apply(spark.createDataFrame([], schema), 9)
    assert kept.members.newest().where("present").count() == len(members)
