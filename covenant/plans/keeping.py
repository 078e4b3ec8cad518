"""Views kept by changes, and claims of jobs (inventory L and N)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.bindings import Roles
from covenant.operators.storage import fresh_path
from covenant.operators.views import Memberships, seeded
from covenant.plans.runs import _batch
from covenant.registry import query
from covenant.sources.queue import Queue

_CHANGES = f"""SELECT CAST(k % 25 AS BIGINT) AS collection_id, issuer_id, alert_id AS seq, CASE category WHEN 'error' THEN 'remove' WHEN 'view' THEN 'upgrade' ELSE 'add' END AS action, CAST(alert_id % 3 AS INTEGER) AS rank,
    {_batch('as_of_date')} AS b FROM alert"""
_RANKS = "CASE verification WHEN 'unverified' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END"
#: Members after all changes: those since the last removal count, and upgrades only once there is a member.
_MEMBERS = f"""f AS (SELECT collection_id, issuer_id, CAST(-1 AS BIGINT) AS seq, 'add' AS action, {_RANKS} AS rank FROM membership UNION ALL SELECT collection_id, issuer_id, seq, action, rank FROM ({_CHANGES})),
    g AS (SELECT *, max(CASE WHEN action = 'remove' THEN seq END) OVER key AS gone FROM f WINDOW key AS (PARTITION BY collection_id, issuer_id)),
    a AS (SELECT *, min(CASE WHEN action = 'add' THEN seq END) OVER (PARTITION BY collection_id, issuer_id) AS came FROM g WHERE gone IS NULL OR seq > gone),
    m AS (SELECT collection_id, issuer_id, max(rank) AS rank FROM a WHERE came IS NOT NULL AND seq >= came GROUP BY collection_id, issuer_id)"""


def _kept(r: Roles) -> Memberships:
    """Memberships as they are, then a feed of changes in three batches, one of them replayed."""
    kept = Memberships(r.spark, fresh_path(r.spark, "memberships"))
    rank = F.expr(_RANKS).cast("int")
    kept.apply(r.membership.select("collection_id", "issuer_id", F.lit(0).alias("seq"), F.lit("add").alias("action"), rank.alias("rank")), 0)
    k = F.col("k")
    action = F.when(F.col("category") == "error", "remove").when(F.col("category") == "view", "upgrade").otherwise("add")
    changes = r.alert.select((k % 25).alias("collection_id"), "issuer_id", F.col("alert_id").alias("seq"), action.alias("action"), (F.col("alert_id") % 3).cast("int").alias("rank"), F.expr(_batch("as_of_date")).alias("b"))
    for b in (0, 1, 1, 2):
        kept.apply(changes.where(F.col("b") == b).drop("b"), b + 1)
    return kept


@query("q28_watchlist_changes", "Q28 Q11 S31", f"WITH {_MEMBERS} SELECT collection_id, count(*) AS members, count(*) FILTER (WHERE rank >= 2) AS verified FROM m GROUP BY collection_id")
def watchlist_changes(r: Roles) -> DataFrame:
    """Summaries of collections after a feed of changes, kept up and not counted again; those left without members aside."""
    return _kept(r).summaries.newest().where("members > 0")


@query(
    "q35_member_rows",
    "Q35 Q24",
    f"""WITH {_MEMBERS}, l AS (SELECT issuer_id, max(triggered_at) AS latest, arg_max(severity, (triggered_at, alert_id)) AS severity, count(*) FILTER (WHERE status = 'new') AS fresh FROM alert GROUP BY issuer_id)
    SELECT collection_id, issuer_id, CAST(rank AS INTEGER) AS rank, legal_name, latest, severity, coalesce(fresh, 0) AS fresh FROM m LEFT JOIN issuer USING (issuer_id) LEFT JOIN l USING (issuer_id)""",
)
def member_rows(r: Roles) -> DataFrame:
    """The row of every member after those changes, with its issuer's latest development."""
    newest = F.max_by("severity", F.struct("triggered_at", "alert_id"))
    latest = r.alert.groupBy("issuer_id").agg(F.max("triggered_at").alias("latest"), newest.alias("severity"), F.count_if(F.col("status") == "new").alias("fresh"))
    rows = _kept(r).members.newest().where("present").drop("present")
    told = rows.join(r.issuer.select("issuer_id", "legal_name"), "issuer_id", "left").join(latest, "issuer_id", "left")
    return told.select("collection_id", "issuer_id", "rank", "legal_name", "latest", "severity", F.coalesce("fresh", F.lit(0)).alias("fresh"))


@query(
    "q33_universe_seeding",
    "Q33",
    """WITH p AS (SELECT slug, name, 'research_universe' AS collection_type FROM collection WHERE collection_id % 2 = 0 UNION ALL SELECT 'p-' || p_brand, 'Parts ' || p_type, 'research_universe' FROM part GROUP BY p_brand, p_type),
    n AS (SELECT slug, min(name) AS first FROM p GROUP BY slug)
    SELECT slug, p.name, p.collection_type, CASE WHEN c.slug IS NULL THEN CASE WHEN p.name = first THEN 'created' ELSE 'refused' END WHEN c.name = p.name AND c.collection_type = p.collection_type THEN 'exists' ELSE 'refused' END AS outcome
    FROM p JOIN n USING (slug) LEFT JOIN collection c USING (slug)""",
)
def universe_seeding(r: Roles) -> DataFrame:
    """Universes seeded by slug: those there stay, new ones are created, and one whose slug is another's is refused."""
    universe = F.lit("research_universe").alias("collection_type")
    proposed = r.collection.where("collection_id % 2 = 0").select("slug", "name", universe).unionByName(
        r.table("part").select(F.concat(F.lit("p-"), "p_brand").alias("slug"), F.concat(F.lit("Parts "), "p_type").alias("name"), universe).distinct()
    )
    return seeded(r.collection, proposed)


@query(
    "x11_claims",
    "X11 X12",
    """WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM document)
    SELECT doc_id, CASE WHEN n > 65 THEN 'pending' WHEN n <= 20 AND n % 2 = 0 THEN 'done' WHEN n <= 35 THEN 'failed' ELSE 'done' END AS status,
        CASE WHEN n > 65 THEN NULL WHEN n <= 20 AND n % 2 = 0 THEN 'ann' WHEN n <= 35 THEN 'dan' ELSE 'eve' END AS worker, CASE WHEN n > 65 THEN 0 WHEN n <= 20 AND n % 2 = 0 THEN 1 WHEN n <= 40 THEN 3 ELSE 1 END AS attempts FROM d""",
)
def claims(r: Roles) -> DataFrame:
    """Documents claimed by five workers in turn, two of which stop: leases that run out go to the next in the order of the queue, and a job fails with its third."""
    queue = Queue(r.spark, fresh_path(r.spark, "queue"))
    jobs = r.document.select(F.col("doc_id").alias("job"), F.col("doc_id").alias("place"))
    for _ in range(2):  # every step is replayed
        queue.submit(jobs, 0)
        first = queue.claim("ann", 0, 20, 1)
        queue.claim("bob", 1, 20, 2)
    even = r.document.select("doc_id").orderBy("doc_id").limit(20).select("doc_id", F.row_number().over(_by_id()).alias("n")).where("n % 2 = 0").select(F.col("doc_id").alias("job"))
    queue.done("ann", first.join(even, "job", "left_semi"), 3)
    queue.claim("cy", 1000, 25, 4)
    queue.claim("dan", 2000, 30, 5)
    last = queue.claim("eve", 3000, 30, 6)
    queue.done("ann", jobs, 7)  # its other leases are others' by now
    queue.done("eve", last, 8)
    return queue.jobs().select(F.col("job").alias("doc_id"), "status", "worker", "attempts")


def _by_id():
    from pyspark.sql.window import Window

    return Window.orderBy("doc_id")
