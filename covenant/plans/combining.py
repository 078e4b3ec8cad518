"""Set operations, feeds, tiered search and membership differences (inventory G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.bindings import Roles
from covenant.operators.classification import best_status, evidence_slugs
from covenant.operators.relational import membership_actions
from covenant.operators.search import tiered
from covenant.plans.aggregating import _SLUGS
from covenant.registry import query


@query("u01_union_distinct", "U01 U04", "SELECT issuer_id FROM security WHERE instrument_type = 'bond' UNION SELECT issuer_id FROM alert UNION SELECT issuer_id FROM membership WHERE collection_id = 1")
def union_distinct(r: Roles) -> DataFrame:
    ids = [r.security.where("instrument_type = 'bond'"), r.alert, r.membership.where("collection_id = 1")]
    return ids[0].select("issuer_id").union(ids[1].select("issuer_id")).union(ids[2].select("issuer_id")).distinct()


@query("u02_except", "U02", "SELECT issuer_id FROM issuer EXCEPT SELECT issuer_id FROM security")
def except_referenced(r: Roles) -> DataFrame:
    return r.issuer.select("issuer_id").exceptAll(r.security.select("issuer_id").distinct())


@query(
    "u05_activity_feed",
    "U05",
    "SELECT 'security' AS kind, issuer_id, security_id AS id, CAST(maturity AS DATE) AS occurred_on FROM security UNION ALL SELECT 'alert', issuer_id, alert_id, as_of_date FROM alert",
)
def activity_feed(r: Roles) -> DataFrame:
    s = r.security.select(F.lit("security").alias("kind"), "issuer_id", F.col("security_id").alias("id"), F.col("maturity").alias("occurred_on"))
    a = r.alert.select(F.lit("alert").alias("kind"), "issuer_id", F.col("alert_id").alias("id"), F.col("as_of_date").alias("occurred_on"))
    return s.unionByName(a)


_TRIGRAMS = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(
    "u06_tiered_search",
    "O14",
    f"""WITH n AS (SELECT 'issuer' AS kind, issuer_id AS id, legal_name AS name FROM issuer UNION ALL SELECT 'part', p_partkey, p_name FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier),
    q AS (SELECT 'small ring' AS q), t AS (SELECT kind, id, name, {_TRIGRAMS.format(x="name")} AS a, {_TRIGRAMS.format(x="q")} AS b FROM n, q),
    m AS (SELECT kind, id, name, CASE WHEN lower(name) = 'small ring' THEN 3 WHEN lower(name) LIKE 'small ring%' THEN 2 ELSE 1 END AS tier,
        len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) AS similarity FROM t)
    SELECT kind, id, name, tier FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY tier DESC, similarity DESC, id) AS n FROM m WHERE tier > 1 OR similarity > 0.3) WHERE n <= 5""",
)
def tiered_search(r: Roles) -> DataFrame:
    """Exact names, then those that begin so, then those alike by trigrams: five of each kind."""
    sources = {
        "issuer": r.issuer.select(F.col("issuer_id").alias("id"), F.col("legal_name").alias("name")),
        "part": r.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")),
        "supplier": r.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
    }
    return tiered(sources, "small ring", 5).select("kind", "id", "name", "tier")


@query(
    "u08_membership_diff",
    "U08 U09 Q23 S30 S31 A28",
    f"""WITH {_SLUGS}, e AS (SELECT issuer_id, slug, max(rank) AS rank FROM s GROUP BY issuer_id, slug),
    c AS (SELECT issuer_id, 'chapter-11' AS slug, CASE verification WHEN 'unverified' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END AS rank, issuer_id % 11 = 0 AS by_hand FROM membership)
    SELECT issuer_id, slug, CASE WHEN by_hand THEN 'keep' WHEN c.rank IS NULL THEN 'add' WHEN e.rank IS NULL THEN 'remove' WHEN e.rank > c.rank THEN 'upgrade' WHEN e.rank < c.rank THEN 'downgrade' ELSE 'keep' END AS action
    FROM e FULL JOIN c USING (issuer_id, slug)""".replace("e AS (SELECT issuer_id, slug, max", "x AS (SELECT issuer_id, slug, max").replace("FROM e FULL", "FROM x AS e FULL"),
)
def membership_diff(r: Roles) -> DataFrame:
    """What turns current memberships into those the evidence supports; those by hand stay."""
    expected = best_status(evidence_slugs(r.alert)).select("issuer_id", "slug", "rank")
    rank = F.when(F.col("verification") == "unverified", 0).when(F.col("verification") == "partial", 1).otherwise(2)
    current = r.membership.select("issuer_id", F.lit("chapter-11").alias("slug"), rank.alias("rank"), (F.col("issuer_id") % 11 == 0).alias("by_hand"))
    return membership_actions(expected, current, ["issuer_id", "slug"]).select("issuer_id", "slug", "action")
