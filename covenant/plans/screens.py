"""Screens in full: the universe page, issuer pages with their feed, alert pages with a total, the brief's details (inventory N)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covenant.bindings import Roles
from covenant.functions.dates import freshness, previous_business_day, research_day
from covenant.operators.relational import page
from covenant.plans.predicates import _POLICY_SQL, _decided
from covenant.registry import query

NOW = "2024-01-31 00:00:00"
#: Which series a kind of instrument is priced against. Fixed values.
SERIES = {"bond": "error", "term_loan": "view", "revolver": "click"}
_SERIES_SQL = "CASE instrument_type WHEN 'bond' THEN 'error' WHEN 'term_loan' THEN 'view' WHEN 'revolver' THEN 'click' END"
_AGE = f"epoch(TIMESTAMP '{NOW}' - seen) / 3600.0"
_FRESH = f"CASE WHEN {_AGE} <= CASE provider WHEN 'filings' THEN 24 ELSE 1 END THEN 'live' WHEN {_AGE} <= CASE provider WHEN 'filings' THEN 168 ELSE 24 END THEN 'cached' ELSE 'stale' END"
_SEEN = """seen AS (SELECT issuer_id, max(triggered_at) AS seen, arg_max(provider, (triggered_at, alert_id)) AS provider FROM alert GROUP BY issuer_id)"""


@query(
    "q01_universe_screen",
    "Q01 J17 D02 F18 F20",
    f"""{_POLICY_SQL}, {_SEEN}, b AS (SELECT category, max(as_of_date) AS rated_on, arg_max(confidence, (as_of_date, alert_id)) AS rate FROM alert GROUP BY category),
    f AS (SELECT s.*, legal_name, sector, count(*) OVER () AS total FROM security s JOIN issuer USING (issuer_id) WHERE issuer_id IN (SELECT issuer_id FROM membership WHERE collection_id % 2 = 0) AND amount > 50000 AND instrument_type IS NOT NULL),
    p AS (SELECT * FROM f ORDER BY maturity DESC NULLS LAST, security_id LIMIT 200 OFFSET 50)
    SELECT security_id, legal_name, sector, instrument_type, amount, maturity, shown AS reason, provider, {_FRESH} AS freshness, rate, rated_on, total
    FROM p JOIN d USING (issuer_id) LEFT JOIN seen USING (issuer_id) LEFT JOIN b ON b.category = {_SERIES_SQL} WHERE shown IN ('public', 'permitted')""",
)
def universe_screen(r: Roles) -> DataFrame:
    """The second page of a screen of the universe: members of collections, the total of all, rows that policy denies dropped after the total,
    each with how fresh its source is and its benchmark's latest rate."""
    members = r.membership.where("collection_id % 2 = 0")
    found = r.security.where("amount > 50000 AND instrument_type IS NOT NULL").join(members, "issuer_id", "left_semi").join(r.issuer.select("issuer_id", "legal_name", "sector"), "issuer_id")
    total = found.agg(F.count("*").alias("total"))
    shown = page(found, "maturity", True, "security_id", ("maturity", "amount"), 50, 200)
    decided = shown.join(_decided(r).select("issuer_id", "shown.allowed", "shown.reason"), "issuer_id").where("allowed")
    newest = F.max_by(F.struct("triggered_at", "provider"), F.struct("triggered_at", "alert_id"))
    seen = r.alert.join(shown.select("issuer_id"), "issuer_id", "left_semi").groupBy("issuer_id").agg(newest.alias("s")).select("issuer_id", F.col("s.triggered_at").alias("seen"), "s.provider")
    rates = r.alert.groupBy("category").agg(F.max("as_of_date").alias("rated_on"), F.max_by("confidence", F.struct("as_of_date", "alert_id")).alias("rate"))
    series = F
    for kind, name in SERIES.items():
        series = series.when(F.col("instrument_type") == kind, name)
    told = decided.join(seen, "issuer_id", "left").withColumn("category", series).join(F.broadcast(rates), "category", "left").crossJoin(F.broadcast(total))
    fresh = freshness(F.col("provider"), F.col("seen").cast("timestamp"), F.lit(NOW).cast("timestamp"))
    return told.select("security_id", "legal_name", "sector", "instrument_type", "amount", "maturity", "reason", "provider", fresh.alias("freshness"), "rate", "rated_on", "total")


_FEED = "SELECT issuer_id, 'security' AS kind, security_id AS id, maturity AS occurred_on FROM security UNION ALL SELECT issuer_id, 'alert', alert_id, as_of_date FROM alert"


@query(
    "q02_issuer_pages",
    "Q02 A16 U05 O12",
    f"""WITH feed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY issuer_id ORDER BY occurred_on DESC, kind, id) AS n FROM ({_FEED})) WHERE n <= 15),
    a AS (SELECT issuer_id, string_agg(kind || ':' || id, ',' ORDER BY n) AS activity FROM feed GROUP BY issuer_id),
    s AS (SELECT issuer_id, count(*) AS securities, sum(amount) AS owed FROM security GROUP BY issuer_id),
    p AS (SELECT issuer_id, string_agg(provider || '=' || n || '@' || strftime(latest, '%Y-%m-%d'), ',' ORDER BY provider) AS sources, CAST(sum(n) AS BIGINT) AS alerts FROM (SELECT issuer_id, provider, count(*) AS n, max(triggered_at) AS latest FROM alert GROUP BY ALL) GROUP BY issuer_id),
    l AS (SELECT issuer_id, count(*) AS layers FROM layer GROUP BY issuer_id)
    SELECT issuer_id, legal_name, coalesce(securities, 0) AS securities, CAST(owed AS DOUBLE) AS owed, coalesce(alerts, 0) AS alerts, sources, coalesce(layers, 0) AS layers, activity
    FROM issuer LEFT JOIN s USING (issuer_id) LEFT JOIN p USING (issuer_id) LEFT JOIN l USING (issuer_id) LEFT JOIN a USING (issuer_id)""",
)
def issuer_pages(r: Roles) -> DataFrame:
    """The page of every issuer: what it owes, its layers, its sources with their counts and latest day, and its fifteen latest activities."""
    feed = r.security.select("issuer_id", F.lit("security").alias("kind"), F.col("security_id").alias("id"), F.col("maturity").alias("occurred_on")).unionByName(
        r.alert.select("issuer_id", F.lit("alert").alias("kind"), F.col("alert_id").alias("id"), F.col("as_of_date").alias("occurred_on"))
    )
    n = F.row_number().over(Window.partitionBy("issuer_id").orderBy(F.desc("occurred_on"), "kind", "id"))
    latest = feed.withColumn("n", n).where("n <= 15").groupBy("issuer_id").agg(F.sort_array(F.collect_list(F.struct("n", F.concat_ws(":", "kind", F.col("id").cast("string")).alias("what")))).alias("a"))
    activity = latest.select("issuer_id", F.array_join("a.what", ",").alias("activity"))
    held = r.security.groupBy("issuer_id").agg(F.count("*").alias("securities"), F.sum("amount").cast("double").alias("owed"))
    by = r.alert.groupBy("issuer_id", "provider").agg(F.count("*").alias("n"), F.max("triggered_at").alias("latest"))
    source = F.concat("provider", F.lit("="), F.col("n").cast("string"), F.lit("@"), F.date_format("latest", "yyyy-MM-dd"))
    sources = by.groupBy("issuer_id").agg(F.array_join(F.sort_array(F.collect_list(source)), ",").alias("sources"), F.sum("n").alias("alerts"))
    layers = r.layer.groupBy("issuer_id").agg(F.count("*").alias("layers"))
    out = r.issuer.select("issuer_id", "legal_name")
    for part in (held, sources, layers, activity):
        out = out.join(part, "issuer_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("issuer_id", "legal_name", none("securities"), "owed", none("alerts"), "sources", none("layers"), "activity")


@query(
    "q04_alert_pages",
    "Q04 A01",
    """WITH f AS (SELECT alert.*, count(*) OVER () AS total FROM alert WHERE status = 'new' AND severity <> 'low' AND as_of_date >= DATE '2024-01-05' AND as_of_date <= DATE '2024-01-25' AND issuer_id IN (SELECT issuer_id FROM membership JOIN collection USING (collection_id) WHERE collection_type = 'watchlist')),
    p AS (SELECT * FROM f ORDER BY triggered_at DESC, alert_id LIMIT 40 OFFSET 20)
    SELECT alert_id, severity, triggered_at, coalesce(legal_name, 'Unknown issuer') AS issuer, names, total FROM p LEFT JOIN issuer USING (issuer_id) LEFT JOIN (SELECT issuer_id, string_agg(name, ',' ORDER BY name) AS names FROM membership JOIN collection USING (collection_id) GROUP BY issuer_id) USING (issuer_id)""",
)
def alert_pages(r: Roles) -> DataFrame:
    """The second page of alerts under all filters, the total of all pages beside each, with the lists their issuers are on."""
    watched = r.membership.join(F.broadcast(r.collection.where("collection_type = 'watchlist'")), "collection_id", "left_semi")
    found = r.alert.where("status = 'new' AND severity <> 'low' AND as_of_date BETWEEN date '2024-01-05' AND date '2024-01-25'").join(watched, "issuer_id", "left_semi")
    total = found.agg(F.count("*").alias("total"))
    p = found.orderBy(F.desc("triggered_at"), "alert_id").offset(20).limit(40)
    names = r.membership.join(p.select("issuer_id"), "issuer_id", "left_semi").join(F.broadcast(r.collection), "collection_id").groupBy("issuer_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))
    told = p.join(r.issuer.select("issuer_id", "legal_name"), "issuer_id", "left").join(names, "issuer_id", "left").crossJoin(F.broadcast(total))
    return told.select("alert_id", "severity", "triggered_at", F.coalesce("legal_name", F.lit("Unknown issuer")).alias("issuer"), "names", "total")


@query(
    "q07_brief_details",
    "Q07 A18 A19",
    """WITH e AS (SELECT *, CAST(triggered_at - INTERVAL 5 HOUR AS DATE) AS day FROM alert), l AS (SELECT max(day) AS latest FROM e), c AS (SELECT latest, latest - CASE dayofweek(latest) WHEN 1 THEN 3 WHEN 0 THEN 2 ELSE 1 END AS preceding FROM l),
    n AS (SELECT e.*, as_of_date > preceding AND as_of_date <= latest AS fresh FROM e, c WHERE day > preceding AND day <= latest)
    SELECT latest, CAST(preceding AS DATE) AS preceding, count(DISTINCT issuer_id) FILTER (WHERE fresh) AS issuers, count(*) FILTER (WHERE fresh AND severity = 'high') AS high, count(*) FILTER (WHERE fresh AND severity = 'medium') AS medium, count(*) FILTER (WHERE fresh AND severity = 'low') AS low,
        count(DISTINCT issuer_id) FILTER (WHERE NOT fresh) AS historical_issuers, (SELECT count(*) FROM collection WHERE collection_type <> 'watchlist') AS universes, (SELECT count(DISTINCT issuer_id) FROM membership) AS monitored,
        count(*) FILTER (WHERE provider = 'filings') AS filings, count(*) FILTER (WHERE provider = 'dockets') AS court_events, count(*) = 0 AS no_changes
    FROM c LEFT JOIN n ON true GROUP BY latest, preceding""",
)
def brief_details(r: Roles) -> DataFrame:
    """The brief's one row: the cycle's days, new developments by severity, issuers with older ones, and what was monitored."""
    e = r.alert.withColumn("day", research_day(F.col("triggered_at")))
    cycle = e.agg(F.max("day").alias("latest")).select("latest", previous_business_day(F.col("latest")).alias("preceding"))
    inside = e.join(F.broadcast(cycle), (F.col("day") > F.col("preceding")) & (F.col("day") <= F.col("latest")))
    fresh = (F.col("as_of_date") > F.col("preceding")) & (F.col("as_of_date") <= F.col("latest"))
    counts = inside.agg(
        F.countDistinct(F.when(fresh, F.col("issuer_id"))).alias("issuers"), *(F.count_if(fresh & (F.col("severity") == s)).alias(s) for s in ("high", "medium", "low")),
        F.countDistinct(F.when(~fresh, F.col("issuer_id"))).alias("historical_issuers"), F.count_if(F.col("provider") == "filings").alias("filings"),
        F.count_if(F.col("provider") == "dockets").alias("court_events"), (F.count("*") == 0).alias("no_changes"),
    )
    universes = r.collection.where("collection_type <> 'watchlist'").agg(F.count("*").alias("universes"))
    monitored = r.membership.agg(F.countDistinct("issuer_id").alias("monitored"))
    one = cycle.crossJoin(counts).crossJoin(universes).crossJoin(monitored)
    return one.select("latest", "preceding", "issuers", "high", "medium", "low", "historical_issuers", "universes", "monitored", "filings", "court_events", "no_changes")
