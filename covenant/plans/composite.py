"""The read API: screens, briefs, timelines and detail pages (inventory N)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.bindings import Roles
from covenant.functions.dates import previous_business_day, research_day
from covenant.operators.relational import first_by, page, waterfall, where_all
from covenant.operators.storage import fresh_path
from covenant.registry import query
from covenant.sources.store import Store

_RANK = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"


def _rank():
    return F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)


@query(
    "q01_credit_universe",
    "Q01 J01 F11 J11 A01 O01",
    """SELECT security_id, legal_name, instrument_type, amount, maturity, latest, count(*) OVER () AS total FROM security JOIN issuer USING (issuer_id)
    LEFT JOIN (SELECT category, max(as_of_date) AS latest FROM alert GROUP BY category) b ON b.category = CASE instrument_type WHEN 'bond' THEN 'error' WHEN 'term_loan' THEN 'view' ELSE 'click' END
    WHERE issuer_id IN (SELECT issuer_id FROM membership) AND legal_name ILIKE '%0%' AND amount > 50000 ORDER BY amount DESC NULLS LAST, security_id LIMIT 100""",
)
def credit_universe(r: Roles) -> DataFrame:
    """A screen: filters, members of collections, a benchmark's latest value, a total and a page."""
    members = r.membership
    found = where_all(r.security.join(r.issuer, "issuer_id"), F.ilike("legal_name", F.lit("%0%")), F.col("amount") > 50000, None).join(members, "issuer_id", "left_semi")
    total = found.agg(F.count("*").alias("total"))
    kind = F.when(F.col("instrument_type") == "bond", "error").when(F.col("instrument_type") == "term_loan", "view").otherwise("click")
    latest = r.alert.groupBy("category").agg(F.max("as_of_date").alias("latest"))
    shown = page(found, "amount", True, "security_id", ("amount", "maturity"), 0, 100).withColumn("category", kind)
    return shown.join(F.broadcast(latest), "category", "left").crossJoin(F.broadcast(total)).select("security_id", "legal_name", "instrument_type", "amount", "maturity", "latest", "total")


@query(
    "q02_issuer_detail",
    "Q02 A16 U05",
    """SELECT issuer_id, legal_name, (SELECT count(*) FROM security s WHERE s.issuer_id = i.issuer_id) AS securities, (SELECT count(*) FROM alert a WHERE a.issuer_id = i.issuer_id) AS alerts,
    (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT provider || '=' || count(*) OVER (PARTITION BY provider) AS p FROM alert a WHERE a.issuer_id = i.issuer_id)) AS sources FROM issuer i WHERE issuer_id IN (7, 42)""",
)
def issuer_detail(r: Roles) -> DataFrame:
    some = F.col("issuer_id").isin(7, 42)
    held = r.security.where(some).groupBy("issuer_id").agg(F.count("*").alias("securities"))
    by = r.alert.where(some).groupBy("issuer_id", "provider").agg(F.count("*").alias("n"))
    seen = by.groupBy("issuer_id").agg(F.sum("n").alias("alerts"), F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "provider", F.col("n").cast("string")))), ",").alias("sources"))
    return r.issuer.where(some).join(held, "issuer_id", "left").join(seen, "issuer_id", "left").select("issuer_id", "legal_name", F.coalesce("securities", F.lit(0)).alias("securities"), F.coalesce("alerts", F.lit(0)).alias("alerts"), "sources")


@query(
    "q04_alerts_page",
    "Q04 J16 F01 O02 J15",
    """SELECT alert_id, severity, triggered_at, coalesce(legal_name, 'Unknown issuer') AS issuer, names FROM (SELECT * FROM alert WHERE status = 'new' AND severity <> 'low' AND issuer_id IN (SELECT issuer_id FROM membership WHERE collection_id % 5 = 0) ORDER BY triggered_at DESC, alert_id LIMIT 50)
    LEFT JOIN issuer USING (issuer_id) LEFT JOIN (SELECT issuer_id, string_agg(name, ',' ORDER BY name) AS names FROM membership JOIN collection USING (collection_id) GROUP BY issuer_id) USING (issuer_id)""",
)
def alerts_page(r: Roles) -> DataFrame:
    watched = r.membership.where("collection_id % 5 = 0")
    p = r.alert.where("status = 'new' and severity <> 'low'").join(watched, "issuer_id", "left_semi").orderBy(F.desc("triggered_at"), "alert_id").limit(50)
    names = r.membership.join(F.broadcast(r.collection), "collection_id").join(p.select("issuer_id"), "issuer_id", "left_semi").groupBy("issuer_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))
    return p.join(r.issuer.select("issuer_id", "legal_name"), "issuer_id", "left").join(names, "issuer_id", "left").select("alert_id", "severity", "triggered_at", F.coalesce("legal_name", F.lit("Unknown issuer")).alias("issuer"), "names")


@query(
    "q07_morning_brief",
    "Q07 D06 O11 D07 A17 A18 A19 O09 O10 W13",
    f"""WITH e AS (SELECT *, CAST(triggered_at - INTERVAL 5 HOUR AS DATE) AS day FROM alert), l AS (SELECT max(day) AS latest FROM e),
    c AS (SELECT latest, latest - CASE dayofweek(latest) WHEN 1 THEN 3 WHEN 0 THEN 2 ELSE 1 END AS preceding FROM l),
    g AS (SELECT issuer_id, min({_RANK}) AS worst, max(triggered_at) AS last_at, count(*) AS n, count(*) FILTER (WHERE severity = 'high') AS high FROM e, c WHERE day > preceding AND day <= latest GROUP BY issuer_id)
    SELECT issuer_id, coalesce(legal_name, 'Unknown issuer') AS issuer, worst, last_at, n, high FROM g LEFT JOIN issuer USING (issuer_id) ORDER BY worst, last_at DESC, issuer_id LIMIT 100""",
)
def morning_brief(r: Roles) -> DataFrame:
    """Issuers with developments of the research cycle, worst and latest first."""
    e = r.alert.withColumn("day", research_day(F.col("triggered_at")))
    cycle = e.agg(F.max("day").alias("latest")).select("latest", previous_business_day(F.col("latest")).alias("preceding"))
    new = e.join(F.broadcast(cycle), (F.col("day") > F.col("preceding")) & (F.col("day") <= F.col("latest")))
    g = new.groupBy("issuer_id").agg(F.min(_rank()).alias("worst"), F.max("triggered_at").alias("last_at"), F.count("*").alias("n"), F.count_if(F.col("severity") == "high").alias("high"))
    named = g.join(r.issuer.select("issuer_id", "legal_name"), "issuer_id", "left")
    return named.orderBy("worst", F.desc("last_at"), "issuer_id").limit(100).select("issuer_id", F.coalesce("legal_name", F.lit("Unknown issuer")).alias("issuer"), "worst", "last_at", "n", "high")


@query(
    "q09_timeline",
    "Q09 A15 F17",
    f"""SELECT issuer_id, as_of_date, category, count(*) AS n, min({_RANK}) AS worst FROM alert WHERE status <> 'dismissed' AND is_subject IS NOT FALSE GROUP BY issuer_id, as_of_date, category""",
)
def timeline(r: Roles) -> DataFrame:
    """An issuer's days, of alerts that count."""
    counts = r.alert.where((F.col("status") != "dismissed") & ~F.col("is_subject").eqNullSafe(False))
    return counts.groupBy("issuer_id", "as_of_date", "category").agg(F.count("*").alias("n"), F.min(_rank()).alias("worst"))


@query(
    "q10_watchlists",
    "Q10 A20",
    """SELECT collection_id, name, count(DISTINCT m.issuer_id) AS members, count(a.alert_id) FILTER (WHERE status = 'new') AS fresh, count(a.alert_id) FILTER (WHERE status = 'new' AND severity = 'high') AS urgent, max(triggered_at) AS latest
    FROM collection JOIN membership m USING (collection_id) LEFT JOIN alert a ON a.issuer_id = m.issuer_id WHERE collection_type = 'watchlist' GROUP BY collection_id, name""",
)
def watchlists(r: Roles) -> DataFrame:
    """Each watchlist with its members and their alerts; alerts are summed by issuer before the join."""
    by_issuer = r.alert.groupBy("issuer_id").agg(F.count_if(F.col("status") == "new").alias("f"), F.count_if((F.col("status") == "new") & (F.col("severity") == "high")).alias("u"), F.max("triggered_at").alias("t"))
    m = r.membership.join(F.broadcast(r.collection.where("collection_type = 'watchlist'")), "collection_id").join(by_issuer, "issuer_id", "left")
    return m.groupBy("collection_id", "name").agg(F.count("*").alias("members"), F.coalesce(F.sum("f"), F.lit(0)).alias("fresh"), F.coalesce(F.sum("u"), F.lit(0)).alias("urgent"), F.max("t").alias("latest"))


@query("q12_universes", "Q12 A07", "SELECT collection_id, slug, count(issuer_id) AS members, count(*) FILTER (WHERE verification = 'verified') AS verified FROM collection LEFT JOIN membership USING (collection_id) WHERE collection_type <> 'watchlist' GROUP BY collection_id, slug")
def universes(r: Roles) -> DataFrame:
    counts = r.membership.groupBy("collection_id").agg(F.count("*").alias("members"), F.count_if(F.col("verification") == "verified").alias("verified"))
    return r.collection.where("collection_type <> 'watchlist'").join(counts, "collection_id", "left").select("collection_id", "slug", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("members", "verified")))


@query(
    "q13_market_context",
    "Q13 W03 D02",
    "SELECT category AS series, day, value FROM (SELECT category, as_of_date AS day, max(confidence) AS value, row_number() OVER (PARTITION BY category ORDER BY as_of_date DESC) AS n FROM alert WHERE category IN ('view', 'click') GROUP BY category, as_of_date) WHERE n = 1",
)
def market_context(r: Roles) -> DataFrame:
    s = r.alert.where(F.col("category").isin("view", "click")).groupBy(F.col("category").alias("series"), F.col("as_of_date").alias("day")).agg(F.max("confidence").alias("value"))
    return first_by(s, ["series"], F.desc("day"))


@query("q16_filing_search", "Q16", "SELECT security_id, priority, maturity FROM security WHERE priority ILIKE '%high%' ORDER BY maturity DESC NULLS LAST, security_id LIMIT 25")
def filing_search(r: Roles) -> DataFrame:
    return r.security.where(F.ilike("priority", F.lit("%high%"))).orderBy(F.col("maturity").desc_nulls_last(), "security_id").limit(25).select("security_id", "priority", "maturity")


@query(
    "q27_capital_demo",
    "Q27 Q26",
    """WITH l AS (SELECT collection_id, rank_order, CAST(100 * rank_order + 10 * collection_id AS DECIMAL(20,4)) AS amount FROM collection, range(1, 9) t(rank_order)),
    c AS (SELECT *, CAST(1500 + 20 * collection_id AS DECIMAL(20,4)) AS value, CAST(sum(amount) OVER (PARTITION BY collection_id ORDER BY rank_order) AS DECIMAL(20,4)) AS cumulative FROM l)
    SELECT collection_id, CAST(rank_order AS INTEGER) AS rank_order, amount, CAST(round(value / cumulative, 2) AS DECIMAL(18,2)) AS coverage, CAST(round(greatest(0::DECIMAL(20,4), least(amount, value - (cumulative - amount))) * 100 / amount, 2) AS DECIMAL(18,2)) AS recovery FROM c""",
)
def capital_demo(r: Roles) -> DataFrame:
    """Eight made-up tranches for each collection under a value that pays a part of them, seeded twice and there once."""
    rows = r.collection.select(F.col("collection_id").alias("issuer_id"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("rank_order"))
    rows = rows.select("issuer_id", "rank_order", (100 * F.col("rank_order") + 10 * F.col("issuer_id")).cast("decimal(20,4)").alias("amount"))
    store = Store(r.spark, fresh_path(r.spark, "tranches"), rows.schema, ["issuer_id", "rank_order"])
    for batch in (0, 1):
        store.append(rows.join(store.newest(before=batch).select("issuer_id", "rank_order"), ["issuer_id", "rank_order"], "left_anti"), batch)
    value = (1500 + 20 * F.col("issuer_id")).cast("decimal(20,4)")
    return waterfall(store.read().drop("_batch"), value).select(F.col("issuer_id").alias("collection_id"), "rank_order", "amount", "coverage", "recovery")


@query("q31_notes", "Q31 Q30", "SELECT security_id, legal_name, maturity FROM security JOIN issuer USING (issuer_id) WHERE instrument_type = 'revolver' ORDER BY maturity DESC, security_id LIMIT 50")
def notes(r: Roles) -> DataFrame:
    top = r.security.where("instrument_type = 'revolver'").orderBy(F.desc("maturity"), "security_id").limit(50)
    return top.join(r.issuer, "issuer_id").select("security_id", "legal_name", "maturity")
