"""Filters and projections (inventory B)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.bindings import Roles
from covenant.operators import policy
from covenant.operators.relational import first_by, page, where_all
from covenant.registry import query


@query(
    "f01_optional_filters",
    "F01 F02 F27 O01 A01",
    """SELECT security_id, issuer_id, instrument_type, amount, maturity, (SELECT count(*) FROM security WHERE instrument_type = 'bond' AND amount >= 100000) AS total
    FROM security WHERE instrument_type = 'bond' AND amount >= 100000 ORDER BY amount DESC NULLS LAST, security_id LIMIT 50 OFFSET 100""",
)
def optional_filters(r: Roles) -> DataFrame:
    """Optional conjuncts, a whitelisted sort, a page, and the total before it."""
    found = where_all(r.security, F.col("instrument_type") == "bond", F.col("amount") >= 100000, None)
    total = found.agg(F.count("*").alias("total"))
    shown = page(found, "amount", True, "security_id", ("amount", "maturity", "security_id"), 100, 50)
    return shown.crossJoin(F.broadcast(total)).select("security_id", "issuer_id", "instrument_type", "amount", "maturity", "total")


@query("f03_by_foreign_key", "F03 S22 S23", "SELECT security_id, issuer_id, amount FROM security WHERE issuer_id = 7")
def by_foreign_key(r: Roles) -> DataFrame:
    return r.security.where("issuer_id = 7").select("security_id", "issuer_id", "amount")


@query("f04_in_list", "F04", "SELECT alert_id, category FROM alert WHERE category IN ('error', 'purchase')")
def in_list(r: Roles) -> DataFrame:
    return r.alert.where(F.col("category").isin("error", "purchase")).select("alert_id", "category")


@query("f05_in_key_set", "F05 J11", "SELECT issuer_id, legal_name FROM issuer WHERE issuer_id IN (SELECT issuer_id FROM membership WHERE collection_id = 3 AND verification = 'verified')")
def in_key_set(r: Roles) -> DataFrame:
    members = r.membership.where("collection_id = 3 and verification = 'verified'")
    return r.issuer.join(members, "issuer_id", "left_semi").select("issuer_id", "legal_name")


@query("f06_not_in_seen", "F06 U02", "SELECT issuer_id, legal_name FROM issuer WHERE issuer_id NOT IN (SELECT issuer_id FROM security WHERE instrument_type = 'bond' AND issuer_id IS NOT NULL)")
def not_in_seen(r: Roles) -> DataFrame:
    return r.issuer.join(r.security.where("instrument_type = 'bond'"), "issuer_id", "left_anti").select("issuer_id", "legal_name")


@query("f07_half_open_range", "F07", "SELECT security_id, maturity FROM security WHERE maturity > DATE '1997-01-01' AND maturity <= DATE '1997-03-31'")
def half_open_range(r: Roles) -> DataFrame:
    d = F.col("maturity")
    return r.security.where((d > F.lit("1997-01-01").cast("date")) & (d <= F.lit("1997-03-31").cast("date"))).select("security_id", "maturity")


@query("f10_null_tests", "F10", "SELECT CAST(count(*) FILTER (WHERE is_subject IS NULL) AS BIGINT) AS unknown, CAST(count(*) FILTER (WHERE is_subject IS NOT NULL) AS BIGINT) AS known FROM alert")
def null_tests(r: Roles) -> DataFrame:
    s = F.col("is_subject")
    return r.alert.agg(F.count_if(s.isNull()).alias("unknown"), F.count_if(s.isNotNull()).alias("known"))


@query("f11_contains_any_case", "F11", "SELECT p_partkey AS part_id, p_name AS name FROM part WHERE p_name ILIKE '%RING%' OR p_type ILIKE '%econ%'")
def contains_any_case(r: Roles) -> DataFrame:
    return r.table("part").where(F.ilike("p_name", F.lit("%RING%")) | F.ilike("p_type", F.lit("%econ%"))).select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("name"))


@query("f12_prefix_any_case", "F12", "SELECT issuer_id, legal_name FROM issuer WHERE legal_name ILIKE 'customer#00000001%'")
def prefix_any_case(r: Roles) -> DataFrame:
    return r.issuer.where(F.ilike("legal_name", F.lit("customer#00000001%"))).select("issuer_id", "legal_name")


@query(
    "f13_equality_chain",
    "F13",
    "SELECT issuer_id, legal_name FROM issuer WHERE lower(legal_name) = 'customer#000000011' OR lower(sector) = 'building' OR lower(country) = 'nation_7'",
)
def equality_chain(r: Roles) -> DataFrame:
    q = (F.lower("legal_name") == "customer#000000011") | (F.lower("sector") == "building") | (F.lower("country") == "nation_7")
    return r.issuer.where(q).select("issuer_id", "legal_name")


@query(
    "f14_or_across_outer_joins",
    "F14 J10",
    """SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem l
    LEFT JOIN (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F') o ON l.l_orderkey = o.o_orderkey
    LEFT JOIN (SELECT p_partkey, p_size FROM part WHERE p_size < 25) p ON l.l_partkey = p.p_partkey
    WHERE (o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01') OR (p_size >= 10 AND p_size < 20)""",
)
def or_across_outer_joins(r: Roles) -> DataFrame:
    o = r.table("orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    p = r.table("part").where("p_size < 25").select("p_partkey", "p_size")
    joined = r.table("lineitem").select("l_orderkey", "l_partkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
    q = "(o_orderdate >= timestamp_ntz '1996-01-01' and o_orderdate < timestamp_ntz '1997-01-01') or (p_size >= 10 and p_size < 20)"
    return joined.where(q).agg(F.count("*").alias("n"))


@query(
    "f15_effective_dated",
    "F15 W03",
    """SELECT issuer_id, security_id, maturity FROM (SELECT *, row_number() OVER (PARTITION BY issuer_id ORDER BY maturity DESC, security_id) AS n FROM security WHERE maturity <= DATE '1997-06-30') WHERE n = 1""",
)
def effective_dated(r: Roles) -> DataFrame:
    valid = r.security.where("maturity <= date '1997-06-30'")
    return first_by(valid, ["issuer_id"], F.desc("maturity"), F.asc("security_id")).select("issuer_id", "security_id", "maturity")


@query("f16_flag_filter", "F16 F28", "SELECT collection_id, name FROM collection WHERE NOT collection_type = 'watchlist'")
def flag_filter(r: Roles) -> DataFrame:
    return r.collection.where(F.col("collection_type") != "watchlist").select("collection_id", "name")


@query("f17_three_valued", "F17 F35", "SELECT alert_id, is_subject FROM alert WHERE status <> 'dismissed' AND is_subject IS NOT FALSE")
def three_valued(r: Roles) -> DataFrame:
    return r.alert.where((F.col("status") != "dismissed") & ~F.col("is_subject").eqNullSafe(False)).select("alert_id", "is_subject")


_ENTITLEMENTS = "(0, true, false, DATE '2030-01-01', true), (1, true, true, DATE '2020-01-01', true), (2, false, true, NULL, true), (3, true, true, NULL, false)"


def _policies(r: Roles) -> DataFrame:
    return r.spark.sql(
        f"SELECT col1 AS country_id, col2 AS may_display, col3 AS may_prompt, col4 AS expires, col5 AS anyone FROM VALUES {_ENTITLEMENTS}"
    ).withColumn("users", F.when(F.col("anyone"), F.array().cast("array<string>")).otherwise(F.array(F.lit("ann"))))


def _decided(r: Roles) -> DataFrame:
    e = r.issuer.join(F.broadcast(_policies(r)), "country_id", "left")
    args = (F.col("region") != "ASIA", F.col("may_display").isNotNull(), F.col("expires") < F.lit("2024-01-01").cast("date"), F.col("users"), "bob")
    shown = policy.decision(*args, F.col("may_display"))
    prompted = policy.both(policy.decision(*args, F.col("may_prompt")), shown)
    return e.select("issuer_id", shown.alias("shown"), prompted.alias("prompted"))


_REASON = """CASE WHEN region = 'ASIA' THEN 'public' WHEN may_display IS NULL THEN 'no_entitlement' WHEN coalesce(expires < DATE '2024-01-01', false) THEN 'expired'
    WHEN NOT anyone THEN 'user_not_permitted' WHEN NOT {flag} THEN 'action_not_permitted' ELSE 'permitted' END"""
_POLICY_SQL = f"""WITH e(country_id, may_display, may_prompt, expires, anyone) AS (VALUES {_ENTITLEMENTS}), d AS (
    SELECT issuer_id, {_REASON.format(flag="may_display")} AS shown, {_REASON.format(flag="may_prompt")} AS prompt FROM issuer LEFT JOIN e USING (country_id))"""


@query(
    "f18_policy_decision",
    "F18 N07 P07 F21",
    f"{_POLICY_SQL} SELECT issuer_id, shown IN ('public', 'permitted') AS allowed, shown AS reason FROM d",
)
def policy_decision(r: Roles) -> DataFrame:
    """The first rule that applies decides; a list of users that is empty permits anyone."""
    return _decided(r).select("issuer_id", "shown.allowed", "shown.reason")


@query(
    "f19_policy_both",
    "F19 F20",
    f"{_POLICY_SQL} SELECT issuer_id, CASE WHEN prompt IN ('public', 'permitted') THEN shown ELSE prompt END AS reason, (SELECT count(*) FROM d) AS total FROM d WHERE prompt IN ('public', 'permitted') AND shown IN ('public', 'permitted')",
)
def policy_both(r: Roles) -> DataFrame:
    """Rows denied are dropped; the total is of before."""
    d = _decided(r)
    return d.where("prompted.allowed").crossJoin(F.broadcast(d.agg(F.count("*").alias("total")))).select("issuer_id", "prompted.reason", "total")


@query("f22_forms_since", "F22", "SELECT security_id, priority, maturity FROM security WHERE priority IN ('1-URGENT', '2-HIGH') AND maturity > DATE '2000-06-30'")
def forms_since(r: Roles) -> DataFrame:
    return r.security.where(F.col("priority").isin("1-URGENT", "2-HIGH") & (F.col("maturity") > F.lit("2000-06-30").cast("date"))).select("security_id", "priority", "maturity")


@query(
    "f23_first_of_kind",
    "F23",
    "SELECT docket_id, entry_no FROM (SELECT *, row_number() OVER (PARTITION BY docket_id ORDER BY entry_no) AS n FROM docket_entry WHERE role = 'user') WHERE n <= 5",
)
def first_of_kind(r: Roles) -> DataFrame:
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("docket_id").orderBy("entry_no"))
    return r.docket_entry.where("role = 'user'").select("docket_id", "entry_no", n.alias("n")).where("n <= 5").drop("n")


@query(
    "f24_floor_split",
    "F24 F26 A24 O16",
    """SELECT CAST(count(*) FILTER (WHERE confidence < 0.1) AS BIGINT) AS low, CAST(count(*) FILTER (WHERE confidence >= 0.1) AS BIGINT) AS enough, max(confidence) < 0.5 AS deterministic_only
    FROM (SELECT confidence FROM alert WHERE category <> 'view' ORDER BY triggered_at DESC, alert_id LIMIT 5000)""",
)
def floor_split(r: Roles) -> DataFrame:
    """The newest rows but for those with the marker, split by a floor."""
    newest = r.alert.where("category <> 'view'").orderBy(F.desc("triggered_at"), "alert_id").limit(5000)
    c = F.col("confidence")
    return newest.agg(F.count_if(c < 0.1).alias("low"), F.count_if(c >= 0.1).alias("enough"), (F.max(c) < 0.5).alias("deterministic_only"))


@query("f25_relevant_of_latest", "F25 O04 O07", "SELECT alert_id, category FROM (SELECT * FROM alert ORDER BY triggered_at DESC, alert_id LIMIT 50) WHERE category IN ('error', 'signup', 'purchase')")
def relevant_of_latest(r: Roles) -> DataFrame:
    """The filter comes after the limit."""
    return r.alert.orderBy(F.desc("triggered_at"), "alert_id").limit(50).where(F.col("category").isin("error", "signup", "purchase")).select("alert_id", "category")


@query("f29_severity", "F29", "SELECT alert_id FROM alert WHERE severity = 'high'")
def severity(r: Roles) -> DataFrame:
    return r.alert.where("severity = 'high'").select("alert_id")


@query(
    "f31_since_watermark",
    "F31 O03",
    "SELECT alert_id, as_of_date FROM alert WHERE as_of_date >= (SELECT max(as_of_date) FROM alert WHERE category = 'signup') - 3 ORDER BY triggered_at DESC, alert_id LIMIT 200",
)
def since_watermark(r: Roles) -> DataFrame:
    mark = r.alert.where("category = 'signup'").agg(F.date_sub(F.max("as_of_date"), 3).alias("since"))
    return r.alert.join(F.broadcast(mark), F.col("as_of_date") >= F.col("since")).orderBy(F.desc("triggered_at"), "alert_id").limit(200).select("alert_id", "as_of_date")


@query("f32_changed_since", "F32 Q08", "SELECT issuer_id, CASE verification WHEN 'verified' THEN 'upgraded' ELSE 'added' END AS change FROM membership WHERE verification <> 'unverified' AND (issuer_id >= 1000 OR collection_id >= 20)")
def changed_since(r: Roles) -> DataFrame:
    m = r.membership.where((F.col("verification") != "unverified") & ((F.col("issuer_id") >= 1000) | (F.col("collection_id") >= 20)))
    return m.select("issuer_id", F.when(F.col("verification") == "verified", "upgraded").otherwise("added").alias("change"))


@query(
    "f33_canonical_projection",
    "F30 F33",
    """SELECT o_orderkey AS filing_id, CAST(substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS DATE) AS filed, o_orderpriority AS form, o_orderpriority LIKE '%LOW' AS is_amendment, coalesce(c_name, 'Unknown issuer') AS issuer
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey""",
)
def canonical_projection(r: Roles) -> DataFrame:
    known = r.table("customer").where("c_custkey % 2 = 0").select("c_custkey", "c_name")
    return r.table("orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("o_orderkey").alias("filing_id"), F.try_to_date(F.substring(F.col("o_orderdate").cast("string"), 1, 10), "yyyy-MM-dd").alias("filed"),
        F.col("o_orderpriority").alias("form"), F.endswith("o_orderpriority", F.lit("LOW")).alias("is_amendment"), F.coalesce("c_name", F.lit("Unknown issuer")).alias("issuer"),
    )


@query(
    "f34_availability",
    "F34",
    "SELECT alert_id, CASE WHEN is_subject IS NOT FALSE THEN 'unavailable' WHEN status = 'new' THEN 'available' ELSE 'unavailable' END AS availability, CASE WHEN is_subject IS NOT FALSE THEN NULL WHEN status = 'new' THEN 'doc/' || alert_id END AS url FROM alert",
)
def availability(r: Roles) -> DataFrame:
    """Sealed or unknown is unavailable and has no address."""
    sealed, there = ~F.col("is_subject").eqNullSafe(False), F.col("status") == "new"
    return r.alert.select(
        "alert_id", F.when(sealed, "unavailable").when(there, "available").otherwise("unavailable").alias("availability"), F.when(~sealed & there, F.concat(F.lit("doc/"), F.col("alert_id").cast("string"))).alias("url")
    )


@query(
    "f36_mapping_with_rejection",
    "F36",
    "SELECT category, CAST(count(*) AS BIGINT) AS n, CASE category WHEN 'error' THEN 'event' WHEN 'purchase' THEN 'annual' WHEN 'signup' THEN 'quarterly' END IS NULL AS rejected FROM alert GROUP BY category",
)
def mapping_with_rejection(r: Roles) -> DataFrame:
    form = F.when(F.col("category") == "error", "event").when(F.col("category") == "purchase", "annual").when(F.col("category") == "signup", "quarterly")
    return r.alert.groupBy("category", form.isNull().alias("rejected")).agg(F.count("*").alias("n")).select("category", "n", "rejected")


@query(
    "f37_collection_split",
    "F37 A12 J03 J24",
    """SELECT issuer_id, string_agg(name, ',' ORDER BY name) FILTER (WHERE collection_type = 'watchlist') AS watchlists, string_agg(name, ',' ORDER BY name) FILTER (WHERE collection_type <> 'watchlist') AS others
    FROM membership JOIN collection USING (collection_id) GROUP BY issuer_id""",
)
def collection_split(r: Roles) -> DataFrame:
    joined = r.membership.join(F.broadcast(r.collection), "collection_id").groupBy("issuer_id")
    lists = joined.agg(F.collect_list(F.when(F.col("collection_type") == "watchlist", F.col("name"))).alias("w"), F.collect_list(F.when(F.col("collection_type") != "watchlist", F.col("name"))).alias("o"))
    text = lambda c: F.when(F.size(c) > 0, F.array_join(F.sort_array(c), ","))
    return lists.select("issuer_id", text("w").alias("watchlists"), text("o").alias("others"))


@query("f38_upload_validation", "F38", "SELECT filing_id, starts_with(html, '<!DOCTYPE') AND octet_length(encode(html)) <= 20000 AS accepted FROM filing")
def upload_validation(r: Roles) -> DataFrame:
    return r.filing.select("filing_id", (F.startswith("html", F.lit("<!DOCTYPE")) & (F.octet_length("html") <= 20000)).alias("accepted"))
