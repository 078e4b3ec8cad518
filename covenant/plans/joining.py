"""Joins (inventory C)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.bindings import Roles
from covenant.functions.text import company_key
from covenant.operators.matching import docket_match, outcome
from covenant.operators.relational import as_of, first_by
from covenant.registry import query


@query(
    "j01_three_way_inner",
    "J01",
    "SELECT security_id, legal_name, country, amount FROM security JOIN issuer USING (issuer_id) JOIN layer_head USING (security_id)".replace("layer_head USING (security_id)", "(SELECT DISTINCT issuer_id AS security_id FROM layer) USING (security_id)"),
)
def three_way_inner(r: Roles) -> DataFrame:
    """Securities with their issuer, of those that have a layer."""
    layered = r.table("lineitem").select(F.col("l_orderkey").alias("security_id"))
    return r.security.join(r.issuer, "issuer_id").join(layered, "security_id", "left_semi").select("security_id", "legal_name", "country", "amount")


@query("j02_members_by_name", "J02 A07", "SELECT issuer_id, legal_name, verification FROM membership JOIN issuer USING (issuer_id) WHERE collection_id = 4 ORDER BY legal_name, issuer_id")
def members_by_name(r: Roles) -> DataFrame:
    return r.membership.where("collection_id = 4").join(r.issuer, "issuer_id").orderBy("legal_name", "issuer_id").select("issuer_id", "legal_name", "verification")


@query(
    "j04_bridge_grouped",
    "J04 J05 J25",
    "SELECT supplier_id, count(*) AS parts, min(p_name) AS first_name, max(p_name) AS last_name, string_agg(part_id::VARCHAR, ',' ORDER BY part_id) AS part_ids FROM supply JOIN part ON part_id = p_partkey GROUP BY supplier_id",
)
def bridge_grouped(r: Roles) -> DataFrame:
    parts = r.table("part").select(F.col("p_partkey").alias("part_id"), "p_name")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("part_id")), lambda x: x.cast("string")), ",")
    return r.supply.join(parts, "part_id").groupBy("supplier_id").agg(F.count("*").alias("parts"), F.min("p_name").alias("first_name"), F.max("p_name").alias("last_name"), ids.alias("part_ids"))


@query("j06_having_alert", "J06 A11 Q05", "SELECT DISTINCT issuer_id, legal_name FROM issuer JOIN alert USING (issuer_id) WHERE category = 'error' AND legal_name ILIKE '%00000%' ORDER BY legal_name, issuer_id LIMIT 20")
def having_alert(r: Roles) -> DataFrame:
    """Typeahead of issuers with an alert; a semi-join in place of a join and distinct."""
    found = r.issuer.where(F.ilike("legal_name", F.lit("%00000%"))).join(r.alert.where("category = 'error'"), "issuer_id", "left_semi")
    return found.orderBy("legal_name", "issuer_id").limit(20).select("issuer_id", "legal_name")


@query("j09_entry_with_docket", "J09 J28", "SELECT docket_id, entry_no, coalesce('docket ' || docket_id || ': ' || head, 'docket ' || docket_id, 'docket') AS source FROM docket_entry LEFT JOIN (SELECT docket_id, substr(text, 1, 20) AS head FROM docket_entry WHERE entry_no = 0 AND role = 'user') USING (docket_id)")
def entry_with_docket(r: Roles) -> DataFrame:
    head = r.docket_entry.where("entry_no = 0 and role = 'user'").select("docket_id", F.substring("text", 1, 20).alias("head"))
    label = F.concat(F.lit("docket "), F.col("docket_id").cast("string"))
    return r.docket_entry.select("docket_id", "entry_no").join(head, "docket_id", "left").select("docket_id", "entry_no", F.coalesce(F.concat(label, F.lit(": "), F.col("head")), label, F.lit("docket")).alias("source"))


@query("j14_keep_unmatched", "J14 J15 Q06", "SELECT alert_id, coalesce(legal_name, 'Unknown issuer') AS issuer FROM alert LEFT JOIN (SELECT * FROM issuer WHERE issuer_id % 3 <> 0) USING (issuer_id)")
def keep_unmatched(r: Roles) -> DataFrame:
    known = r.issuer.where("issuer_id % 3 <> 0").select("issuer_id", "legal_name")
    return r.alert.join(known, "issuer_id", "left").select("alert_id", F.coalesce("legal_name", F.lit("Unknown issuer")).alias("issuer"))


@query("j16_set_intersection", "J16 U03", "SELECT issuer_id FROM security WHERE instrument_type = 'bond' INTERSECT SELECT issuer_id FROM alert WHERE severity = 'high'")
def set_intersection(r: Roles) -> DataFrame:
    return r.security.where("instrument_type = 'bond'").select("issuer_id").intersect(r.alert.where("severity = 'high'").select("issuer_id"))


@query(
    "j17_as_of_latest",
    "J17",
    """SELECT alert_id, a.issuer_id, s.maturity, s.amount FROM alert a ASOF LEFT JOIN (SELECT issuer_id, maturity + INTERVAL 8 YEAR AS due, CAST(max(maturity) AS DATE) AS maturity, max(amount) AS amount FROM security GROUP BY ALL) s
    ON a.issuer_id = s.issuer_id AND a.triggered_at >= s.due""",
)
def as_of_latest(r: Roles) -> DataFrame:
    """Each alert with the issuer's security whose date, eight years on, is the last before it."""
    due = F.add_months("maturity", 96).cast("timestamp_ntz")
    quotes = r.security.groupBy("issuer_id", "maturity").agg(F.max("amount").alias("amount")).select("issuer_id", due.alias("due"), "maturity", "amount")
    return as_of(r.alert.select("alert_id", "issuer_id", "triggered_at"), quotes, "issuer_id", "triggered_at", "due").select("alert_id", "issuer_id", "maturity", "amount")



@query(
    "j18_containment_match",
    "J18",
    """WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM document),
    b AS (SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM benchmark),
    m AS (SELECT item_id, doc_id FROM b JOIN d ON contains(d.t, ' ' || b.t || ' '))
    SELECT item_id, count(doc_id) AS passing, CASE WHEN count(doc_id) = 0 THEN 'none' WHEN count(doc_id) = 1 THEN 'match' ELSE 'ambiguous' END AS outcome, CASE WHEN count(doc_id) = 1 THEN max(doc_id) END AS doc_id
    FROM b LEFT JOIN m USING (item_id) GROUP BY item_id""",
)
def containment_match(r: Roles) -> DataFrame:
    """Texts in which an item's normalized text stands whole: none, one match, or ambiguous.

    The item's first words in a row are a key that both sides share, so pairs come from an equi-join
    and the containment is tested on them alone.
    """
    from covenant.operators.matching import contained

    found = contained(r.document.select("doc_id", "text"), r.table("benchmark").select("item_id", "text"))
    return outcome(r.table("benchmark").select("item_id"), found, "item_id", "doc_id")


_DOCKETS = r"""ev AS (SELECT issuer_id, alert_id, as_of_date, legal_name, 'Case no. ' || (alert_id % 500 + 1000) || ' filed in court 3-medium' AS text FROM
    (SELECT *, row_number() OVER (PARTITION BY issuer_id ORDER BY triggered_at DESC, alert_id) AS n FROM alert WHERE category IN ('error', 'signup')) JOIN issuer USING (issuer_id) WHERE n = 1),
dk AS (SELECT issuer_id, security_id AS docket_id, '24-' || (security_id % 500 + 1000) AS number, CASE WHEN security_id % 3 = 0 THEN 'In re ' || c_name || ' Holdings, Inc.' ELSE 'In re Other LLC' END AS case_name, lower(priority) AS court,
    maturity + INTERVAL 28 YEAR + INTERVAL 1 DAY * CAST(security_id % 40 AS INTEGER) AS filed, CASE WHEN security_id % 4 > 0 THEN instrument_type END AS chapter FROM security JOIN customer ON c_custkey = issuer_id),
nm AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(legal_name), '\b(incorporated|inc|corporation|corp|company|co|holdings?|group|llc|l\.l\.c|ltd|limited|plc|lp|l\.p)\b\.?', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g')) AS ours,
    trim(regexp_replace(regexp_replace(regexp_replace(lower(case_name), '\b(incorporated|inc|corporation|corp|company|co|holdings?|group|llc|l\.l\.c|ltd|limited|plc|lp|l\.p)\b\.?', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g')) AS theirs FROM ev JOIN dk USING (issuer_id)),
sg AS (SELECT issuer_id, alert_id, docket_id, ours <> '' AND (contains(theirs, ours) OR contains(ours, theirs)) AS name_match,
    contains(lower(text), number) OR (length(regexp_replace(number, '[^0-9]', '', 'g')) >= 4 AND contains(regexp_replace(text, '[^0-9]', '', 'g'), regexp_replace(number, '[^0-9]', '', 'g'))) AS number_match,
    contains(lower(text), court) AS court_match, abs(date_diff('day', CAST(filed AS DATE), as_of_date)) <= 14 AS date_match, chapter IS NOT NULL AS type_match FROM nm),
ps AS (SELECT *, name_match::INT + number_match::INT + date_match::INT AS strong, type_match AND (number_match OR name_match::INT + number_match::INT + date_match::INT >= 2) AS passes FROM sg)"""


def _docket_candidates(r: Roles) -> DataFrame:
    """Each issuer's latest relevant evidence with the dockets found for it."""
    relevant = r.alert.where(F.col("category").isin("error", "signup"))
    latest = first_by(relevant, ["issuer_id"], F.desc("triggered_at"), F.asc("alert_id")).join(r.issuer.select("issuer_id", "legal_name"), "issuer_id")
    number = lambda c: (F.col(c) % 500 + 1000).cast("string")
    evidence = latest.select("issuer_id", "alert_id", F.col("as_of_date").alias("evidence_date"), "legal_name", F.concat(F.lit("Case no. "), number("alert_id"), F.lit(" filed in court 3-medium")).alias("evidence_text"))
    s = r.security.join(r.issuer.select("issuer_id", "legal_name"), "issuer_id")
    name = F.when(F.col("security_id") % 3 == 0, F.concat(F.lit("In re "), "legal_name", F.lit(" Holdings, Inc."))).otherwise("In re Other LLC")
    dockets = s.select(
        "issuer_id", F.col("security_id").alias("docket_id"), F.concat(F.lit("24-"), number("security_id")).alias("docket_number"), name.alias("case_name"), F.lower("priority").alias("court"),
        F.date_add(F.add_months("maturity", 28 * 12), (F.col("security_id") % 40).cast("int")).alias("date_filed"), F.when(F.col("security_id") % 4 > 0, F.col("instrument_type")).alias("chapter"),
    )
    return evidence.join(dockets, "issuer_id")


@query(
    "j18_docket_signals",
    "J18 M05 M06 T11",
    f"WITH {_DOCKETS} SELECT alert_id, docket_id, name_match, number_match, court_match, date_match, type_match, strong, passes FROM ps",
)
def docket_signals(r: Roles) -> DataFrame:
    """The signals of each candidate docket, how many strong ones there are, and whether it passes."""
    return docket_match(_docket_candidates(r)).select("alert_id", "docket_id", "name_match", "number_match", "court_match", "date_match", "type_match", "strong", "passes")


@query(
    "x17_auto_link",
    "X17 J19",
    f"""WITH {_DOCKETS} SELECT issuer_id, ev.alert_id, count(*) FILTER (WHERE passes) AS passing, CASE count(*) FILTER (WHERE passes) WHEN 0 THEN 'none' WHEN 1 THEN 'match' ELSE 'ambiguous' END AS outcome,
    CASE WHEN count(*) FILTER (WHERE passes) = 1 THEN max(docket_id) FILTER (WHERE passes) END AS docket_id FROM ev LEFT JOIN ps USING (issuer_id) GROUP BY issuer_id, ev.alert_id""",
)
def auto_link(r: Roles) -> DataFrame:
    """An attempt for each issuer with relevant evidence: the latest, its candidates, and the link if just one passes."""
    relevant = r.alert.where(F.col("category").isin("error", "signup")).join(r.issuer.select("issuer_id"), "issuer_id", "left_semi")
    latest = first_by(relevant, ["issuer_id"], F.desc("triggered_at"), F.asc("alert_id")).select("issuer_id", "alert_id")
    passing = docket_match(_docket_candidates(r)).where("passes")
    return outcome(latest, passing.select("issuer_id", "docket_id"), "issuer_id", "docket_id").join(latest, "issuer_id")


@query(
    "j19_name_and_date_signals",
    "D09",
    """WITH p AS (SELECT s.security_id, a.alert_id FROM security s JOIN alert a ON s.issuer_id = a.issuer_id AND abs(date_diff('day', s.maturity + INTERVAL 26 YEAR, CAST(a.triggered_at AS DATE))) % 365 <= 14 AND a.severity = 'high')
    SELECT security_id, count(*) AS passing, CASE WHEN count(*) = 1 THEN 'match' ELSE 'ambiguous' END AS outcome FROM p GROUP BY security_id""",
)
def name_and_date_signals(r: Roles) -> DataFrame:
    """Securities and high alerts of one issuer whose days of the year are near."""
    s = r.security.select("issuer_id", "security_id", F.add_months("maturity", 26 * 12).alias("day"))
    a = r.alert.where("severity = 'high'").select("issuer_id", "alert_id", F.to_date("triggered_at").alias("on"))
    near = F.abs(F.datediff("day", "on")) % 365 <= 14
    n = s.join(a, "issuer_id").where(near).groupBy("security_id").agg(F.count("*").alias("passing"))
    return n.select("security_id", "passing", F.when(F.col("passing") == 1, "match").otherwise("ambiguous").alias("outcome"))


@query(
    "j20_key_then_name",
    "J20 J27",
    """WITH h AS (SELECT s_suppkey AS hint_id, CASE WHEN s_suppkey % 2 = 0 THEN 'Brand#' || (s_suppkey % 60) ELSE split_part(p_name, ' ', 2) END AS hint FROM supplier JOIN part ON s_suppkey = p_partkey),
    k AS (SELECT hint_id, count(*) AS n, min(p_partkey) AS part_id FROM h JOIN part ON p_brand = hint GROUP BY hint_id),
    w AS (SELECT hint_id, count(*) AS n, min(p_partkey) AS part_id FROM h JOIN part ON list_contains(string_split(p_name, ' '), hint) GROUP BY hint_id)
    SELECT hint_id, CASE WHEN coalesce(k.n, w.n, 0) = 0 THEN 'rejected' WHEN coalesce(k.n, w.n) = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome, coalesce(k.n, w.n, 0) AS candidates
    FROM h LEFT JOIN k USING (hint_id) LEFT JOIN w USING (hint_id)""",
)
def key_then_name(r: Roles) -> DataFrame:
    """A hint resolved by key if any row has it as key, else by a word of the name."""
    part = r.table("part")
    s = F.col("s_suppkey")
    hints = r.table("supplier").join(part, s == F.col("p_partkey")).select(s.alias("hint_id"), F.when(s % 2 == 0, F.concat(F.lit("Brand#"), (s % 60).cast("string"))).otherwise(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("hint"))
    by_key = part.groupBy(F.col("p_brand").alias("hint")).agg(F.count("*").alias("by_key"))
    by_word = part.select(F.explode(F.array_distinct(F.split("p_name", " "))).alias("hint")).groupBy("hint").agg(F.count("*").alias("by_word"))
    n = F.coalesce("by_key", "by_word", F.lit(0)).cast("long")
    return hints.join(by_key, "hint", "left").join(by_word, "hint", "left").select("hint_id", F.when(n == 0, "rejected").when(n == 1, "resolved").otherwise("ambiguous").alias("outcome"), n.alias("candidates"))


@query(
    "j21_explode_ids",
    "J21 N02",
    "SELECT l_orderkey AS issuer_id, l_partkey AS part_id, min(p_name) AS name FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, l_partkey",
)
def explode_ids(r: Roles) -> DataFrame:
    """Ids held as an array by their owner, exploded and joined."""
    owners = r.table("lineitem").groupBy(F.col("l_orderkey").alias("issuer_id")).agg(F.collect_set("l_partkey").alias("ids"))
    parts = r.table("part").select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("name"))
    return owners.select("issuer_id", F.explode("ids").alias("part_id")).join(parts, "part_id").select("issuer_id", "part_id", "name")


@query("j22_header_with_count", "J22 Q32", "SELECT docket_id, count(*) AS entries, max(length(text)) AS longest FROM docket_entry GROUP BY docket_id")
def header_with_count(r: Roles) -> DataFrame:
    return r.docket_entry.groupBy("docket_id").agg(F.count("*").alias("entries"), F.max(F.length("text")).cast("long").alias("longest"))


@query("j23_nested_assembly", "J23", "SELECT docket_id, string_agg(entry_no || ':' || role, ';' ORDER BY entry_no) AS entries FROM docket_entry GROUP BY docket_id")
def nested_assembly(r: Roles) -> DataFrame:
    """Entries nested under their docket in order, shown as one text."""
    nested = r.docket_entry.groupBy("docket_id").agg(F.sort_array(F.collect_list(F.struct("entry_no", "role"))).alias("entries"))
    return nested.select("docket_id", F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["entry_no"].cast("string"), e["role"])), ";").alias("entries"))


@query(
    "j26_watchlist_enriched",
    "J26 A20 Q10 Q11 Q35 W07",
    """WITH m AS (SELECT issuer_id FROM membership WHERE collection_id = 5),
    c AS (SELECT issuer_id, count(*) AS securities FROM security GROUP BY issuer_id),
    a AS (SELECT issuer_id, count(*) FILTER (WHERE status = 'new') AS fresh, count(*) FILTER (WHERE status = 'new' AND severity = 'high') AS urgent FROM alert GROUP BY issuer_id),
    l AS (SELECT issuer_id, category, as_of_date FROM (SELECT *, row_number() OVER (PARTITION BY issuer_id ORDER BY as_of_date DESC, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, alert_id) AS n FROM alert) WHERE n = 1)
    SELECT issuer_id, legal_name, coalesce(securities, 0) AS securities, coalesce(fresh, 0) AS fresh, coalesce(urgent, 0) AS urgent, category AS latest, as_of_date
    FROM m JOIN issuer USING (issuer_id) LEFT JOIN c USING (issuer_id) LEFT JOIN a USING (issuer_id) LEFT JOIN l USING (issuer_id)""",
)
def watchlist_enriched(r: Roles) -> DataFrame:
    """Members of a watchlist with counts and their latest development."""
    members = r.membership.where("collection_id = 5").select("issuer_id").join(r.issuer, "issuer_id")
    alerts = r.alert.join(members.select("issuer_id"), "issuer_id", "left_semi")
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    latest = first_by(alerts, ["issuer_id"], F.desc("as_of_date"), rank, F.asc("alert_id")).select("issuer_id", F.col("category").alias("latest"), "as_of_date")
    counts = alerts.groupBy("issuer_id").agg(F.count_if(F.col("status") == "new").alias("fresh"), F.count_if((F.col("status") == "new") & (F.col("severity") == "high")).alias("urgent"))
    held = r.security.join(members.select("issuer_id"), "issuer_id", "left_semi").groupBy("issuer_id").agg(F.count("*").alias("securities"))
    out = members.join(held, "issuer_id", "left").join(counts, "issuer_id", "left").join(latest, "issuer_id", "left")
    return out.select("issuer_id", "legal_name", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("securities", "fresh", "urgent")), "latest", "as_of_date")


@query("j29_mixed_runs", "J29 W06", "SELECT kind, day, n FROM (SELECT 'daily' AS kind, as_of_date AS day, count(*) AS n FROM alert WHERE provider = 'filings' GROUP BY as_of_date UNION ALL SELECT 'discovery', as_of_date, count(*) FROM alert WHERE provider = 'dockets' GROUP BY as_of_date)")
def mixed_runs(r: Roles) -> DataFrame:
    """Two shapes of run made one before their union."""
    runs = lambda kind, p: r.alert.where(F.col("provider") == p).groupBy(F.col("as_of_date").alias("day")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "day", "n")
    return runs("daily", "filings").unionByName(runs("discovery", "dockets"))


@query("t10_company_key", "T10", "SELECT issuer_id, trim(regexp_replace(regexp_replace(lower(legal_name || ' Holdings, Inc.'), '\\b(incorporated|inc|corporation|corp|company|co|holdings?|group|llc|l\\.l\\.c|ltd|limited|plc|lp|l\\.p)\\b\\.?', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS key FROM issuer")
def company_keys(r: Roles) -> DataFrame:
    return r.issuer.select("issuer_id", company_key(F.concat("legal_name", F.lit(" Holdings, Inc."))).alias("key"))


