"""Alerts built from bundles, texts of reasons, series and links that are stored, and smaller reads of the model (inventory A, B, C, H, L)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.bindings import Roles, choice
from covenant.operators.relational import first_by
from covenant.operators.storage import fresh_path
from covenant.plans import joining
from covenant.registry import all_of, query
from covenant.sources.store import Store

#: What an alert's category is called in a sentence. Fixed values.
TOPICS = {"error": "covenant breach or event of default", "purchase": "refinancing activity", "signup": "engagement of a restructuring advisor"}
_TOPIC_SQL = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TOPICS.items()) + " ELSE replace(category, '_', ' ') END"
_RANK = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"


@query(
    "x21_built_alerts",
    "X21 T29 N06 N08",
    f"""WITH e AS (SELECT *, row_number() OVER b AS n FROM alert WINDOW b AS (PARTITION BY issuer_id, provider, as_of_date ORDER BY {_RANK}, alert_id)),
    g AS (SELECT issuer_id, provider, as_of_date, count(*) AS signals, max(confidence) AS best, string_agg('alert:' || alert_id, ',' ORDER BY alert_id) AS refs FROM e GROUP BY ALL),
    p AS (SELECT e.*, {_TOPIC_SQL} AS topic FROM e WHERE n = 1)
    SELECT issuer_id, provider, as_of_date, category, CASE WHEN ai_assisted THEN 'Reviewed: ' || topic || ' at ' || coalesce(legal_name, 'Unknown issuer') ELSE 'Potential ' || topic || ' detected in a new ' || provider || ' report.' END AS headline,
        CASE WHEN ai_assisted THEN 'The review confirms ' || topic || '.' ELSE 'Rules flagged ' || signals || ' signal' || CASE WHEN signals <> 1 THEN 's' ELSE '' END || ' in a new ' || provider || ' report, including ' || topic || '.' END AS explanation,
        CASE WHEN ai_assisted AND is_subject IS FALSE THEN 'low' ELSE severity END AS severity, CASE WHEN ai_assisted THEN confidence ELSE best END AS confidence, CASE WHEN ai_assisted THEN is_subject END AS is_subject, refs
    FROM p JOIN g USING (issuer_id, provider, as_of_date) LEFT JOIN issuer USING (issuer_id) WHERE NOT (ai_assisted AND k % 7 = 0)""",
)
def built_alerts(r: Roles) -> DataFrame:
    """An alert for each bundle of an issuer's evidence of a day and provider: what a review said of its worst evidence or else what the rules did,
    with all evidence referred to; bundles whose review was put off have none yet."""
    keys = ["issuer_id", "provider", "as_of_date"]
    rank = F.expr(_RANK)
    worst = F.min_by(F.struct("category", "severity", "confidence", "is_subject", "ai_assisted", "k"), F.struct(rank, "alert_id"))
    refs = F.transform(F.sort_array(F.collect_list("alert_id")), lambda i: F.struct(F.lit("alert").alias("kind"), i.alias("id")))
    g = r.alert.groupBy(*keys).agg(F.count("*").alias("signals"), F.max("confidence").alias("best"), refs.alias("refs"), worst.alias("p"))
    g = g.where(~(F.col("p.ai_assisted") & (F.col("p.k") % 7 == 0))).join(r.issuer.select("issuer_id", "legal_name"), "issuer_id", "left")
    ai, signals = F.col("p.ai_assisted"), F.col("signals")
    topic = F.coalesce(choice(F.col("p.category"), TOPICS), F.replace(F.col("p.category"), F.lit("_"), F.lit(" ")))
    report = F.concat(F.lit("a new "), "provider", F.lit(" report"))
    return g.select(
        *keys, "p.category",
        F.when(ai, F.concat(F.lit("Reviewed: "), topic, F.lit(" at "), F.coalesce("legal_name", F.lit("Unknown issuer")))).otherwise(F.concat(F.lit("Potential "), topic, F.lit(" detected in "), report, F.lit("."))).alias("headline"),
        F.when(ai, F.concat(F.lit("The review confirms "), topic, F.lit("."))).otherwise(
            F.concat(F.lit("Rules flagged "), signals.cast("string"), F.lit(" signal"), F.when(signals != 1, "s").otherwise(""), F.lit(" in "), report, F.lit(", including "), topic, F.lit("."))
        ).alias("explanation"),
        F.when(ai & F.col("p.is_subject").eqNullSafe(False), "low").otherwise(F.col("p.severity")).alias("severity"), F.when(ai, F.col("p.confidence")).otherwise(F.col("best")).alias("confidence"),
        F.when(ai, F.col("p.is_subject")).alias("is_subject"), F.array_join(F.transform("refs", lambda x: F.concat_ws(":", x["kind"], x["id"].cast("string"))), ",").alias("refs"),
    )


@query(
    "t30_rationale",
    "T30",
    "SELECT docket_id, entry_no, 'System-classified from dockets evidence (' || role || ', ' || CASE WHEN length(text) > 300 THEN 'high' ELSE 'low' END || ' severity, rule length): “' || substr(text, 1, 200) || '”' AS rationale FROM docket_entry",
)
def rationale(r: Roles) -> DataFrame:
    """Why an entry was classified as it was, with the beginning of its text."""
    severity = F.when(F.length("text") > 300, "high").otherwise("low")
    return r.docket_entry.select("docket_id", "entry_no", F.format_string("System-classified from %s evidence (%s, %s severity, rule %s): “%s”", F.lit("dockets"), "role", severity, F.lit("length"), F.substring("text", 1, 200)).alias("rationale"))


@query("n12_artifact_round_trip", "N12", "SELECT doc_id, len(string_split(text, chr(10))) AS pages, sha256(text) AS checksum FROM document WHERE text IS NOT NULL")
def artifact_round_trip(r: Roles) -> DataFrame:
    """Pages of documents written as JSON and read back, put together again."""
    pages = F.transform(F.split("text", "\n"), lambda t, i: F.struct((i + 1).alias("page_number"), t.alias("markdown")))
    written = r.document.where("text IS NOT NULL").select("doc_id", F.to_json(F.struct(pages.alias("pages"))).alias("body"))
    read = written.select("doc_id", F.from_json("body", "pages array<struct<page_number: int, markdown: string>>")["pages"].alias("p"))
    return read.select("doc_id", F.array_max(F.transform("p", lambda x: x["page_number"])).cast("long").alias("pages"), F.sha2(F.array_join(F.transform("p", lambda x: x["markdown"]), "\n"), 256).alias("checksum"))


@query(
    "x26_series_refresh",
    "X26 X09 S29",
    """WITH o AS (SELECT category AS series, as_of_date AS day, max(confidence) AS value FROM alert GROUP BY ALL)
    SELECT series, CASE WHEN series = 'click' THEN 'failed' ELSE 'refreshed' END AS status, count(*) FILTER (WHERE day < DATE '2024-01-16') AS had, CASE WHEN series = 'click' THEN 0 ELSE count(*) FILTER (WHERE day >= DATE '2024-01-16') END AS new,
        max(day) FILTER (WHERE series <> 'click' OR day < DATE '2024-01-16') AS latest, arg_max(value, day) FILTER (WHERE series <> 'click' OR day < DATE '2024-01-16') AS value FROM o GROUP BY series""",
)
def series_refresh(r: Roles) -> DataFrame:
    """Series refreshed into a store by day, each for itself: one that fails keeps what it had, and a refresh made again adds nothing."""
    store = Store(r.spark, fresh_path(r.spark, "series"), "series string, day date, value decimal(20,4)", ["series", "day"])
    fetched = r.alert.groupBy(F.col("category").alias("series"), F.col("as_of_date").alias("day")).agg(F.max("confidence").cast("decimal(20,4)").alias("value"))
    store.append(fetched.where("day < date '2024-01-16'"), 0)
    for batch in (1, 2):
        good = fetched.where("series <> 'click'")  # the one that its provider doesn't give
        store.append(good.join(store.newest(before=batch).select("series", "day"), ["series", "day"], "left_anti"), batch)
    held = store.read().groupBy("series").agg(F.count_if(F.col("_batch") == 0).alias("had"), F.count_if(F.col("_batch") > 0).alias("new"), F.max("day").alias("latest"), F.max_by("value", "day").alias("value"))
    return held.select("series", F.when(F.col("series") == "click", "failed").otherwise("refreshed").alias("status"), "had", "new", "latest", "value")


@query("s43_identity_ingest", "S43", "SELECT a.issuer_id, i.issuer_id IS NULL AS created, coalesce(legal_name, 'Issuer ' || a.issuer_id) AS legal_name FROM (SELECT DISTINCT issuer_id FROM alert WHERE category = 'error') a LEFT JOIN issuer i USING (issuer_id)")
def identity_ingest(r: Roles) -> DataFrame:
    """Issuers met by their number alone: got where they are there, created with no more than a name where not."""
    met = r.alert.where("category = 'error'").select("issuer_id").distinct()
    known = r.issuer.select("issuer_id", "legal_name")
    return met.join(known, "issuer_id", "left").select("issuer_id", F.col("legal_name").isNull().alias("created"), F.coalesce("legal_name", F.concat(F.lit("Issuer "), F.col("issuer_id").cast("string"))).alias("legal_name"))


@query("s45_docket_links", "S45", f"SELECT docket_id, issuer_id, alert_id AS provenance FROM ({all_of('x17_auto_link').sql}) WHERE outcome = 'match'")
def docket_links(r: Roles) -> DataFrame:
    """Dockets linked to the issuers that they were matched with, each link stored once however often the match is made."""
    links = Store(r.spark, fresh_path(r.spark, "links"), "docket_id long, issuer_id long, provenance long", ["docket_id", "issuer_id"])
    matched = joining.auto_link(r).where("outcome = 'match'").select("docket_id", "issuer_id", F.col("alert_id").alias("provenance"))
    for batch in (0, 1):
        links.append(matched.join(links.newest(before=batch).select("docket_id", "issuer_id"), ["docket_id", "issuer_id"], "left_anti"), batch)
    return links.read().drop("_batch")


_KNOWN = "CASE WHEN security_id % 4 > 0 THEN maturity END"


@query("f08_nullable_range", "F08", f"SELECT count(*) AS n, min(day) AS first, max(day) AS last FROM (SELECT {_KNOWN} AS day FROM security) WHERE day IS NOT NULL AND day >= DATE '1996-01-01' AND day < DATE '1997-01-01'")
def nullable_range(r: Roles) -> DataFrame:
    days = r.security.select(F.expr(_KNOWN).alias("day")).where("day >= date '1996-01-01' AND day < date '1997-01-01'")
    return days.agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))


@query("f09_inclusive_bound", "F09", "SELECT security_id, issuer_id, maturity FROM security WHERE maturity >= DATE '1998-06-01'")
def inclusive_bound(r: Roles) -> DataFrame:
    return r.security.where("maturity >= date '1998-06-01'").select("security_id", "issuer_id", "maturity")


@query("f30_api_rows", "F30 J07 J08", "SELECT alert_id, issuer_id, coalesce(legal_name, 'Unknown issuer') AS issuer, sector, country, region, category, severity, triggered_at, as_of_date, confidence, status, is_subject, provider, ai_assisted, k, balance FROM alert LEFT JOIN issuer USING (issuer_id)")
def api_rows(r: Roles) -> DataFrame:
    """An alert with its issuer as one wide row, for those without an issuer as well."""
    wide = r.alert.join(r.issuer, "issuer_id", "left")
    return wide.select("alert_id", "issuer_id", F.coalesce("legal_name", F.lit("Unknown issuer")).alias("issuer"), "sector", "country", "region", "category", "severity", "triggered_at", "as_of_date", "confidence", "status", "is_subject", "provider", "ai_assisted", "k", "balance")


@query("j12_members_of_types", "J12", "SELECT DISTINCT issuer_id FROM membership JOIN collection USING (collection_id) WHERE collection_type IN ('watchlist', 'benchmark')")
def members_of_types(r: Roles) -> DataFrame:
    of_type = r.collection.where(F.col("collection_type").isin("watchlist", "benchmark"))
    return r.membership.join(F.broadcast(of_type), "collection_id").select("issuer_id").distinct()


@query("j13_layers_with_issuer", "J13 Q03", "SELECT l.issuer_id, rank_order, amount, legal_name FROM layer l JOIN issuer i ON l.issuer_id = i.issuer_id AND i.region <> 'ASIA'")
def layers_with_issuer(r: Roles) -> DataFrame:
    """Layers with what they come from; those whose issuer is missing or not to be shown are dropped."""
    return r.layer.join(r.issuer.where("region <> 'ASIA'").select("issuer_id", "legal_name"), "issuer_id").select("issuer_id", "rank_order", "amount", "legal_name")


@query("w05_latest_run", "W05", "SELECT provider, alert_id AS run, status, triggered_at AS started_at FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY triggered_at DESC, alert_id DESC) AS n FROM alert) WHERE n = 1")
def latest_run(r: Roles) -> DataFrame:
    """The latest run of each kind, however it ended."""
    return first_by(r.alert, ["provider"], F.desc("triggered_at"), F.desc("alert_id")).select("provider", F.col("alert_id").alias("run"), "status", F.col("triggered_at").alias("started_at"))


@query(
    "t32_match_texts",
    "T32",
    """WITH d AS (SELECT docket_id, entry_no, role, unnest(string_split(text, chr(10))) AS body, unnest(range(len(string_split(text, chr(10))))) AS i FROM docket_entry),
    t AS (SELECT docket_id, entry_no, string_agg(body, ' ' ORDER BY i) AS texts FROM d WHERE i % 3 <> 2 AND body <> '' GROUP BY docket_id, entry_no)
    SELECT docket_id, entry_no, sha256(trim(concat_ws(' ', role, texts))) AS checksum, length(trim(concat_ws(' ', role, texts))) AS n_chars FROM docket_entry LEFT JOIN t USING (docket_id, entry_no)""",
)
def match_texts(r: Roles) -> DataFrame:
    """What rules are held against: an entry's description and the texts of its documents that aren't sealed and have any."""
    docs = F.transform(F.split("text", "\n"), lambda t, i: F.struct(t.alias("body"), (i % 3 == 2).alias("sealed")))
    open_ = F.transform(F.filter(docs, lambda d: ~d["sealed"] & (d["body"] != "")), lambda d: d["body"])
    text = F.trim(F.concat_ws(" ", "role", F.nullif(F.array_join(open_, " "), F.lit(""))))
    return r.docket_entry.select("docket_id", "entry_no", F.sha2(text, 256).alias("checksum"), F.length(text).alias("n_chars"))


@query(
    "s39_payload_links",
    "S39",
    """WITH e AS (SELECT alert_id, issuer_id, provider, as_of_date, row_number() OVER (PARTITION BY provider, as_of_date ORDER BY alert_id) AS n FROM alert WHERE severity <> 'low')
    SELECT provider, as_of_date, count(a.alert_id) AS rows_in_payload, max(e.alert_id) AS provenance FROM (SELECT alert_id, provider, as_of_date FROM alert) a LEFT JOIN e ON e.provider = a.provider AND e.as_of_date = a.as_of_date AND n = 1 GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY a.provider, a.as_of_date").replace("SELECT provider, as_of_date, count(a", "SELECT a.provider, a.as_of_date, count(a"),
)
def payload_links(r: Roles) -> DataFrame:
    """Evidence written in bulk, and each payload that it came from linked to the first of it, once; payloads without any stay unlinked."""
    payloads = Store(r.spark, fresh_path(r.spark, "linked-payloads"), "provider string, as_of_date date, rows_in_payload long, provenance long", ["provider", "as_of_date"])
    evidence = Store(r.spark, fresh_path(r.spark, "evidence"), "alert_id long, issuer_id long, provider string, as_of_date date", ["alert_id"])
    payloads.append(r.alert.groupBy("provider", "as_of_date").agg(F.count("*").alias("rows_in_payload"), F.lit(None).cast("long").alias("provenance")), 0)
    for batch in (1, 2):
        evidence.append(r.alert.where("severity <> 'low'").join(evidence.newest(before=batch).select("alert_id"), "alert_id", "left_anti").select("alert_id", "issuer_id", "provider", "as_of_date"), batch)
        first = evidence.read().groupBy("provider", "as_of_date").agg(F.min("alert_id").alias("first"))
        unlinked = payloads.newest(before=batch).where("provenance IS NULL").join(first, ["provider", "as_of_date"])
        payloads.append(unlinked.select("provider", "as_of_date", "rows_in_payload", F.col("first").alias("provenance")), batch)
    return payloads.newest()
