"""Weighted vectors and search over entities, runs, versions and guarded deletes (inventory A, H, L and N)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covenant.bindings import Roles
from covenant.operators.search import found_in, lexemes, weighted_vector
from covenant.plans.texts import _LEX
from covenant.registry import query


@query(
    "t01_weighted_vector",
    "T01",
    f"""WITH p AS (SELECT alert_id, 'A' AS w, 'New ' || category || ' of issuer' AS t FROM alert UNION ALL SELECT alert_id, 'B', 'The ' || provider || ' report is ' || status FROM alert UNION ALL SELECT alert_id, 'C', replace(category, '_', ' ') FROM alert),
    l AS (SELECT alert_id, w, unnest({_LEX.format(x='t')}) AS x FROM p), b AS (SELECT alert_id, x, min(w) AS w FROM l GROUP BY alert_id, x)
    SELECT alert_id, string_agg(x || ':' || w, ' ' ORDER BY x) AS vector FROM b GROUP BY alert_id""",
)
def weighted_vectors(r: Roles) -> DataFrame:
    """The words of an alert with the best weight of where they stand: headline A, explanation B, category C."""
    parts = {
        "A": F.concat(F.lit("New "), "category", F.lit(" of issuer")),
        "B": F.concat(F.lit("The "), "provider", F.lit(" report is "), "status"),
        "C": F.replace("category", F.lit("_"), F.lit(" ")),
    }
    vector = F.transform(weighted_vector({w: lexemes(t) for w, t in parts.items()}), lambda x: F.concat_ws(":", x["lexeme"], x["weight"]))
    return r.alert.select("alert_id", F.array_join(vector, " ").alias("vector"))


@query(
    "q18_entity_search",
    "T03",
    f"""WITH s AS (SELECT 'docket' AS kind, docket_id AS id, entry_no AS part, text FROM docket_entry UNION ALL SELECT 'collection', collection_id, 0, replace(name, '_', ' ') FROM collection
    UNION ALL SELECT 'document', doc_id, i, line FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM document)),
    w AS (SELECT kind, id, part, {_LEX.format(x='text')} AS w FROM s),
    m AS (SELECT kind, id, part, len(list_filter(w, lambda x: x IN ('license', 'nation', 'please'))) AS hits FROM w WHERE list_contains(w, 'license') OR list_contains(w, 'nation') OR list_contains(w, 'please'))
    SELECT kind, id, part, hits FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY hits DESC, id, part) AS n FROM m) WHERE n <= 20""",
)
def entity_search(r: Roles) -> DataFrame:
    """Dockets, collections and chunks of documents that match a search, the twenty of each with most hits."""
    lines = r.document.select("doc_id", F.posexplode(F.split("text", "\n")).alias("part", "text"))
    sources = {
        "docket": r.docket_entry.select(F.col("docket_id").alias("id"), F.col("entry_no").cast("long").alias("part"), "text"),
        "collection": r.collection.select(F.col("collection_id").alias("id"), F.lit(0).cast("long").alias("part"), F.replace("name", F.lit("_"), F.lit(" ")).alias("text")),
        "document": lines.select(F.col("doc_id").alias("id"), F.col("part").cast("long").alias("part"), "text"),
    }
    return found_in(sources, "license or nation or please", 20).select("kind", "id", "part", F.col("hits").cast("long").alias("hits"))


@query(
    "w11_version_history",
    "W11 W18 S35 S37",
    """WITH v AS (SELECT issuer_id, security_id, priority, row_number() OVER (PARTITION BY issuer_id ORDER BY maturity, security_id) AS version, count(*) OVER (PARTITION BY issuer_id) AS n FROM security)
    SELECT issuer_id, version, priority, lag(priority) OVER (PARTITION BY issuer_id ORDER BY version) AS before, version = n AS is_current, version = 2 AS asked FROM v""",
)
def version_history(r: Roles) -> DataFrame:
    """An append-only log as versions: each with what was before it, the current one, and the one that is asked for."""
    w = Window.partitionBy("issuer_id").orderBy("maturity", "security_id")
    version = F.row_number().over(w).cast("long")
    v = r.security.select("issuer_id", version.alias("version"), "priority", F.lag("priority").over(w).alias("before"), F.count("*").over(Window.partitionBy("issuer_id")).alias("n"))
    return v.select("issuer_id", "version", "priority", "before", (F.col("version") == F.col("n")).alias("is_current"), (F.col("version") == 2).alias("asked"))


@query(
    "s47_run_rows",
    "S47 A25 D13",
    """WITH e AS (SELECT *, CAST(triggered_at - INTERVAL 5 HOUR AS DATE) AS day FROM alert)
    SELECT provider, day, min(triggered_at) AS opened_at, max(triggered_at) AS closed_at, count(*) AS examined, count(DISTINCT issuer_id) AS issuers, count(*) FILTER (WHERE severity <> 'low') AS created, count(*) FILTER (WHERE k = 13) AS failed,
    CASE WHEN count(*) FILTER (WHERE k = 13) = 0 THEN 'completed' WHEN count(*) FILTER (WHERE k <> 13) = 0 THEN 'failed' ELSE 'completed_with_errors' END AS status FROM e GROUP BY provider, day""",
)
def run_rows(r: Roles) -> DataFrame:
    """A row for each run, a provider's research day, with its counters and how it ended."""
    from covenant.functions.dates import research_day

    bad = F.count_if(F.col("k") == 13)
    status = F.when(bad == 0, "completed").when(bad == F.count("*"), "failed").otherwise("completed_with_errors")
    return r.alert.groupBy("provider", research_day(F.col("triggered_at")).alias("day")).agg(
        F.min("triggered_at").alias("opened_at"), F.max("triggered_at").alias("closed_at"), F.count("*").alias("examined"), F.countDistinct("issuer_id").alias("issuers"),
        F.count_if(F.col("severity") != "low").alias("created"), bad.alias("failed"), status.alias("status"),
    )


@query(
    "q25_guarded_delete",
    "Q25 Q34",
    """WITH m AS (SELECT issuer_id, count(*) AS memberships FROM membership GROUP BY issuer_id), s AS (SELECT issuer_id, count(*) AS securities FROM security GROUP BY issuer_id), a AS (SELECT issuer_id, count(*) AS alerts FROM alert GROUP BY issuer_id)
    SELECT issuer_id, CASE WHEN securities > 0 THEN 'securities:' || securities WHEN alerts > 0 THEN 'alerts:' || alerts ELSE 'deleted' END AS outcome, CASE WHEN securities IS NULL AND alerts IS NULL THEN coalesce(memberships, 0) ELSE 0 END AS orphans
    FROM issuer LEFT JOIN m USING (issuer_id) LEFT JOIN s USING (issuer_id) LEFT JOIN a USING (issuer_id)""",
)
def guarded_delete(r: Roles) -> DataFrame:
    """Issuers that can be deleted as nothing depends on them, with the memberships that go along; else what does."""
    count = lambda df, name: df.groupBy("issuer_id").agg(F.count("*").alias(name))
    of = r.issuer.select("issuer_id").join(count(r.membership, "memberships"), "issuer_id", "left").join(count(r.security, "securities"), "issuer_id", "left").join(count(r.alert, "alerts"), "issuer_id", "left")
    kept = lambda c: F.concat(F.lit(f"{c}:"), F.col(c).cast("string"))
    outcome = F.when(F.col("securities") > 0, kept("securities")).when(F.col("alerts") > 0, kept("alerts")).otherwise("deleted")
    orphans = F.when(F.col("securities").isNull() & F.col("alerts").isNull(), F.coalesce("memberships", F.lit(0))).otherwise(0)
    return of.select("issuer_id", outcome.alias("outcome"), orphans.cast("long").alias("orphans"))


@query(
    "s42_dedup_ingest",
    "S41 S42 S44",
    """WITH b AS (SELECT issuer_id, security_id, substr(priority, 1, 1) || strftime(maturity, '%Y') AS prefix, amount, row_number() OVER (PARTITION BY issuer_id, substr(priority, 1, 1) || strftime(maturity, '%Y') ORDER BY amount DESC, security_id) AS n FROM security)
    SELECT issuer_id, prefix, security_id, amount, NOT EXISTS (SELECT 1 FROM membership m WHERE m.issuer_id = b.issuer_id AND m.verification = 'verified') AS created FROM b WHERE n = 1""",
)
def dedup_ingest(r: Roles) -> DataFrame:
    """Hits of a search made one for each prefix, the largest, and whether their issuer is new."""
    from covenant.operators.relational import first_by

    prefix = F.concat(F.substring("priority", 1, 1), F.date_format("maturity", "yyyy"))
    first = first_by(r.security.withColumn("prefix", prefix), ["issuer_id", "prefix"], F.desc("amount"), F.asc("security_id"))
    known = r.membership.where("verification = 'verified'").select("issuer_id").distinct().withColumn("known", F.lit(True))
    return first.join(known, "issuer_id", "left").select("issuer_id", "prefix", "security_id", "amount", F.col("known").isNull().alias("created"))
