"""Ranks, running sums and versions (inventory E)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covenant.bindings import Roles
from covenant.operators.relational import first_by, waterfall
from covenant.registry import query


@query(
    "w02_primary_and_rest",
    "W02 W01 Q09",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY issuer_id, as_of_date, category ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, confidence DESC, triggered_at, alert_id) AS n FROM alert)
    SELECT issuer_id, as_of_date, category, max(CASE WHEN n = 1 THEN alert_id END) AS primary_id, count(*) - 1 AS supporting, coalesce(string_agg(alert_id, ',' ORDER BY n) FILTER (WHERE n > 1), '') AS rest FROM n GROUP BY issuer_id, as_of_date, category""",
)
def primary_and_rest(r: Roles) -> DataFrame:
    """An issuer's developments of a day and kind: the one in front and those that support it."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    entry = F.struct(rank.alias("r"), (-F.coalesce("confidence", F.lit(-1).cast("decimal(20,4)"))).alias("c"), "triggered_at", "alert_id")
    g = r.alert.groupBy("issuer_id", "as_of_date", "category").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    ids = F.transform(F.slice("e", 2, F.greatest(F.size("e") - 1, F.lit(0))), lambda x: x["alert_id"].cast("string"))
    return g.select("issuer_id", "as_of_date", "category", F.col("e")[0]["alert_id"].alias("primary_id"), (F.size("e") - 1).cast("long").alias("supporting"), F.array_join(ids, ",").alias("rest"))


@query("w03_latest_per_key", "W03 W17", "SELECT category, day, value FROM (SELECT category, as_of_date AS day, max(confidence) AS value, row_number() OVER (PARTITION BY category ORDER BY as_of_date DESC) AS n FROM alert GROUP BY category, as_of_date) WHERE n = 1")
def latest_per_key(r: Roles) -> DataFrame:
    series = r.alert.groupBy("category", F.col("as_of_date").alias("day")).agg(F.max("confidence").alias("value"))
    return series.groupBy("category").agg(F.max("day").alias("day"), F.max_by("value", "day").alias("value"))


@query(
    "w04_latest_run",
    "W04",
    """WITH runs AS (SELECT as_of_date AS day, provider AS mode, CASE WHEN count(*) % 3 = 0 THEN 'failed' ELSE 'completed' END AS status, max(triggered_at) AS completed_at FROM alert GROUP BY as_of_date, provider)
    SELECT mode, day, completed_at FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY completed_at DESC, day DESC) AS n FROM runs WHERE status = 'completed') WHERE n = 1""",
)
def latest_run(r: Roles) -> DataFrame:
    runs = r.alert.groupBy(F.col("as_of_date").alias("day"), F.col("provider").alias("mode")).agg(F.count("*").alias("n"), F.max("triggered_at").alias("completed_at"))
    return first_by(runs.where("n % 3 <> 0"), ["mode"], F.desc("completed_at"), F.desc("day")).select("mode", "day", "completed_at")


@query(
    "w08_waterfall",
    "W08 W16 Q03 M01 M02",
    """WITH c AS (SELECT *, CAST(150000 AS DECIMAL(20,4)) AS value, CAST(sum(amount) OVER (PARTITION BY issuer_id ORDER BY rank_order) AS DECIMAL(20,4)) AS cumulative FROM layer)
    SELECT issuer_id, rank_order, amount, cumulative, CAST(round(value / cumulative, 2) AS DECIMAL(18,2)) AS coverage,
    CAST(round(greatest(0::DECIMAL(20,4), least(amount, value - (cumulative - amount))) * 100 / amount, 2) AS DECIMAL(18,2)) AS recovery FROM c""",
)
def capital_waterfall(r: Roles) -> DataFrame:
    """What a value covers of an issuer's layers, senior first, and what each recovers."""
    return waterfall(r.layer, F.lit(150000).cast("decimal(20,4)")).select("issuer_id", "rank_order", "amount", "cumulative", "coverage", "recovery")


@query("w09_ordinals", "W09", "SELECT docket_id, entry_no, row_number() OVER (PARTITION BY docket_id, role ORDER BY entry_no) - 1 AS ordinal, lag(role) OVER (PARTITION BY docket_id ORDER BY entry_no) AS previous_role FROM docket_entry")
def ordinals(r: Roles) -> DataFrame:
    by_role = Window.partitionBy("docket_id", "role").orderBy("entry_no")
    w = Window.partitionBy("docket_id").orderBy("entry_no")
    return r.docket_entry.select("docket_id", "entry_no", (F.row_number().over(by_role) - 1).cast("long").alias("ordinal"), F.lag("role").over(w).alias("previous_role"))


@query(
    "w10_next_version",
    "W10",
    """WITH v AS (SELECT issuer_id, count(*) AS version, max(security_id) AS last_id FROM security GROUP BY issuer_id),
    cur AS (SELECT v.*, s.instrument_type, s.priority FROM v JOIN security s ON s.security_id = v.last_id), e AS (SELECT issuer_id, max(priority) AS priority FROM security WHERE instrument_type = 'bond' GROUP BY issuer_id)
    SELECT issuer_id, version + CASE WHEN coalesce(e.priority, cur.priority) IS DISTINCT FROM cur.priority THEN 1 ELSE 0 END AS version, coalesce(e.priority, cur.priority) AS priority FROM cur LEFT JOIN e USING (issuer_id)""",
)
def next_version(r: Roles) -> DataFrame:
    """An edit makes a version only where the merged record differs."""
    cur = r.security.groupBy("issuer_id").agg(F.count("*").alias("version"), F.max_by("priority", "security_id").alias("was"))
    edits = r.security.where("instrument_type = 'bond'").groupBy("issuer_id").agg(F.max("priority").alias("new"))
    merged = F.coalesce("new", "was")
    return cur.join(edits, "issuer_id", "left").select("issuer_id", (F.col("version") + (~merged.eqNullSafe(F.col("was"))).cast("int")).alias("version"), merged.alias("priority"))


@query(
    "w12_unique_slug",
    "W12 T16",
    "SELECT part_id, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM (SELECT p_partkey AS part_id, base, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS n FROM (SELECT *, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM part))",
)
def unique_slug(r: Roles) -> DataFrame:
    from covenant.functions.text import slug

    n = F.row_number().over(Window.partitionBy("base").orderBy("part_id"))
    parts = r.table("part").select(F.col("p_partkey").alias("part_id"), slug(F.col("p_name")).alias("base")).select("part_id", "base", n.alias("n"))
    return parts.select("part_id", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string"))).alias("slug"))


@query(
    "w14_max_effective_severity",
    "W14 W07",
    "SELECT issuer_id, severity, alert_id FROM (SELECT *, row_number() OVER (PARTITION BY issuer_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, alert_id) AS n FROM alert) WHERE n = 1",
)
def max_effective_severity(r: Roles) -> DataFrame:
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return first_by(r.alert, ["issuer_id"], rank, F.asc("alert_id")).select("issuer_id", "severity", "alert_id")
