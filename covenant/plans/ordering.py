"""Sorts, limits and queues (inventory F)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covenant.bindings import Roles
from covenant.registry import query


@query("o02_newest_page", "O02 O03 O04 Q29 Q30", "SELECT alert_id, triggered_at FROM alert ORDER BY triggered_at DESC, alert_id LIMIT 25 OFFSET 50")
def newest_page(r: Roles) -> DataFrame:
    return r.alert.orderBy(F.desc("triggered_at"), "alert_id").offset(50).limit(25).select("alert_id", "triggered_at")


@query(
    "o05_null_order",
    "O05 O06 O15",
    "SELECT alert_id, row_number() OVER (PARTITION BY issuer_id ORDER BY is_subject ASC NULLS LAST, triggered_at, alert_id) AS up, row_number() OVER (PARTITION BY issuer_id ORDER BY is_subject DESC NULLS FIRST, triggered_at, alert_id) AS down FROM alert",
)
def null_order(r: Roles) -> DataFrame:
    """Nulls last going up and first coming down, in the positions of each issuer's list."""
    own = Window.partitionBy("issuer_id")
    up = own.orderBy(F.col("is_subject").asc_nulls_last(), "triggered_at", "alert_id")
    down = own.orderBy(F.col("is_subject").desc_nulls_first(), "triggered_at", "alert_id")
    return r.alert.select("alert_id", F.row_number().over(up).cast("long").alias("up"), F.row_number().over(down).cast("long").alias("down"))


@query(
    "o08_composite_sort",
    "O08 O07",
    "SELECT issuer_id, worst, latest FROM (SELECT issuer_id, min(CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS worst, max(as_of_date) AS latest FROM alert WHERE status = 'new' GROUP BY issuer_id) ORDER BY worst, latest DESC, issuer_id LIMIT 40",
)
def composite_sort(r: Roles) -> DataFrame:
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    g = r.alert.where("status = 'new'").groupBy("issuer_id").agg(F.min(rank).alias("worst"), F.max("as_of_date").alias("latest"))
    return g.orderBy("worst", F.desc("latest"), "issuer_id").limit(40)


@query("o10_display_cap", "O10 O11", "SELECT severity, alert_id, total FROM (SELECT severity, alert_id, count(*) OVER (PARTITION BY severity) AS total, row_number() OVER (PARTITION BY severity ORDER BY triggered_at DESC, alert_id) AS n FROM (SELECT * FROM alert ORDER BY triggered_at DESC, alert_id LIMIT 2000)) WHERE n <= 100")
def display_cap(r: Roles) -> DataFrame:
    """Of the newest, each list's first hundred with the count of before the cap."""
    newest = r.alert.orderBy(F.desc("triggered_at"), "alert_id").limit(2000)
    w = Window.partitionBy("severity")
    n = F.row_number().over(w.orderBy(F.desc("triggered_at"), "alert_id"))
    return newest.select("severity", "alert_id", F.count("*").over(w).alias("total"), n.alias("n")).where("n <= 100").drop("n")


@query(
    "o13_limit_per_source",
    "O13 O12 U05",
    """SELECT kind, id FROM (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY happened DESC, id) AS n FROM (
    SELECT 'security' AS kind, security_id AS id, CAST(maturity AS TIMESTAMP) AS happened FROM security UNION ALL SELECT 'alert', alert_id, triggered_at FROM alert)) WHERE n <= 15""",
)
def limit_per_source(r: Roles) -> DataFrame:
    """The newest of each kind: each branch is limited before the union."""
    top = lambda kind, df, i, at: df.select(F.lit(kind).alias("kind"), F.col(i).alias("id"), F.col(at).cast("timestamp_ntz").alias("at")).orderBy(F.desc("at"), "id").limit(15)
    return top("security", r.security, "security_id", "maturity").unionByName(top("alert", r.alert, "alert_id", "triggered_at")).select("kind", "id")


_QUEUE = """SELECT event_id AS job_id, k AS age, CASE WHEN event_type = 'view' THEN 'processing' WHEN event_type = 'click' THEN 'failed' ELSE 'pending' END AS status, CAST(event_id % 4 AS INTEGER) AS attempts
    FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)"""


def _queue(r: Roles) -> DataFrame:
    status = F.when(F.col("category") == "view", "processing").when(F.col("category") == "click", "failed").otherwise("pending")
    return r.alert.select(F.col("alert_id").alias("job_id"), F.col("k").alias("age"), status.alias("status"), (F.col("alert_id") % 4).cast("int").alias("attempts"))


@query("o17_queue_head", "O17", f"SELECT job_id, attempts FROM ({_QUEUE}) WHERE status = 'pending' ORDER BY job_id LIMIT 1")
def queue_head(r: Roles) -> DataFrame:
    """The oldest job that waits; one driver claims, so no row is locked."""
    return _queue(r).where("status = 'pending'").orderBy("job_id").limit(1).select("job_id", "attempts")


@query(
    "x12_queue_transitions",
    "X12 X13",
    f"""SELECT job_id, CASE WHEN status = 'processing' AND age > 60 THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END WHEN status = 'failed' AND attempts < 3 AND age % 2 = 0 THEN 'pending' ELSE status END AS status,
    attempts + CASE WHEN status = 'pending' THEN 1 ELSE 0 END AS attempts FROM ({_QUEUE})""",
)
def queue_transitions(r: Roles) -> DataFrame:
    """Claims count an attempt, stale claims go back or fail, and transient failures are tried again."""
    s, n, age = F.col("status"), F.col("attempts"), F.col("age")
    status = F.when((s == "processing") & (age > 60), F.when(n >= 3, "failed").otherwise("pending")).when((s == "failed") & (n < 3) & (age % 2 == 0), "pending").otherwise(s)
    return _queue(r).select("job_id", status.alias("status"), (n + F.when(s == "pending", 1).otherwise(0)).alias("attempts"))
