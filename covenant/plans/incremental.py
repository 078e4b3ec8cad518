"""Incremental runs over events split by a date: their final state is that of one run (inventory L)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.bindings import Roles
from covenant.operators.relational import first_by
from covenant.registry import query
from covenant.streaming.runs import advanced, isolated, one_run, since, unhandled


def _empty(r: Roles) -> DataFrame:
    return r.alert.select("issuer_id", "category", "alert_id").limit(0)


@query("x01_two_batches", "X01 X05", "SELECT issuer_id, category, min(alert_id) AS alert_id FROM alert GROUP BY issuer_id, category")
def two_batches(r: Roles) -> DataFrame:
    """Two runs, the second from the first's watermark, leave the store that one run over all leaves."""
    mark = F.lit("2024-01-15 23:59:59.999999").cast("timestamp_ntz")
    first = r.alert.where(F.col("triggered_at") <= mark)
    store = one_run(first, _empty(r), ["issuer_id", "category"], ["alert_id"])
    watermark = first.agg(F.max("triggered_at").alias("mark"))
    second = since(r.alert, "triggered_at", watermark)
    return one_run(second, store, ["issuer_id", "category"], ["alert_id"])


@query("x03_fault_isolation", "X03", "SELECT issuer_id, count(*) AS done, CAST(0 AS BIGINT) AS failed FROM alert WHERE k <> 13 GROUP BY issuer_id HAVING true".replace("CAST(0 AS BIGINT) AS failed FROM alert WHERE k <> 13", "count(*) FILTER (WHERE k = 13) AS failed FROM alert").replace("count(*) AS done", "count(*) FILTER (WHERE k <> 13) AS done"))
def fault_isolation(r: Roles) -> DataFrame:
    """Rows that fail are set apart and the rest of the run goes on."""
    good, bad = isolated(r.alert, F.when(F.col("k") == 13, F.lit("unlucky")))
    both = good.select("issuer_id", F.lit(1).alias("ok")).unionByName(bad.select("issuer_id", F.lit(0).alias("ok")))
    return both.groupBy("issuer_id").agg(F.count_if(F.col("ok") == 1).alias("done"), F.count_if(F.col("ok") == 0).alias("failed"))


@query("x04_replay", "X04", "SELECT alert_id FROM alert WHERE NOT (as_of_date < DATE '2024-01-16' AND k % 4 <> 0)")
def replay(r: Roles) -> DataFrame:
    """What was handled under the same version of the rules isn't handled again."""
    handled = r.alert.where("as_of_date < date '2024-01-16'").select("alert_id", F.when(F.col("k") % 4 == 0, "1").otherwise("2").alias("rule_version"))
    return unhandled(r.alert, handled, ["alert_id"], "2").select("alert_id")


@query("x06_process_once", "X06", "SELECT issuer_id, min(alert_id) AS alert_id FROM alert GROUP BY issuer_id")
def process_once(r: Roles) -> DataFrame:
    """An issuer is processed at its first candidate."""
    return first_by(r.alert, ["issuer_id"], F.asc("alert_id")).select("issuer_id", "alert_id")


@query("x07_cursor_sync", "X07 X09", "SELECT docket_id, entry_no FROM docket_entry e WHERE entry_no > coalesce((SELECT max(entry_no) FROM docket_entry h WHERE h.docket_id = e.docket_id AND h.role = 'user' AND h.entry_no <= 2), -1)")
def cursor_sync(r: Roles) -> DataFrame:
    """Entries past each docket's high-water mark."""
    mark = r.docket_entry.where("role = 'user' and entry_no <= 2").groupBy("docket_id").agg(F.max("entry_no").alias("mark"))
    return r.docket_entry.join(mark, "docket_id", "left").where(F.col("entry_no") > F.coalesce("mark", F.lit(-1))).select("docket_id", "entry_no")


@query(
    "x10_late_data",
    "X10 D07",
    "SELECT alert_id, CASE WHEN as_of_date > DATE '2024-01-26' AND as_of_date <= DATE '2024-01-29' THEN 'new' WHEN as_of_date <= DATE '2024-01-26' THEN 'historical' ELSE 'pending' END AS kind FROM alert",
)
def late_data(r: Roles) -> DataFrame:
    """Late rows are kept and told apart by when they happened, not when they came."""
    d, low, high = F.col("as_of_date"), F.lit("2024-01-26").cast("date"), F.lit("2024-01-29").cast("date")
    return r.alert.select("alert_id", F.when((d > low) & (d <= high), "new").when(d <= low, "historical").otherwise("pending").alias("kind"))


@query(
    "x15_synthesis",
    "X15 A14 W01",
    """WITH b AS (SELECT *, concat_ws(':', issuer_id, provider, k) AS bundle_key FROM alert WHERE severity <> 'low'), old AS (SELECT DISTINCT bundle_key FROM b WHERE as_of_date < DATE '2024-01-05')
    SELECT bundle_key, min(CASE severity WHEN 'high' THEN 'a-high' ELSE 'b-medium' END) AS worst, count(*) AS evidence FROM b WHERE bundle_key NOT IN (SELECT bundle_key FROM old) GROUP BY bundle_key""",
)
def synthesis(r: Roles) -> DataFrame:
    """Evidence bundled to alerts, but for bundles that have one."""
    b = r.alert.where("severity <> 'low'").withColumn("bundle_key", F.concat_ws(":", F.col("issuer_id").cast("string"), "provider", F.col("k").cast("string")))
    old = b.where("as_of_date < date '2024-01-05'").select("bundle_key")
    worst = F.min(F.when(F.col("severity") == "high", "a-high").otherwise("b-medium"))
    return b.join(old, "bundle_key", "left_anti").groupBy("bundle_key").agg(worst.alias("worst"), F.count("*").alias("evidence"))


@query("x22_lineage", "X22", "SELECT concat_ws(':', issuer_id, category) AS calculation, row_number() OVER (PARTITION BY issuer_id, category ORDER BY alert_id) - 1 AS position, alert_id AS input FROM alert")
def lineage(r: Roles) -> DataFrame:
    """A calculation's inputs in their order, one edge a row."""
    g = r.alert.groupBy("issuer_id", "category").agg(F.sort_array(F.collect_list("alert_id")).alias("inputs"))
    key = F.concat_ws(":", F.col("issuer_id").cast("string"), "category")
    return g.select(key.alias("calculation"), F.posexplode("inputs").alias("position", "input")).select("calculation", F.col("position").cast("long").alias("position"), "input")


@query("x01_watermark", "X01", "SELECT max(triggered_at) AS mark FROM alert WHERE as_of_date < DATE '2024-01-16'")
def watermark(r: Roles) -> DataFrame:
    """A watermark moves when a run has no errors, and stays when it has."""
    none = r.spark.sql("SELECT CAST(NULL AS TIMESTAMP_NTZ) AS mark")
    first = r.alert.where("as_of_date < date '2024-01-16'")
    _, no_errors = isolated(first, None)
    moved = advanced(none, first, "triggered_at", no_errors)
    _, errors = isolated(r.alert, F.when(F.col("k") == 13, F.lit("unlucky")))
    return advanced(moved, r.alert, "triggered_at", errors)
