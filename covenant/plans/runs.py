"""Runs as streams into written stores, and the stores themselves (inventory A and L)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.bindings import Roles
from covenant.operators.rules import RULES, phrase_hits
from covenant.operators.storage import fresh_path
from covenant.plans.texts import _PHRASE_RULES, PHRASES
from covenant.registry import query
from covenant.sources.store import ATTEMPT_STATE, Store, record_attempts
from covenant.streaming.discovery import Stores, discovery_run, evidence_run, stream

#: Days at which arrivals are cut into batches.
CUTS = ("2024-01-09", "2024-01-20")


def _batch(day: str) -> str:
    return f"CASE WHEN {day} < DATE '{CUTS[0]}' THEN 0 WHEN {day} < DATE '{CUTS[1]}' THEN 1 ELSE 2 END"


#: Rows in a file of arrivals at most, so that tasks share them evenly however the rows lay before.
FILE_ROWS = 250_000


def _stage(rows: DataFrame, path: str) -> None:
    """Rows as files, those of a batch (``batch``) apart, in one pass over them."""
    rows.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("batch").parquet(f"{path}/staged")


def _arrive(rows: DataFrame, path: str, batch: int) -> None:
    """The staged files of a batch are moved to where a stream finds them; if it has no rows, an empty one comes."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path
    staged = at(f"{path}/staged/batch={batch}")
    fs = staged.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(staged):
        rows.drop("batch").limit(0).write.mode("append").parquet(f"{path}/arrivals")
        return
    fs.mkdirs(at(f"{path}/arrivals"))
    for f in fs.listStatus(staged):
        if not fs.rename(f.getPath(), at(f"{path}/arrivals/{batch}-{f.getPath().getName()}")):
            raise OSError(f"{f.getPath()} was not moved")


class _CutOff(RuntimeError):
    """A run that ends before it is done."""


def _restarted(rows: DataFrame, name: str, run) -> str:
    """Two arrivals are streamed, the second is cut off after its run was half written; then the third comes and the stream is started again.

    A stream takes all files that are there as one micro-batch, so it is started for each arrival."""
    spark = rows.sparkSession
    path = fresh_path(spark, name)
    _stage(rows, path)
    source = lambda: spark.readStream.schema(rows.drop("batch").schema).parquet(f"{path}/arrivals")

    def cut_off(df: DataFrame, n: int) -> None:
        run(path, df, n)
        if n == 1:
            raise _CutOff

    try:
        for b in (0, 1):
            _arrive(rows, path, b)
            stream(source(), f"{path}/checkpoint", cut_off).awaitTermination()
    except Exception as e:  # noqa: BLE001 - the stream wraps what its function raises
        if "_CutOff" not in str(e):
            raise
    _arrive(rows, path, 2)
    stream(source(), f"{path}/checkpoint", lambda df, n: run(path, df, n)).awaitTermination()
    return path


def _hits(r: Roles) -> DataFrame:
    k = F.col("k")
    return r.alert.select(
        F.col("alert_id").alias("hit_id"), "issuer_id", F.concat_ws("-", "category", k.cast("string")).alias("accession"), "provider", F.col("triggered_at").alias("at"), F.when(k == 13, "unlucky").alias("problem"),
        F.when(k % 10 == 9, "rejected").when(k % 10 == 8, "ambiguous").alias("verdict"), (F.col("severity") != "low").alias("relevant"), F.expr(_batch("as_of_date")).alias("batch"),
    )


def discovered(r: Roles) -> Stores:
    """The stores after discovery over three arrivals, with a restart."""
    known = r.issuer.where("issuer_id % 2 = 0").select("issuer_id")
    path = _restarted(_hits(r), "discovery", lambda path, df, n: discovery_run(df, known, Stores.at(df.sparkSession, path), n))
    return Stores.at(r.spark, path)


_DISCOVERED = f"""h AS (SELECT alert_id AS hit_id, issuer_id, category || '-' || k AS accession, provider, triggered_at AS seen_at, k = 13 AS bad, CASE WHEN k % 10 = 9 THEN 'rejected' WHEN k % 10 = 8 THEN 'ambiguous' END AS verdict,
        severity <> 'low' AS relevant, {_batch('as_of_date')} AS run FROM alert),
    f AS (SELECT run, issuer_id, accession, min(hit_id) AS hit_id, arg_min(provider, hit_id) AS provider, bool_or(bad) AS bad, any_value(verdict) AS verdict FROM h GROUP BY ALL),
    c0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY issuer_id, accession ORDER BY run) AS nth FROM f WHERE NOT bad) WHERE nth = 1),
    c AS (SELECT run, issuer_id, accession, hit_id, provider, coalesce(verdict, CASE WHEN issuer_id IN (SELECT issuer_id FROM issuer WHERE issuer_id % 2 = 0)
        OR row_number() OVER (PARTITION BY issuer_id, verdict IS NULL ORDER BY run, hit_id) > 1 THEN 'matched_existing' ELSE 'verified_new' END) AS outcome FROM c0),
    e AS (SELECT run, issuer_id, provider, count(*) AS evidence FROM h WHERE relevant AND EXISTS (SELECT 1 FROM c WHERE c.run = h.run AND c.issuer_id = h.issuer_id AND outcome IN ('matched_existing', 'verified_new')) GROUP BY ALL)"""


@query("x08_discovered_filings", "X08 X16", f"WITH {_DISCOVERED} SELECT CAST(run AS BIGINT) AS run, issuer_id, accession, hit_id, outcome FROM c")
def discovered_filings(r: Roles) -> DataFrame:
    """The candidates of a stream of three arrivals that was restarted: each filing once, with its run and what it was resolved to."""
    return discovered(r).candidates.read().select(F.col("_batch").alias("run"), "issuer_id", "accession", "hit_id", "outcome")


@query(
    "x02_discovery_runs",
    "X02",
    f"""WITH {_DISCOVERED}, n AS (SELECT h.run, count(*) AS examined, count(DISTINCT (issuer_id, accession)) AS candidates, max(seen_at) AS last FROM h GROUP BY run),
    x AS (SELECT run, count(DISTINCT (issuer_id, accession)) AS errors FROM h WHERE bad GROUP BY run),
    o AS (SELECT run, count(*) FILTER (WHERE outcome = 'matched_existing') AS resolved_existing, count(*) FILTER (WHERE outcome = 'verified_new') AS resolved_new, count(*) FILTER (WHERE outcome = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE outcome = 'rejected') AS rejected FROM c GROUP BY run),
    a AS (SELECT run, sum(evidence)::BIGINT AS evidence, count(*) FILTER (WHERE nth = 1) AS alerts FROM (SELECT *, row_number() OVER (PARTITION BY issuer_id, provider ORDER BY run) AS nth FROM e) GROUP BY run)
    SELECT CAST(run AS BIGINT) AS run, examined, candidates, coalesce(resolved_existing, 0) AS resolved_existing, coalesce(resolved_new, 0) AS resolved_new, coalesce(ambiguous, 0) AS ambiguous, coalesce(rejected, 0) AS rejected,
        coalesce(evidence, 0) AS evidence, coalesce(alerts, 0) AS alerts, coalesce(errors, 0) AS errors, CASE WHEN errors > 0 THEN 'completed_with_errors' ELSE 'success' END AS status,
        max(CASE WHEN errors > 0 THEN NULL ELSE last END) OVER (ORDER BY run) AS mark
    FROM n LEFT JOIN x USING (run) LEFT JOIN o USING (run) LEFT JOIN a USING (run)""",
)
def discovery_runs(r: Roles) -> DataFrame:
    """The rows of those runs: counters, how each ended, and the watermark, which stays where a run had errors."""
    return discovered(r).runs.read().drop("_batch")


@query(
    "x20_docket_evidence",
    "X20",
    f"""WITH p(rule, pattern) AS (VALUES {_PHRASE_RULES}), t AS (SELECT docket_id, entry_no, list_extract({list(PHRASES)}, CAST((docket_id + entry_no) % {len(PHRASES)} + 1 AS INTEGER)) || '. ' || text AS text FROM docket_entry)
    SELECT docket_id, entry_no, rule, CAST(docket_id % 3 AS BIGINT) AS run FROM t JOIN p ON regexp_matches(text, '(?i)' || pattern) WHERE rule <> 'phrase_chapter_11_bare_mention' OR NOT regexp_matches(substr(text, 1, 200), '(?i)(internal revenue code|title 11.{{0,20}}code|chapter 11 of the)')""",
)
def docket_evidence(r: Roles) -> DataFrame:
    """Evidence by phrase rules in docket entries as they arrive, each entry looked at once, with a restart."""
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), ((F.col("docket_id") + F.col("entry_no")) % len(PHRASES) + 1).cast("int"))
    entries = r.docket_entry.select("docket_id", "entry_no", F.concat(phrase, F.lit(". "), "text").alias("text"), (F.col("docket_id") % 3).cast("int").alias("batch"))
    stores = lambda spark, path: (Store(spark, f"{path}/done", "docket_id long, entry_no long", ["docket_id", "entry_no"]), Store(spark, f"{path}/evidence", "docket_id long, entry_no long, rule string"))

    def find(texts: DataFrame) -> DataFrame:
        return phrase_hits(texts, "text", RULES).select("docket_id", "entry_no", "rule")

    path = _restarted(entries, "docket-evidence", lambda path, df, n: evidence_run(df, ["docket_id", "entry_no"], find, *stores(df.sparkSession, path), n))
    return stores(r.spark, path)[1].read().select("docket_id", "entry_no", "rule", F.col("_batch").alias("run"))


@query("s24_append_log", "S24 S25 S36", f"SELECT alert_id, issuer_id, status, CAST({_batch('as_of_date')} AS BIGINT) AS batch FROM alert")
def append_log(r: Roles) -> DataFrame:
    """A log of events appended in three batches, one of them twice, compacted in between and read."""
    log = Store(r.spark, fresh_path(r.spark, "log"), "alert_id long, issuer_id long, status string")
    rows = r.alert.select("alert_id", "issuer_id", "status", F.expr(_batch("as_of_date")).alias("b"))
    for b in (0, 1, 1, 0):
        log.append(rows.where(F.col("b") == b), b)
    log.compact()
    log.append(rows.where("b = 2"), 2)
    return log.read().withColumnRenamed("_batch", "batch")


_STATUS = "CASE k % 5 WHEN 0 THEN 'complete' WHEN 1 THEN 'no_data' WHEN 2 THEN 'failed_retryable' WHEN 3 THEN 'ambiguous' ELSE 'running' END"


@query(
    "s38_attempt_outcomes",
    "S38",
    f"""WITH a AS (SELECT *, {_STATUS} AS outcome FROM alert)
    SELECT issuer_id, provider, arg_max(outcome, (triggered_at, alert_id)) AS status, max(triggered_at) AS last_attempt_at, max(triggered_at) FILTER (WHERE outcome IN ('complete', 'no_data')) AS last_success_at,
        arg_max(CASE WHEN outcome = 'failed_retryable' THEN triggered_at + INTERVAL 6 HOUR ELSE TIMESTAMP '1970-01-01' END, (triggered_at, alert_id)) AS retry, count(*) AS attempt_count,
        coalesce(arg_max(k, (triggered_at, alert_id)) FILTER (WHERE outcome = 'complete'), 0) AS records_found, arg_max(category, (triggered_at, alert_id)) FILTER (WHERE k % 7 = 0) AS checkpoint
    FROM a GROUP BY issuer_id, provider""",
)
def attempt_outcomes(r: Roles) -> DataFrame:
    """Outcomes of attempts written onto one state for each issuer and provider, in three batches with a replay and a compaction to the newest."""
    state = Store(r.spark, fresh_path(r.spark, "attempts"), ATTEMPT_STATE, ["issuer_id", "provider"])
    status, at = F.expr(_STATUS), F.col("triggered_at").cast("timestamp")
    rows = r.alert.select(
        "issuer_id", "provider", at.alias("at"), F.col("alert_id").alias("n"), status.alias("status"), F.when(status.isin("complete", "no_data"), at).alias("success_at"),
        F.when(status == "failed_retryable", at + F.expr("INTERVAL 6 HOURS")).alias("retry_at"), F.when(status == "complete", F.col("k")).alias("records"),
        F.when(status == "failed_retryable", "timeout").alias("error"), F.when(F.col("k") % 7 == 0, F.col("category")).alias("checkpoint"), F.expr(_batch("as_of_date")).alias("b"),
    )
    for b in (0, 1, 0, 1):
        record_attempts(state, rows.where(F.col("b") == b), b)
    state.compact(history=False)
    record_attempts(state, rows.where("b = 2"), 2)
    found = state.newest()
    ntz = lambda c: F.col(c).cast("timestamp_ntz")
    return found.select(
        "issuer_id", "provider", "status", ntz("last_attempt_at").alias("last_attempt_at"), ntz("last_success_at").alias("last_success_at"),
        F.coalesce(ntz("next_retry_at"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).alias("retry"), "attempt_count", "records_found", "checkpoint",
    )


@query(
    "s40_landed_texts",
    "S18 S40",
    "SELECT filing_id, url, sha256(html) AS checksum, length(html) AS n_chars, CASE WHEN filing_id % 3 = 0 THEN sha256('an earlier text of ' || filing_id) END AS earlier FROM filing",
)
def landed_texts(r: Roles) -> DataFrame:
    """Payloads landed with their checksum, once for each; one that has changed is landed again, and the newest counts."""
    store = Store(r.spark, fresh_path(r.spark, "payloads"), "filing_id long, url string, checksum string, body string", ["filing_id"])

    def land(rows: DataFrame, batch: int) -> None:
        rows = rows.select("filing_id", "url", F.sha2("html", 256).alias("checksum"), F.col("html").alias("body"))
        same = store.newest(before=batch).select("filing_id", "checksum")
        store.append(rows.join(same, ["filing_id", "checksum"], "left_anti"), batch)

    land(r.filing.where("filing_id % 3 = 0").withColumn("html", F.concat(F.lit("an earlier text of "), F.col("filing_id").cast("string"))), 0)
    land(r.filing, 1)
    land(r.filing, 2)
    versions = store.read().groupBy("filing_id").agg(F.max_by("checksum", F.when(F.col("_batch") == 0, 0)).alias("earlier"))
    return store.newest().join(versions, "filing_id").select("filing_id", "url", "checksum", F.length("body").alias("n_chars"), "earlier")
