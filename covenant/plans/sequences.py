"""States that go from attempt to attempt, budgets over running totals, and nested merges (inventory J, L and M)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.bindings import Roles
from covenant.operators.nested import merged
from covenant.operators.running import within_budget
from covenant.operators.states import enriched
from covenant.registry import query

_PROVIDER = "CASE k % 3 WHEN 0 THEN 'filings' WHEN 1 THEN 'dockets' ELSE 'bonds' END"
#: What an attempt comes to: of every provider, then of dockets, then of the others. Null is an error.
_OUTCOME = """CASE WHEN k = 13 THEN NULL WHEN k = 14 THEN 'running' WHEN k = 15 THEN 'failed_permanent' WHEN k = 16 THEN 'blocked_entitlement' WHEN k % 17 = 3 THEN 'unavailable'
    WHEN k % 3 = 0 AND issuer_id % 13 = 0 THEN 'unsupported' WHEN k % 3 = 1 AND severity = 'low' AND k > 90 THEN 'unsupported'
    WHEN k % 3 = 1 AND k % 5 = 2 THEN 'manual_review_required' WHEN k % 3 = 1 AND k % 5 = 3 THEN 'ambiguous' WHEN k % 4 = 0 THEN 'no_data' ELSE 'complete' END"""
_SETTLED = "('complete', 'no_data')"


@query(
    "x14_enrichment_states",
    "X14 X23 X24",
    f"""WITH RECURSIVE a AS (SELECT issuer_id, {_PROVIDER} AS provider, triggered_at AS happened, alert_id AS n, {_OUTCOME} AS outcome, CASE WHEN k % 7 > 0 THEN k END AS records FROM alert),
    o AS (SELECT *, row_number() OVER (PARTITION BY issuer_id, provider ORDER BY happened, n) AS nth FROM a),
    r AS (SELECT issuer_id, provider, CAST(0 AS BIGINT) AS nth, CAST(NULL AS TIMESTAMP) AS happened, CAST(NULL AS BIGINT) AS n, CAST(NULL AS BOOLEAN) AS allowed, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS TIMESTAMP) AS last_attempt,
            CAST(NULL AS TIMESTAMP) AS last_success, CAST(NULL AS TIMESTAMP) AS next_retry, CAST(0 AS BIGINT) AS attempts, CAST(0 AS BIGINT) AS records FROM (SELECT DISTINCT issuer_id, provider FROM o)
        UNION ALL SELECT issuer_id, provider, nth, happened, n, allowed, CASE WHEN NOT allowed THEN status ELSE coalesce(outcome, 'failed_retryable') END, CASE WHEN allowed THEN happened ELSE last_attempt END,
            CASE WHEN allowed AND outcome IN {_SETTLED} THEN happened ELSE last_success END, CASE WHEN NOT allowed THEN next_retry WHEN outcome IS NULL THEN happened + INTERVAL 6 HOUR END,
            attempts + CASE WHEN allowed THEN 1 ELSE 0 END, CASE WHEN allowed AND found IS NOT NULL THEN found ELSE records END
        FROM (SELECT o.issuer_id, o.provider, o.nth, o.happened, o.n, o.outcome, o.records AS found, r.status, r.last_attempt, r.last_success, r.next_retry, r.attempts, r.records,
            CASE WHEN r.status IS NULL THEN true WHEN r.status = 'failed_retryable' THEN r.next_retry IS NULL OR r.next_retry <= o.happened WHEN r.status = 'running' THEN o.happened - r.last_attempt > INTERVAL 1 HOUR
                WHEN r.status IN {_SETTLED} THEN o.happened - r.last_success > CASE o.provider WHEN 'filings' THEN INTERVAL 12 HOUR WHEN 'dockets' THEN INTERVAL 168 HOUR ELSE INTERVAL 720 HOUR END
                WHEN r.status IN ('ambiguous', 'manual_review_required', 'unavailable') THEN o.happened - r.last_attempt > INTERVAL 72 HOUR ELSE false END AS allowed
            FROM r JOIN o ON o.issuer_id = r.issuer_id AND o.provider = r.provider AND o.nth = r.nth + 1))
    SELECT issuer_id, provider, n, allowed, status, last_success, next_retry, attempts, records FROM r WHERE nth > 0""",
)
def enrichment_states(r: Roles) -> DataFrame:
    """Every attempt to enrich an issuer from three providers: whether the state before it allows it, and the state after."""
    rows = r.alert.select("issuer_id", F.expr(_PROVIDER).alias("provider"), F.col("triggered_at").alias("at"), F.col("alert_id").alias("n"), F.expr(_OUTCOME).alias("outcome"), F.expr("CASE WHEN k % 7 > 0 THEN k END").alias("records"))
    return enriched(rows).select("issuer_id", "provider", "n", "allowed", "status", "last_success", "next_retry", "attempts", "records")


#: Ceilings of a run: calls, cost, large calls.
CEILINGS = (170, 40, 45)
_COST = {"small": "confidence / 4", "large": "confidence * 2"}


@query(
    "m04_budget_routes",
    "M04 X18",
    f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY as_of_date ORDER BY alert_id) AS nth, confidence >= 0.05 AS asks, severity = 'high' AS direct, k % 4 = 0 AS unsure FROM alert),
    s AS (SELECT as_of_date, CAST(0 AS BIGINT) AS nth, CAST(NULL AS BIGINT) AS alert_id, CAST(NULL AS VARCHAR) AS route, CAST(0 AS BIGINT) AS calls, CAST(0 AS BIGINT) AS larges, CAST(0 AS DECIMAL(38,8)) AS cost FROM (SELECT DISTINCT as_of_date FROM b)
        UNION ALL SELECT as_of_date, nth, alert_id, CASE WHEN NOT asks THEN 'deterministic' WHEN large THEN 'large' WHEN small THEN 'small' ELSE 'deferred' END,
            calls + CASE WHEN small THEN 1 ELSE 0 END + CASE WHEN large THEN 1 ELSE 0 END, larges + CASE WHEN large THEN 1 ELSE 0 END,
            CAST(cost + CASE WHEN small THEN CAST(confidence / 4 AS DECIMAL(20,8)) ELSE 0 END + CASE WHEN large THEN CAST(confidence * 2 AS DECIMAL(20,8)) ELSE 0 END AS DECIMAL(38,8))
        FROM (SELECT *, asks AND (direct OR unsure) AND larges < {CEILINGS[2]} AND calls + CASE WHEN small THEN 1 ELSE 0 END < {CEILINGS[0]} AND cost + CASE WHEN small THEN CAST(confidence / 4 AS DECIMAL(20,8)) ELSE 0 END < {CEILINGS[1]} AND (direct OR small) AS large
            FROM (SELECT b.*, s.calls, s.larges, s.cost, b.asks AND NOT b.direct AND s.calls < {CEILINGS[0]} AND s.cost < {CEILINGS[1]} AS small FROM s JOIN b ON b.as_of_date = s.as_of_date AND b.nth = s.nth + 1)))
    SELECT alert_id, route, calls AS calls_made, larges AS large_calls, CAST(cost AS DOUBLE) AS spent FROM s WHERE nth > 0""",
)
def budget_routes(r: Roles) -> DataFrame:
    """Where each bundle of a day's run goes under ceilings on calls, cost and large calls: those of high impact to the large model, others to the
    small one and, where it isn't sure, on to the large; and what the run has made and spent by then."""
    c, direct = F.col("confidence"), F.col("severity") == "high"
    asks = r.alert.select("as_of_date", "alert_id", (c >= 0.05).alias("asks"), direct.alias("direct"), (F.col("k") % 4 == 0).alias("unsure"), (c / 4).cast("decimal(20,8)").alias("small_cost"), (c * 2).cast("decimal(20,8)").alias("large_cost"))
    call = lambda step, large, cost: F.struct(F.lit(step).alias("step"), F.lit(large).alias("is_large"), F.col(cost).alias("cost"))
    small = F.when(~F.col("direct"), call(1, False, "small_cost"))
    large = F.when(F.col("direct") | F.col("unsure"), call(2, True, "large_cost"))
    calls = asks.where("asks").select("as_of_date", "alert_id", F.inline(F.array_compact(F.array(small, large))))
    made = within_budget(calls, ["as_of_date"], "alert_id", ["step"], "cost", "is_large", *CEILINGS)
    passed = lambda which: F.max(F.when(which, F.col("passes")).otherwise(False))
    routes = made.groupBy("as_of_date", "alert_id").agg(
        passed(F.col("is_large")).alias("large"), passed(~F.col("is_large")).alias("small"), F.sum(F.when(F.col("passes"), F.col("cost")).otherwise(0)).alias("cost"),
    )
    every = asks.join(routes, ["as_of_date", "alert_id"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("large", "small")})
    from covenant.operators.running import before_each

    own = {"calls_made": F.col("large").cast("long") + F.col("small").cast("long"), "large_calls": F.col("large").cast("long"), "spent": F.coalesce("cost", F.lit(0)).cast("decimal(20,8)")}
    sums = before_each(every, ["as_of_date"], "alert_id", [], own)
    route = F.when(~F.col("asks"), "deterministic").when(F.col("large"), "large").when(F.col("small"), "small").otherwise("deferred")
    return sums.select("alert_id", route.alias("route"), *((F.col(k) + v).cast("double" if k == "spent" else "long").alias(k) for k, v in own.items()))


#: Documents of an entry, as they are stored and as they are fetched: some only here, some only there, some in both.
_STORED_DOCS, _FETCHED_DOCS = "d % 3 <> 1", "d % 3 <> 2"


@query(
    "x19_docket_merge",
    "X19 X07 J23",
    f"""WITH e AS (SELECT docket_id, entry_no, text, unnest(range(0, 2 + length(text) % 5)) AS d FROM docket_entry),
    old AS (SELECT docket_id, entry_no, d, 'stored ' || length(text) || '/' || d AS body FROM e WHERE entry_no <= 2 AND {_STORED_DOCS}),
    new AS (SELECT docket_id, entry_no, d, CASE WHEN (d + docket_id) % 4 <> 0 THEN 'fetched ' || length(text) || '/' || d END AS body, (d + docket_id) % 4 = 0 AS sealed FROM e WHERE entry_no >= 1 AND {_FETCHED_DOCS}),
    m AS (SELECT docket_id, entry_no, d, CASE WHEN new.sealed THEN NULL WHEN old.d IS NOT NULL THEN old.body ELSE new.body END AS body, coalesce(sealed, false) AS sealed, old.d IS NULL AS added FROM old FULL JOIN new USING (docket_id, entry_no, d)),
    x AS (SELECT docket_id, entry_no, count(*) AS documents, count(*) FILTER (WHERE added) AS added, string_agg(d || ':' || coalesce(body, 'sealed'), '|' ORDER BY d) AS held FROM m GROUP BY docket_id, entry_no),
    n AS (SELECT docket_id, entry_no, min(entry_no <= 2) AS stored FROM docket_entry GROUP BY docket_id, entry_no)
    SELECT docket_id, count(*) AS entries, count(*) FILTER (WHERE NOT stored) AS entries_added, CAST(coalesce(sum(documents), 0) AS BIGINT) AS documents, string_agg(entry_no || '(' || coalesce(held, '') || ')', ' ' ORDER BY entry_no) AS held FROM n LEFT JOIN x USING (docket_id, entry_no) GROUP BY docket_id""",
)
def docket_merge(r: Roles) -> DataFrame:
    """Fetched pages of a docket merged into its stored entries: what is stored stays with its documents, new entries and documents come in,
    and documents that are sealed now lose their text."""
    d = F.sequence(F.lit(0), 1 + F.length("text") % 5)

    def documents(where: str, name: str, sealed) -> F.Column:
        kept = F.filter(d, lambda i: (i % 3 != 1) if where == _STORED_DOCS else (i % 3 != 2))
        return F.transform(kept, lambda i: F.struct(i.alias("d"), F.when(~sealed(i), F.concat(F.lit(f"{name} "), F.length("text").cast("string"), F.lit("/"), i.cast("string"))).alias("body"), sealed(i).alias("sealed")))

    never, some = (lambda i: F.lit(False)), (lambda i: (i + F.col("docket_id")) % 4 == 0)
    entry = lambda docs: F.struct("entry_no", docs.alias("documents"))
    stored = F.when(F.col("entry_no") <= 2, entry(documents(_STORED_DOCS, "stored", never)))
    fetched = F.when(F.col("entry_no") >= 1, entry(documents(_FETCHED_DOCS, "fetched", some)))
    dockets = r.docket_entry.groupBy("docket_id").agg(F.collect_list(stored).alias("stored"), F.collect_list(fetched).alias("fetched"))

    def of_document(old, new):
        return F.struct(old["d"].alias("d"), F.when(~new["sealed"], old["body"]).alias("body"), new["sealed"].alias("sealed"))

    def of_entry(old, new):
        return F.struct(old["entry_no"].alias("entry_no"), merged(old["documents"], new["documents"], "d", of_document).alias("documents"))

    both = dockets.select("docket_id", F.size("stored").alias("had"), merged(F.col("stored"), F.col("fetched"), "entry_no", of_entry).alias("entries"))
    told = lambda e: F.concat(e["entry_no"].cast("string"), F.lit("("), F.array_join(F.transform(e["documents"], lambda x: F.concat(x["d"].cast("string"), F.lit(":"), F.coalesce(x["body"], F.lit("sealed")))), "|"), F.lit(")"))
    return both.select(
        "docket_id", F.size("entries").cast("long").alias("entries"), (F.size("entries") - F.col("had")).cast("long").alias("entries_added"),
        F.aggregate("entries", F.lit(0).cast("long"), lambda n, e: n + F.size(e["documents"])).alias("documents"), F.array_join(F.transform("entries", told), " ").alias("held"),
    )
