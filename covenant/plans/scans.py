"""Sources and sinks (inventory A): payloads read by schema, and tables after inserts, upserts and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.bindings import Roles
from covenant.operators.relational import insert_missing, patched, upsert
from covenant.registry import query
from covenant.sources import payloads

_SPLIT = """e AS (SELECT security_id, issuer_id, amount, priority FROM security WHERE security_id % 2 = 0),
i AS (SELECT security_id, issuer_id, CAST(amount + 1 AS DECIMAL(20,4)) AS amount, '0-NEW' AS priority FROM security WHERE instrument_type = 'bond')"""


def _existing(r: Roles) -> DataFrame:
    return r.security.where("security_id % 2 = 0").select("security_id", "issuer_id", "amount", "priority")


def _incoming(r: Roles) -> DataFrame:
    return r.security.where("instrument_type = 'bond'").select("security_id", "issuer_id", (F.col("amount") + 1).cast("decimal(20,4)").alias("amount"), F.lit("0-NEW").alias("priority"))


@query("s26_get_or_create", "S26 S27", f"WITH {_SPLIT} SELECT *, false AS created FROM e UNION ALL SELECT *, true FROM i WHERE security_id NOT IN (SELECT security_id FROM e)")
def get_or_create(r: Roles) -> DataFrame:
    return insert_missing(_existing(r), _incoming(r), ["security_id"])


@query(
    "s28_upsert",
    "S28 S29",
    f"WITH {_SPLIT} SELECT coalesce(e.security_id, i.security_id) AS security_id, coalesce(e.issuer_id, i.issuer_id) AS issuer_id, coalesce(i.amount, e.amount) AS amount, coalesce(e.priority, i.priority) AS priority FROM e FULL JOIN i ON e.security_id = i.security_id",
)
def upserted(r: Roles) -> DataFrame:
    """Everything is overwritten but what an existing row keeps."""
    return upsert(_existing(r), _incoming(r), ["security_id"], keep=("issuer_id", "priority"))


@query(
    "s30_monotone_upsert",
    "S30",
    """WITH o AS (SELECT issuer_id, CAST(issuer_id % 3 AS INTEGER) AS rank FROM membership), n AS (SELECT issuer_id, CAST(issuer_id % 4 AS INTEGER) AS rank FROM membership WHERE issuer_id % 2 = 0)
    SELECT issuer_id, greatest(o.rank, coalesce(n.rank, 0)) AS rank FROM o LEFT JOIN n USING (issuer_id)""",
)
def monotone_upsert(r: Roles) -> DataFrame:
    """A row is replaced only by one of higher rank."""
    old = r.membership.select("issuer_id", (F.col("issuer_id") % 3).cast("int").alias("rank"))
    new = r.membership.where("issuer_id % 2 = 0").select("issuer_id", (F.col("issuer_id") % 4).cast("int").alias("rank"))
    return upsert(old, new, ["issuer_id"], only_if=F.col("n.rank") > F.col("o.rank"))


@query("s32_cascading_delete", "S32", "SELECT issuer_id, collection_id FROM membership WHERE collection_id NOT IN (SELECT collection_id FROM collection WHERE slug LIKE '%-1%')")
def cascading_delete(r: Roles) -> DataFrame:
    """What is left of the memberships when collections go."""
    return r.membership.join(F.broadcast(r.collection.where("slug like '%-1%'")), "collection_id", "left_anti").select("issuer_id", "collection_id")


@query("s33_soft_delete", "S33", "SELECT security_id, CASE WHEN maturity < DATE '1996-01-01' THEN maturity WHEN instrument_type = 'bond' THEN DATE '2024-01-31' END AS archived_on FROM security")
def soft_delete(r: Roles) -> DataFrame:
    """Archiving again changes nothing."""
    before = F.when(F.col("maturity") < F.lit("1996-01-01").cast("date"), F.col("maturity"))
    return r.security.select("security_id", F.coalesce(before, F.when(F.col("instrument_type") == "bond", F.lit("2024-01-31").cast("date"))).alias("archived_on"))


@query("s34_patch", "S34 N05", f"WITH {_SPLIT} SELECT e.security_id, e.issuer_id, coalesce(i.amount, e.amount) AS amount, coalesce(i.priority, e.priority) AS priority FROM e LEFT JOIN i USING (security_id)")
def patch(r: Roles) -> DataFrame:
    changes = _incoming(r).drop("issuer_id")
    return patched(_existing(r), changes, ["security_id"])


@query(
    "s37_current_promotion",
    "S37 W17",
    "SELECT security_id, row_number() OVER (PARTITION BY issuer_id ORDER BY maturity DESC, security_id) = 1 AS is_current FROM security",
)
def current_promotion(r: Roles) -> DataFrame:
    """One current row a key: the newest."""
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("issuer_id").orderBy(F.desc("maturity"), "security_id"))
    return r.security.select("security_id", (n == 1).alias("is_current"))


def _payloads(r: Roles, fields: str, of: str = "issuer_id", rows: str = "security") -> DataFrame:
    """A captured payload for each of ``of``: JSON of an expression over its rows."""
    return getattr(r, rows).groupBy(of).agg(F.expr(f"to_json({fields}, map('ignoreNullFields', 'false'))").alias("body")).select("body")


_SORTED = "transform(array_sort(collect_list(struct(security_id, {0} AS v))), x -> x.v)"


@query(
    "s05_parallel_arrays",
    "S05",
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY issuer_id ORDER BY security_id) AS n, count(*) OVER (PARTITION BY issuer_id) AS total FROM security)
    SELECT CAST(issuer_id AS VARCHAR) AS cik, 'a-' || security_id AS accession, priority AS form, CASE WHEN security_id % 5 > 0 THEN maturity END AS filed, CASE WHEN security_id % 7 > 0 THEN instrument_type END AS items
    FROM s WHERE n <= total - CASE WHEN issuer_id % 3 = 0 THEN 1 ELSE 0 END""",
)
def parallel_arrays(r: Roles) -> DataFrame:
    """A submissions payload for each issuer, with a column an array; the shortest decides how many rows."""
    array = {
        "accessionNumber": "concat('a-', CAST(security_id AS STRING))", "form": "priority", "filingDate": "CASE WHEN security_id % 5 > 0 THEN CAST(maturity AS STRING) ELSE '' END",
        "items": "CASE WHEN security_id % 7 > 0 THEN instrument_type ELSE '' END",
    }
    arrays = {k: _SORTED.format(v) for k, v in array.items()}
    arrays["form"] = f"slice({arrays['form']}, 1, CAST(count(*) - IF(first(issuer_id) % 3 = 0, 1, 0) AS INT))"
    recent = ", ".join(f"'{k}', {v}" for k, v in arrays.items())
    return payloads.recent_filings(_payloads(r, f"named_struct('cik', CAST(first(issuer_id) AS STRING), 'filings', named_struct('recent', named_struct({recent})))"))


@query(
    "s06_company_facts",
    "S06",
    "SELECT instrument_type AS concept, CASE WHEN security_id % 2 = 0 THEN 'USD' ELSE 'EUR' END AS unit, maturity AS ends_on, amount, CAST(year(maturity) AS INTEGER) AS fy, 'Q' || quarter(maturity) AS fp FROM security WHERE instrument_type IS NOT NULL",
)
def company_facts(r: Roles) -> DataFrame:
    """Facts in a map of concepts of maps of units, a payload for each issuer."""
    point = "named_struct('end', CAST(maturity AS STRING), 'val', amount, 'fy', year(maturity), 'fp', concat('Q', quarter(maturity)))"
    points = r.security.where("instrument_type IS NOT NULL").groupBy("issuer_id", F.col("instrument_type").alias("concept"), F.expr("IF(security_id % 2 = 0, 'USD', 'EUR')").alias("unit")).agg(F.collect_list(F.expr(point)).alias("points"))
    units = points.groupBy("issuer_id", "concept").agg(F.map_from_entries(F.collect_list(F.struct("unit", "points"))).alias("units"))
    facts = units.groupBy("issuer_id").agg(F.map_from_entries(F.collect_list(F.struct("concept", F.struct("units")))).alias("concepts"))
    return payloads.company_facts(facts.select(F.to_json(F.struct(F.struct(F.col("concepts").alias("us-gaap")).alias("facts"))).alias("body")))


@query("s12_observations", "S12", "SELECT as_of_date AS day, confidence AS amount FROM alert WHERE k % 10 > 0")
def observations(r: Roles) -> DataFrame:
    """A series for each issuer, whose missing values are dots."""
    return payloads.observations(_payloads(r, "named_struct('observations', collect_list(named_struct('date', CAST(as_of_date AS STRING), 'value', IF(k % 10 > 0, CAST(confidence AS STRING), '.'))))", rows="alert"))


@query(
    "s13_bond_search",
    "S13 F23",
    "SELECT 'BBG' || security_id AS figi, priority AS description FROM (SELECT *, row_number() OVER (PARTITION BY issuer_id ORDER BY security_id) AS n FROM security WHERE security_id % 3 > 0) WHERE n <= 5",
)
def bond_search(r: Roles) -> DataFrame:
    """Of the hits of one exchange the first five, in their order, for each issuer that is searched."""
    hit = "named_struct('figi', concat('BBG', CAST(security_id AS STRING)), 'exchCode', IF(security_id % 3 > 0, 'TRACE', 'LSE'), 'ticker', priority)"
    return payloads.bonds(_payloads(r, f"named_struct('data', {_SORTED.format(hit)})"))


@query(
    "s17_ticker_map",
    "S17",
    "SELECT sector || '-' || country_id AS ticker, CAST(max(issuer_id) AS INTEGER) AS cik, arg_max(legal_name, issuer_id) AS title FROM issuer GROUP BY sector, country_id",
)
def ticker_map(r: Roles) -> DataFrame:
    """A map of rows for each country to one row a ticker, the last one counting, whatever its case."""
    named = "named_struct('ticker', concat(IF(issuer_id % 2 = 0, lower(sector), sector), '-', CAST(country_id AS STRING)), 'cik_str', CAST(issuer_id AS INT), 'title', legal_name)"
    return payloads.tickers(_payloads(r, f"map_from_entries(collect_list(struct(CAST(issuer_id AS STRING), {named})))", "country_id", "issuer"))


@query("s18_json_props", "S18", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, sha256(props) AS fingerprint FROM events")
def json_props(r: Roles) -> DataFrame:
    return r.table("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.sha2("props", 256).alias("fingerprint"))
