"""The roles of the research model as views of the tables at hand, for Spark and as SQL.

Issuers are customers, securities their orders, alerts the events, capital-structure layers the lines
of an order (one for each order and line number), collections of issuers the nations, and a bridge of
many to many the suppliers of parts. Money is decimal(20,4) from the start.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(20,4)"


def choice(value: Column, pairs: dict[str, str], default: str | None = None) -> Column:
    """The text that goes with a text, as a chain of cases."""
    out = F
    for k, v in pairs.items():
        out = out.when(value == k, F.lit(v))
    return out.otherwise(F.lit(default))


SEVERITY = {"error": "high", "purchase": "medium", "signup": "medium"}
INSTRUMENT = {"F": "bond", "O": "term_loan", "P": "revolver"}


class Roles:
    """Role views of one folder of tables; each is planned when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def issuer(self) -> DataFrame:
        places = self.table("nation").join(F.broadcast(self.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))
        return self.table("customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("issuer_id"), F.col("c_name").alias("legal_name"), F.col("c_mktsegment").alias("sector"),
            F.col("n_nationkey").alias("country_id"), F.col("n_name").alias("country"), F.col("r_name").alias("region"), F.col("c_acctbal").cast(MONEY).alias("balance"),
        )

    @cached_property
    def security(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("security_id"), F.col("o_custkey").alias("issuer_id"), choice(F.col("o_orderstatus"), INSTRUMENT).alias("instrument_type"),
            F.col("o_totalprice").cast(MONEY).alias("amount"), F.to_date("o_orderdate").alias("maturity"), F.col("o_orderpriority").alias("priority"),
        )

    @cached_property
    def alert(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("long")
        e = self.table("events").select("*", k.alias("k"))
        return e.select(
            F.col("event_id").alias("alert_id"), F.col("user_id").alias("issuer_id"), F.col("event_type").alias("category"),
            choice(F.col("event_type"), SEVERITY, "low").alias("severity"), F.col("ts").alias("triggered_at"), F.to_date("ts").alias("as_of_date"),
            F.round(F.col("value").cast(MONEY) / 500, 4).cast(MONEY).alias("confidence"), "k",
            F.when(F.col("k") < 50, "new").when(F.col("k") < 80, "acknowledged").otherwise("dismissed").alias("status"),
            F.when(F.col("k") < 33, True).when(F.col("k") < 66, False).alias("is_subject"),
            F.when(F.col("k") % 2 == 0, "filings").otherwise("dockets").alias("provider"), (F.col("k") % 5 == 0).alias("ai_assisted"),
        )

    @cached_property
    def layer(self) -> DataFrame:
        lines = self.table("lineitem").groupBy(F.col("l_orderkey").alias("issuer_id"), F.col("l_linenumber").alias("rank_order"))
        return lines.agg(F.sum(F.col("l_extendedprice").cast(MONEY)).cast(MONEY).alias("amount"), F.max("l_returnflag").alias("lien"))

    @cached_property
    def collection(self) -> DataFrame:
        n = F.col("n_nationkey")
        kind = F.when(n % 5 == 0, "watchlist").otherwise("research_universe")
        return self.table("nation").select(n.cast("long").alias("collection_id"), F.col("n_name").alias("name"), kind.alias("collection_type"), F.lower(F.replace("n_name", F.lit("_"), F.lit("-"))).alias("slug"))

    @cached_property
    def membership(self) -> DataFrame:
        key = F.col("c_custkey")
        state = F.when(key % 3 == 0, "unverified").when(key % 3 == 1, "partial").otherwise("verified")
        return self.table("customer").select(F.col("c_nationkey").cast("long").alias("collection_id"), key.alias("issuer_id"), state.alias("verification"))

    @cached_property
    def supply(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_suppkey").alias("supplier_id"), F.col("l_partkey").alias("part_id")).distinct()

    @cached_property
    def docket_entry(self) -> DataFrame:
        return self.table("conversations").select(F.col("conv_id").alias("docket_id"), F.col("turn").alias("entry_no"), "role", "text")

    @cached_property
    def filing(self) -> DataFrame:
        return self.table("pages").select(F.col("page_id").alias("filing_id"), "url", "html")

    @cached_property
    def note(self) -> DataFrame:
        text = F.col("text")
        return self.table("benchmark").select(F.col("item_id").alias("note_id"), F.split_part(text, F.lit("."), F.lit(1)).alias("title"), text.alias("base_case"), (F.col("item_id") % 5 == 0).alias("is_archived"))

    @cached_property
    def document(self) -> DataFrame:
        return self.table("documents")


_K = r"CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"

#: The same views for DuckDB.
ROLE_SQL: dict[str, str] = {
    "issuer": """SELECT c_custkey AS issuer_id, c_name AS legal_name, c_mktsegment AS sector, n_nationkey AS country_id, n_name AS country, r_name AS region,
        CAST(c_acctbal AS DECIMAL(20,4)) AS balance
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "security": """SELECT o_orderkey AS security_id, o_custkey AS issuer_id, CASE o_orderstatus WHEN 'F' THEN 'bond' WHEN 'O' THEN 'term_loan' WHEN 'P' THEN 'revolver' END AS instrument_type,
        CAST(o_totalprice AS DECIMAL(20,4)) AS amount, CAST(o_orderdate AS DATE) AS maturity, o_orderpriority AS priority FROM orders""",
    "alert": f"""SELECT event_id AS alert_id, user_id AS issuer_id, event_type AS category,
        CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' WHEN 'signup' THEN 'medium' ELSE 'low' END AS severity,
        ts AS triggered_at, CAST(ts AS DATE) AS as_of_date, CAST(round(CAST(value AS DECIMAL(20,4)) / 500, 4) AS DECIMAL(20,4)) AS confidence, k,
        CASE WHEN k < 50 THEN 'new' WHEN k < 80 THEN 'acknowledged' ELSE 'dismissed' END AS status,
        CASE WHEN k < 33 THEN true WHEN k < 66 THEN false END AS is_subject,
        CASE WHEN k % 2 = 0 THEN 'filings' ELSE 'dockets' END AS provider, k % 5 = 0 AS ai_assisted
        FROM (SELECT *, {_K} AS k FROM events)""",
    "layer": """SELECT l_orderkey AS issuer_id, l_linenumber AS rank_order, CAST(sum(CAST(l_extendedprice AS DECIMAL(20,4))) AS DECIMAL(20,4)) AS amount, max(l_returnflag) AS lien
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "collection": """SELECT CAST(n_nationkey AS BIGINT) AS collection_id, n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'watchlist' ELSE 'research_universe' END AS collection_type,
        lower(replace(n_name, '_', '-')) AS slug FROM nation""",
    "membership": """SELECT CAST(c_nationkey AS BIGINT) AS collection_id, c_custkey AS issuer_id,
        CASE c_custkey % 3 WHEN 0 THEN 'unverified' WHEN 1 THEN 'partial' ELSE 'verified' END AS verification FROM customer""",
    "supply": "SELECT DISTINCT l_suppkey AS supplier_id, l_partkey AS part_id FROM lineitem",
    "docket_entry": "SELECT conv_id AS docket_id, turn AS entry_no, role, text FROM conversations",
    "filing": "SELECT page_id AS filing_id, url, html FROM pages",
    "note": "SELECT item_id AS note_id, split_part(text, '.', 1) AS title, text AS base_case, item_id % 5 = 0 AS is_archived FROM benchmark",
    "document": "SELECT * FROM documents",
}
