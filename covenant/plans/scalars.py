"""Text, date, number and nested-value functions over the tables (inventory H to K)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.bindings import Roles
from covenant.functions import dates, numbers, text
from covenant.registry import query


@query(
    "t11_digits",
    "T11 T14",
    "SELECT issuer_id, regexp_replace(legal_name, '[^0-9]', '', 'g') AS digits, length(regexp_replace(legal_name, '[^0-9]', '', 'g')) >= 4 AND contains(regexp_replace(legal_name || ' no 77', '[^0-9]', '', 'g'), regexp_replace(legal_name, '[^0-9]', '', 'g')) AS found, lpad(CAST(issuer_id AS VARCHAR), 10, '0') AS padded FROM issuer",
)
def digits(r: Roles) -> DataFrame:
    name = F.col("legal_name")
    return r.issuer.select("issuer_id", text.digits(name).alias("digits"), text.number_in(F.concat(name, F.lit(" no 77")), name).alias("found"), text.padded_number(F.col("issuer_id").cast("string")).alias("padded"))


@query(
    "t12_truncated",
    "T12 T13",
    "SELECT doc_id, CASE WHEN length(trim(text)) > 60 THEN rtrim(substr(trim(text), 1, 59)) || '…' ELSE nullif(trim(text), '') END AS short, coalesce(nullif(substr(text, 1, doc_id % 2), ''), nullif(lang, ''), 'none') AS first_filled FROM document",
)
def truncated(r: Roles) -> DataFrame:
    filled = text.first_filled(F.substring(F.col("text"), F.lit(1), (F.col("doc_id") % 2).cast("int")), F.col("lang"), F.lit("none"))
    return r.document.select("doc_id", text.truncated(F.col("text"), 60).alias("short"), filled.alias("first_filled"))


@query(
    "t15_labels",
    "T15 T16 T17 M10 N08",
    """SELECT part_id, upper(substr(brand, 1, 1)) || lower(substr(brand, 2)) AS label, trim(regexp_replace(lower(p_type || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug, replace(replace(p_brand, '<', ''), ':', '') || '.pdf' AS file
    FROM (SELECT p_partkey AS part_id, replace(p_type, '_', ' ') AS brand, * FROM part)""",
)
def labels(r: Roles) -> DataFrame:
    p = r.table("part")
    return p.select(F.col("p_partkey").alias("part_id"), text.humanized(F.col("p_type")).alias("label"), text.slug(F.concat_ws(" ", "p_type", "p_brand")).alias("slug"), text.file_name(F.concat(F.lit("in/<:"), "p_brand", F.lit(".pdf"))).alias("file"))


@query(
    "t19_coupon_maturity",
    "T19 D10",
    """SELECT security_id, CAST(rate AS DECIMAL(10,4)) AS coupon, make_date(CASE WHEN yy < 50 THEN 2000 + yy ELSE 1900 + yy END, mm, dd) AS maturity FROM (
    SELECT security_id, security_id % 9 + 0.5 AS rate, CAST(strftime(maturity, '%y') AS BIGINT) AS yy, month(maturity) AS mm, day(maturity) AS dd FROM security)""",
)
def coupon_maturity(r: Roles) -> DataFrame:
    """Rate and date parsed from a description, with years under 50 of this century."""
    shown = F.concat(F.lit("NOTE "), (F.col("security_id") % 9).cast("string"), F.lit(".5 "), F.date_format("maturity", "MM/dd/yy"))
    s = r.security.select("security_id", shown.alias("d"))
    part = lambda n: F.regexp_extract("d", r"([0-9]{2})/([0-9]{2})/([0-9]{2})", n).cast("int")
    return s.select("security_id", text.coupon(F.col("d")).alias("coupon"), F.make_date(dates.two_digit_year(part(3)), part(1), part(2)).alias("maturity"))


@query("t20_unfenced", "T20 T21", "SELECT alert_id, 'k=' || k AS body, k BETWEEN 0 AND 50 AS valid FROM alert")
def unfenced(r: Roles) -> DataFrame:
    """A model's answer without its fence, read with a schema and held against its rules."""
    raw = F.concat(F.lit('```json\n{"body": "k='), F.col("k").cast("string"), F.lit('", "n": '), F.col("k").cast("string"), F.lit("}\n```"))
    parsed = F.from_json(text.unfenced(raw), "body string, n long")
    return r.alert.select("alert_id", parsed.alias("p")).select("alert_id", "p.body", F.col("p.n").between(0, 50).alias("valid"))


_MARKED = r"""'# Title' || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) || chr(10) || ' ' || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || chr(10) || '- x' || chr(10) || '2. y' || chr(10) || 'z'"""


@query(
    "t22_blocks",
    "T22 T23 T24 T25",
    rf"""WITH b AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array({_MARKED}, '\n\s*\n'), lambda x: trim(x)), lambda x: x <> '') AS b FROM document)
    SELECT doc_id, len(b) AS blocks, len(list_filter(b, lambda x: regexp_full_match(x, '(\s*\|.*\|\s*\n)+\s*\|.*\|\s*'))) AS tables,
    coalesce(list_sum(list_transform(b, lambda x: length(regexp_extract(x, '^(#{{1,6}})\s+[^\n]+$', 1)))), 0)::BIGINT AS levels,
    len(list_filter(b, lambda x: len(list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '^\s*([-*]|[0-9]+[.)])\s+'))) * 2 > len(string_split(x, chr(10))))) AS lists FROM b""".replace("\\\\", "\\"),
)
def blocks(r: Roles) -> DataFrame:
    """Blocks of texts with a heading, a table and a list added, and of which kind they are."""
    marked = F.concat(F.lit("# Title\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n \n| a | b |\n|---|---|\n\n- x\n2. y\nz"))
    b = r.document.select("doc_id", text.blocks(marked).alias("b"))
    n = lambda test: F.size(F.filter("b", test)).cast("long")
    levels = F.aggregate("b", F.lit(0).cast("long"), lambda total, x: total + text.heading_level(x))
    return b.select("doc_id", F.size("b").cast("long").alias("blocks"), n(text.is_table).alias("tables"), levels.alias("levels"), n(text.is_list).alias("lists"))


@query(
    "t26_word_split",
    "T26",
    """SELECT filing_id, len(string_split(p, chr(10))) AS pieces, sha256(p) AS checksum FROM (SELECT filing_id, list_reduce(string_split(replace(html, chr(10), ' '), ' '),
    lambda p, w: p || CASE WHEN length(split_part(p, chr(10), -1)) + 1 + length(w) <= 60 THEN ' ' ELSE chr(10) END || w) AS p FROM filing)""",
)
def word_split(r: Roles) -> DataFrame:
    """Texts cut at spaces into pieces of at most sixty characters, but for words that are longer."""
    pieces = text.packed_words(F.replace("html", F.lit("\n"), F.lit(" ")), 60)
    return r.filing.select("filing_id", pieces.alias("p")).select("filing_id", F.size("p").cast("long").alias("pieces"), F.sha2(F.array_join("p", "\n"), 256).alias("checksum"))


@query("t27_token_estimate", "T27", "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM document")
def token_estimate(r: Roles) -> DataFrame:
    return r.document.select("doc_id", text.estimated_tokens(F.col("text")).cast("long").alias("tokens"))


@query(
    "t28_sentences",
    "T28 T29",
    """SELECT issuer_id, category, n || CASE WHEN n = 1 THEN ' new signal of ' ELSE ' new signals of ' END || CASE category WHEN 'error' THEN 'bankruptcy' WHEN 'purchase' THEN 'an exchange offer' ELSE replace(category, '_', ' ') END AS headline
    FROM (SELECT issuer_id, category, count(*) AS n FROM alert WHERE status = 'new' GROUP BY issuer_id, category)""",
)
def sentences(r: Roles) -> DataFrame:
    g = r.alert.where("status = 'new'").groupBy("issuer_id", "category").agg(F.count("*").alias("n"))
    topic = F.coalesce(F.create_map(*map(F.lit, ("error", "bankruptcy", "purchase", "an exchange offer")))[F.col("category")], F.replace("category", F.lit("_"), F.lit(" ")))
    return g.select("issuer_id", "category", F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " new signal of ").otherwise(" new signals of "), topic).alias("headline"))


@query("t31_absolute_url", "T31", "SELECT filing_id, CASE WHEN filing_id % 2 = 0 THEN url ELSE 'https://host.example/p/' || filing_id END AS url FROM filing")
def absolute_url(r: Roles) -> DataFrame:
    raw = F.when(F.col("filing_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("/p/"), F.col("filing_id").cast("string")))
    return r.filing.select("filing_id", text.absolute_url(raw, "https://host.example").alias("url"))


@query("d01_iso_date", "D01 F33", "SELECT alert_id, CASE WHEN k % 2 = 0 THEN as_of_date END AS parsed FROM alert")
def iso_date(r: Roles) -> DataFrame:
    raw = F.when(F.col("k") % 2 == 0, F.col("triggered_at").cast("string")).otherwise(F.lit("not a date"))
    return r.alert.select("alert_id", dates.iso_date(raw).alias("parsed"))


@query(
    "d02_freshness",
    "D02",
    """SELECT alert_id, CASE WHEN age <= CASE source WHEN 'trades' THEN 0.25 WHEN 'identifiers' THEN 720 WHEN 'other' THEN 1 ELSE 24 END THEN 'live'
    WHEN age <= CASE source WHEN 'filings' THEN 168 WHEN 'trades' THEN 4 WHEN 'rates' THEN 720 WHEN 'identifiers' THEN 4320 ELSE 24 END THEN 'cached' ELSE 'stale' END AS tier
    FROM (SELECT alert_id, list_extract(['filings', 'trades', 'rates', 'identifiers', 'other'], CAST(k % 5 + 1 AS INTEGER)) AS source, epoch(TIMESTAMP '2024-01-31' - triggered_at) / 3600.0 / CASE WHEN alert_id % 2 = 0 THEN 100 ELSE 1 END AS age FROM alert)""",
)
def freshness(r: Roles) -> DataFrame:
    """How fresh data is by its provider's limits, on a fixed day; of every other row at a hundredth of its age."""
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    t = F.col("triggered_at").cast("timestamp")
    nearer = F.when(F.col("alert_id") % 2 == 0, F.timestamp_seconds(F.unix_micros(now) / 1e6 - (F.unix_micros(now) - F.unix_micros(t)) / 1e8)).otherwise(t)
    source = F.get(F.array(*map(F.lit, ("filings", "trades", "rates", "identifiers", "other"))), (F.col("k") % 5).cast("int"))
    return r.alert.select("alert_id", dates.freshness(source, nearer, now).alias("tier"))


@query(
    "d03_research_day",
    "D03 D04 D05 D08",
    """WITH d AS (SELECT alert_id, CAST(triggered_at - INTERVAL 5 HOUR AS DATE) AS day FROM alert)
    SELECT alert_id, day, day - CASE dayofweek(day) WHEN 1 THEN 3 WHEN 0 THEN 2 ELSE 1 END AS preceding, day - CASE dayofweek(day) WHEN 6 THEN 1 WHEN 0 THEN 2 ELSE 0 END AS business_day, CAST(day AS TIMESTAMP) + INTERVAL 5 HOUR AS begins FROM d""",
)
def research_day(r: Roles) -> DataFrame:
    """The New York day of an instant, the business days before and on it, and when it begins."""
    d = r.alert.select("alert_id", dates.research_day(F.col("triggered_at")).alias("day"))
    return d.select("alert_id", "day", dates.previous_business_day(F.col("day")).alias("preceding"), dates.business_day_on_or_before(F.col("day")).alias("business_day"), dates.day_start(F.col("day")).cast("timestamp_ntz").alias("begins"))


@query("d09_near_days", "D09", "SELECT security_id, maturity, abs(date_diff('day', maturity, DATE '1998-06-01')) <= 14 AS near FROM security")
def near_days(r: Roles) -> DataFrame:
    return r.security.select("security_id", "maturity", dates.within_days(F.col("maturity"), F.lit("1998-06-01").cast("date")).alias("near"))


_STATES = ("failed_retryable", "running", "complete", "no_data", "ambiguous", "manual_review_required", "unavailable", "failed_permanent", "blocked_entitlement", "unsupported")


@query(
    "d11_due",
    "D11",
    f"""WITH s AS (SELECT *, list_extract({list(_STATES)}, CAST(k % 11 + 1 AS INTEGER)) AS state, CASE WHEN alert_id % 5 > 0 THEN epoch(TIMESTAMP '2024-01-31' - triggered_at) / 3600.0 END AS age,
    CASE WHEN alert_id % 3 > 0 THEN triggered_at + INTERVAL 15 DAY END AS next_retry FROM alert)
    SELECT alert_id, CASE WHEN state IS NULL THEN true WHEN state = 'failed_retryable' THEN coalesce(next_retry <= TIMESTAMP '2024-01-31', true) WHEN state = 'running' THEN coalesce(age > 1, true)
    WHEN state IN ('complete', 'no_data') THEN coalesce(age > CASE provider WHEN 'filings' THEN 12 ELSE 168 END, true) WHEN state IN ('ambiguous', 'manual_review_required', 'unavailable') THEN coalesce(age > 72, true) ELSE false END AS due FROM s""",
)
def due(r: Roles) -> DataFrame:
    """Which entities are to be asked of their provider again, in every state and without some of their times."""
    now, at = F.lit("2024-01-31 00:00:00").cast("timestamp"), F.col("triggered_at").cast("timestamp")
    state = F.get(F.array(*map(F.lit, _STATES)), (F.col("k") % 11).cast("int"))
    seen = F.when(F.col("alert_id") % 5 > 0, at)
    retry = F.when(F.col("alert_id") % 3 > 0, at + F.expr("interval 15 days"))
    return r.alert.select("alert_id", dates.is_due(state, F.col("provider"), seen, seen, retry, now).alias("due"))


@query("d12_schedule_gate", "D12", "SELECT alert_id, hour(triggered_at - INTERVAL 5 HOUR) = 22 AND k % 2 = 0 AS runs FROM alert")
def schedule_gate(r: Roles) -> DataFrame:
    local = F.from_utc_timestamp(F.col("triggered_at").cast("timestamp"), dates.ZONE)
    return r.alert.select("alert_id", ((F.hour(local) == 22) & (F.col("k") % 2 == 0)).alias("runs"))


@query(
    "m01_money",
    "M01 M02 M09 M10",
    """SELECT security_id, CAST(round(amount / 3, 2) AS DECIMAL(20,2)) AS third, CAST(greatest(1000, least(amount, 200000)) AS DECIMAL(20,4)) AS clamped, CAST(round(amount * 100, 0) AS BIGINT) AS points,
    '$' || CASE WHEN amount >= 1000000000 THEN CAST(CAST(round(amount / 1000000000, 1) AS DECIMAL(20,1)) AS VARCHAR) || 'B' WHEN amount >= 1000000 THEN CAST(CAST(round(amount / 1000000, 1) AS DECIMAL(20,1)) AS VARCHAR) || 'M'
    WHEN amount >= 1000 THEN CAST(CAST(round(amount / 1000, 1) AS DECIMAL(20,1)) AS VARCHAR) || 'K' ELSE CAST(CAST(round(amount, 0) AS DECIMAL(20,0)) AS VARCHAR) END AS shown
    FROM (SELECT security_id, CAST(amount * CASE security_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 100 ELSE 100000 END AS DECIMAL(20,4)) AS amount FROM security)""",
)
def money(r: Roles) -> DataFrame:
    """Amounts of all orders of magnitude."""
    times = F.when(F.col("security_id") % 3 == 0, 1).when(F.col("security_id") % 3 == 1, 100).otherwise(100000)
    a = F.col("amount")
    low, high = (F.lit(x).cast("decimal(20,4)") for x in (1000, 200000))
    return r.security.withColumn("amount", (F.col("amount") * times).cast("decimal(20,4)")).select("security_id", numbers.cents(a / 3).alias("third"), numbers.clamped(a, low, high).cast("decimal(20,4)").alias("clamped"), numbers.basis_points(a).alias("points"), numbers.compact_money(a).alias("shown"))


@query(
    "m03_call_cost",
    "M03",
    "SELECT alert_id, CAST((k * p.i + k * p.o) / 1000000.0 AS DECIMAL(12,6)) AS cost FROM alert LEFT JOIN (VALUES ('error', 1, 5), ('purchase', 3, 15)) p(category, i, o) USING (category)",
)
def call_costs(r: Roles) -> DataFrame:
    """Tokens priced by model; null where the model has no price."""
    prices = r.spark.createDataFrame([("error", 1, 5), ("purchase", 3, 15)], "category string, i int, o int")
    return r.alert.join(F.broadcast(prices), "category", "left").select("alert_id", numbers.call_cost(F.col("k"), F.col("k"), F.col("i"), F.col("o")).alias("cost"))


@query(
    "m04_budget",
    "M04 X18",
    """WITH a AS (SELECT alert_id, as_of_date, confidence, row_number() OVER (PARTITION BY as_of_date ORDER BY alert_id) AS calls, sum(confidence) OVER (PARTITION BY as_of_date ORDER BY alert_id ROWS UNBOUNDED PRECEDING) - confidence AS spent FROM alert)
    SELECT alert_id, CASE WHEN confidence < 0.05 THEN 'deterministic' WHEN calls > 200 OR spent >= 20 THEN 'deferred' WHEN confidence < 0.3 THEN 'large' ELSE 'small' END AS route FROM a""",
)
def budget(r: Roles) -> DataFrame:
    """Which model each call goes to under a day's ceilings of calls and cost, in order of id."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("as_of_date").orderBy("alert_id").rowsBetween(Window.unboundedPreceding, 0)
    c = F.col("confidence")
    a = r.alert.select("alert_id", "confidence", F.count("*").over(w).alias("calls"), (F.sum(c).over(w) - c).alias("spent"))
    route = F.when(c < 0.05, "deterministic").when((F.col("calls") > 200) | (F.col("spent") >= 20), "deferred").when(c < 0.3, "large").otherwise("small")
    return a.select("alert_id", route.alias("route"))


@query("m07_checksum", "M07", "SELECT filing_id, sha256(html) AS checksum, octet_length(encode(html)) AS bytes, sha256(url) AS request_key FROM filing")
def checksums(r: Roles) -> DataFrame:
    return r.filing.select("filing_id", numbers.checksum(F.col("html")).alias("checksum"), F.octet_length("html").cast("long").alias("bytes"), numbers.request_key(F.col("url")).alias("request_key"))


@query("m08_request_key", "M08", """SELECT filing_id, sha256(url || '|{"bytes":' || length(html) || ',"filing_id":' || filing_id || '}') AS request_key FROM filing""")
def request_keys(r: Roles) -> DataFrame:
    """The key of a request with a body, which is JSON of sorted keys."""
    key = numbers.request_key(F.col("url"), F.to_json(F.struct(F.length("html").alias("bytes"), "filing_id")))
    return r.filing.select("filing_id", key.alias("request_key"))


@query(
    "n01_explode_dedup",
    "N01 X05 X06",
    "SELECT part_id, supplier_id, first_order FROM (SELECT l_partkey AS part_id, l_suppkey AS supplier_id, min(l_orderkey) AS first_order FROM lineitem GROUP BY l_partkey, l_suppkey)",
)
def explode_dedup(r: Roles) -> DataFrame:
    """Hits that name several keys, one row for each key, the first hit of each pair."""
    hits = r.table("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.collect_list("l_suppkey").alias("keys")).select("l_orderkey", "l_partkey", F.explode(F.array_distinct("keys")).alias("supplier_id"))
    return hits.groupBy(F.col("l_partkey").alias("part_id"), "supplier_id").agg(F.min("l_orderkey").alias("first_order"))


@query("n03_json_column", "N03 N04", "SELECT alert_id, k AS k, category AS kind FROM alert")
def json_column(r: Roles) -> DataFrame:
    """A record written as JSON and read back under its schema."""
    snapshot = F.to_json(F.struct("k", F.struct(F.col("category").alias("kind")).alias("ref")))
    back = F.from_json(snapshot, "k long, ref struct<kind: string>")
    return r.alert.select("alert_id", back.alias("b")).select("alert_id", "b.k", "b.ref.kind")


@query(
    "n10_forms_split",
    "N10",
    "SELECT issuer_id, string_agg(DISTINCT priority, ',' ORDER BY priority) FILTER (WHERE priority NOT LIKE '%LOW') AS base, string_agg(DISTINCT priority, ',' ORDER BY priority) FILTER (WHERE priority LIKE '%LOW') AS amended FROM security GROUP BY issuer_id",
)
def forms_split(r: Roles) -> DataFrame:
    g = r.security.groupBy("issuer_id").agg(F.array_sort(F.collect_set("priority")).alias("f"))
    shown = lambda c: F.nullif(F.array_join(c, ","), F.lit(""))
    return g.select("issuer_id", shown(F.filter("f", lambda x: ~F.endswith(x, F.lit("LOW")))).alias("base"), shown(F.filter("f", lambda x: F.endswith(x, F.lit("LOW")))).alias("amended"))


@query(
    "n11_nested_any",
    "N11 F34",
    "SELECT docket_id, bool_or(role <> 'system' AND length(text) > 300) AS has_long, string_agg(CASE WHEN role <> 'system' THEN substr(text, 1, 5) END, '|' ORDER BY entry_no) AS heads FROM docket_entry GROUP BY docket_id",
)
def nested_any(r: Roles) -> DataFrame:
    """Tests and texts over the entries nested in a docket."""
    g = r.docket_entry.groupBy("docket_id").agg(F.sort_array(F.collect_list(F.struct("entry_no", "role", F.length("text").alias("n"), F.substring("text", 1, 5).alias("head")))).alias("e"))
    open_ = lambda x: x["role"] != "system"
    heads = F.transform(F.filter("e", open_), lambda x: x["head"])
    return g.select("docket_id", F.exists("e", lambda x: open_(x) & (x["n"] > 300)).alias("has_long"), F.when(F.size(heads) > 0, F.array_join(heads, "|")).alias("heads"))
