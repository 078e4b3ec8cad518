"""Matching records by what their texts hold, and what to make of several matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.functions.dates import within_days
from covenant.functions.text import company_key, digits, number_in

ANCHOR = 3


def normalized(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def contained(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id) where an item's normalized text stands in a document's at word boundaries.

    Documents give each run of three words once, items their first three, and the two are joined on
    them; an item of fewer words is compared on what it has, its first word. The texts themselves are
    tested only where the run agrees.
    """
    docs = texts.select("doc_id", normalized(F.col("text")).alias("t")).withColumn("w", F.split("t", " "))
    at = lambda i: F.array_join(F.slice("w", i + 1, ANCHOR), " ")
    runs = F.array_distinct(F.when(F.size("w") >= ANCHOR, F.transform(F.sequence(F.lit(0), F.size("w") - ANCHOR), at)).otherwise(F.array().cast("array<string>")))
    firsts = F.array_distinct("w")
    item = items.select("item_id", normalized(F.col("text")).alias("u")).where("u <> ''")
    words = F.split("u", " ")
    long, short = item.where(F.size(words) >= ANCHOR), item.where(F.size(words) < ANCHOR)
    test = F.contains(F.concat(F.lit(" "), F.col("t"), F.lit(" ")), F.concat(F.lit(" "), F.col("u"), F.lit(" ")))

    def met(keys: Column, of: DataFrame, key: Column) -> DataFrame:
        hits = docs.select("doc_id", F.explode(keys).alias("key")).join(of.select("item_id", key.alias("key")), "key").select("item_id", "doc_id")
        return hits.join(of, "item_id").join(docs.select("doc_id", "t"), "doc_id").where(test).select("item_id", "doc_id")

    return met(runs, long, F.array_join(F.slice(words, 1, ANCHOR), " ")).unionByName(met(firsts, short, F.element_at(words, 1))).distinct()


def docket_match(pairs: DataFrame) -> DataFrame:
    """Candidates (legal_name, evidence_text, evidence_date, case_name, docket_number, court, date_filed, chapter) with
    their signals, the number of strong ones, and whether they pass: a bankruptcy case whose number the evidence
    names, or of which two strong signals agree. That the evidence names the court is no strong signal."""
    ours, theirs, low = company_key(F.col("legal_name")), company_key(F.col("case_name")), F.lower("evidence_text")
    number = F.col("docket_number")
    signals = pairs.select(
        "*",
        ((ours != "") & (F.contains(theirs, ours) | F.contains(ours, theirs))).alias("name_match"),
        ((digits(number) != "") & (F.contains(low, F.lower(number)) | number_in(F.col("evidence_text"), number))).alias("number_match"),
        F.coalesce(F.contains(low, F.lower("court")), F.lit(False)).alias("court_match"),
        F.coalesce(within_days(F.col("date_filed"), F.col("evidence_date")), F.lit(False)).alias("date_match"),
        F.col("chapter").isNotNull().alias("type_match"),
    )
    strong = F.col("name_match").cast("int") + F.col("number_match").cast("int") + F.col("date_match").cast("int")
    return signals.select("*", strong.alias("strong"), (F.col("type_match") & (F.col("number_match") | (strong >= 2))).alias("passes"))


def outcome(subjects: DataFrame, passing: DataFrame, key: str, match: str) -> DataFrame:
    """For each subject how many candidates pass: none, the one match, or ambiguous."""
    n = passing.groupBy(key).agg(F.count("*").alias("n"), F.max(match).alias("_m"))
    count = F.coalesce("n", F.lit(0)).cast("long")
    return subjects.join(n, key, "left").select(
        key, count.alias("passing"), F.when(count == 0, "none").when(count == 1, "match").otherwise("ambiguous").alias("outcome"), F.when(count == 1, F.col("_m")).alias(match)
    )
