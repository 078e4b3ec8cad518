"""Readers of captured JSON payloads: a column ``body`` to rows under declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _filled(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def recent_filings(raw: DataFrame) -> DataFrame:
    """(cik, accession, form, filed, items) of payloads with an array for each column."""
    arrays = "accessionNumber array<string>, form array<string>, filingDate array<string>, items array<string>"
    p = raw.select(F.from_json("body", f"cik string, filings struct<recent: struct<{arrays.replace(' array', ': array')}>>").alias("p")).select("p.cik", "p.filings.recent.*")
    columns = ["accessionNumber", "form", "filingDate", "items"]
    n = F.array_min(F.array(*(F.size(c) for c in columns)))
    rows = p.select("cik", n.alias("n"), F.posexplode(F.arrays_zip(*columns)).alias("i", "f")).where("i < n")
    return rows.select("cik", F.col("f.accessionNumber").alias("accession"), F.col("f.form").alias("form"), F.try_to_date(_filled(F.col("f.filingDate")), "yyyy-MM-dd").alias("filed"), _filled(F.col("f.items")).alias("items"))


def company_facts(raw: DataFrame, taxonomy: str = "us-gaap") -> DataFrame:
    """(concept, unit, ends_on, amount, fy, fp) of payloads of nested maps."""
    point = "struct<end: string, val: decimal(20,4), fy: int, fp: string>"
    p = F.from_json("body", f"facts map<string, map<string, struct<units: map<string, array<{point}>>>>>")
    concepts = raw.select(F.explode(F.try_element_at(p["facts"], F.lit(taxonomy))).alias("concept", "c"))
    units = concepts.select("concept", F.explode("c.units").alias("unit", "points"))
    return units.select("concept", "unit", F.explode("points").alias("v")).select(
        "concept", "unit", F.try_to_date("v.end", "yyyy-MM-dd").alias("ends_on"), F.col("v.val").alias("amount"), "v.fy", "v.fp"
    )


def observations(raw: DataFrame) -> DataFrame:
    """(day, amount) of a series, without what is missing."""
    p = raw.select(F.explode(F.from_json("body", "observations array<struct<date: string, value: string>>")["observations"]).alias("o"))
    return p.where("o.value <> '.'").select(F.try_to_date("o.date", "yyyy-MM-dd").alias("day"), F.col("o.value").try_cast("decimal(20,4)").alias("amount"))


def bonds(raw: DataFrame, exchange: str = "TRACE", most: int = 5) -> DataFrame:
    """(figi, description) of the first hits of an exchange, in the order of each payload."""
    p = F.from_json("body", "data array<struct<figi: string, exchCode: string, ticker: string>>")["data"]
    return raw.select(F.explode(F.slice(F.filter(p, lambda d: d["exchCode"] == exchange), 1, most)).alias("d")).select("d.figi", F.col("d.ticker").alias("description"))


def tickers(raw: DataFrame) -> DataFrame:
    """(ticker, cik, title), the last row of a ticker counting."""
    p = raw.select(F.explode(F.from_json("body", "map<string, struct<ticker: string, cik_str: int, title: string>>")).alias("i", "t"))
    return p.groupBy(F.upper("t.ticker").alias("ticker")).agg(F.max_by("t", F.col("i").cast("int")).alias("t")).select("ticker", F.col("t.cik_str").alias("cik"), "t.title")
