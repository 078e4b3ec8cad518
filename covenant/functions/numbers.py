"""Money, ratios, hashes and identifiers as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(x: Column) -> Column:
    """Rounded half up to two places."""
    return F.round(x, 2).cast("decimal(20,2)")


def clamped(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is."""
    return F.coalesce(F.try_divide(a, b), F.lit(0))


def call_cost(tokens_in: Column, tokens_out: Column, per_million_in: Column, per_million_out: Column) -> Column:
    return ((tokens_in * per_million_in + tokens_out * per_million_out) / 1_000_000).cast("decimal(12,6)")


def compact_money(x: Column) -> Column:
    """$1.2B, $3.4M, $5.6K or the whole amount."""
    d = lambda n: F.round(x / n, 1).cast("decimal(20,1)").cast("string")
    a = F.abs(x)
    return (
        F.when(a >= 1_000_000_000, F.concat(F.lit("$"), d(1_000_000_000), F.lit("B")))
        .when(a >= 1_000_000, F.concat(F.lit("$"), d(1_000_000), F.lit("M")))
        .when(a >= 1_000, F.concat(F.lit("$"), d(1_000), F.lit("K")))
        .otherwise(F.concat(F.lit("$"), F.round(x, 0).cast("decimal(20,0)").cast("string")))
    )


def basis_points(x: Column) -> Column:
    return F.round(x * 100, 0).cast("long")


def checksum(x: Column) -> Column:
    return F.sha2(x, 256)


def request_key(url: Column, body: Column | None = None) -> Column:
    """The key of a request: its address, with its body as JSON of sorted keys if it has one."""
    return F.sha2(url if body is None else F.concat(url, F.lit("|"), body), 256)
