"""Calendar rules of the research day, as column builders. Research days are New York days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/New_York"
#: Hours until data of a provider is no more live, and no more cached. Fixed values.
FRESHNESS_HOURS = {"filings": (24, 168), "trades": (0.25, 4), "rates": (24, 720), "synthetic": (876000, 876000), "identifiers": (720, 4320)}
DEFAULT_FRESHNESS_HOURS = (1, 24)
#: Hours until a provider is asked again. Fixed values.
ENRICHMENT_TTL_HOURS = {"filings": 12, "dockets": 168, "identifiers": 720}
UNRESOLVED_HOURS, STUCK_HOURS = 72, 1


def iso_date(x: Column) -> Column:
    return F.try_to_date(F.substring(x, 1, 10), "yyyy-MM-dd")


def research_day(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), ZONE))


def day_start(day: Column) -> Column:
    """The instant at which a research day begins."""
    return F.to_utc_timestamp(day.cast("timestamp"), ZONE)


def previous_business_day(d: Column) -> Column:
    w = F.weekday(d)  # Monday is 0
    return F.date_sub(d, F.when(w == 0, 3).when(w == 6, 2).otherwise(1))


def business_day_on_or_before(d: Column) -> Column:
    w = F.weekday(d)
    return F.date_sub(d, F.when(w == 5, 1).when(w == 6, 2).otherwise(0))


def is_new(as_of: Column, preceding: Column, latest: Column) -> Column:
    return (as_of > preceding) & (as_of <= latest)


def within_days(a: Column, b: Column, n: int = 14) -> Column:
    return F.abs(F.datediff(a, b)) <= n


def two_digit_year(yy: Column, pivot: int = 50) -> Column:
    return F.when(yy < pivot, yy + 2000).otherwise(yy + 1900)


def freshness(provider: Column, seen: Column, now: Column) -> Column:
    """live, cached or stale by the provider's limits, which count as within."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(seen)) / 3600.0
    live, cached = F, F
    for name, (a, b) in FRESHNESS_HOURS.items():
        live, cached = live.when(provider == name, F.lit(float(a))), cached.when(provider == name, F.lit(float(b)))
    live, cached = live.otherwise(float(DEFAULT_FRESHNESS_HOURS[0])), cached.otherwise(float(DEFAULT_FRESHNESS_HOURS[1]))
    return F.when(age <= live, "live").when(age <= cached, "cached").otherwise("stale")


#: States in which an entity is asked again after its provider's hours, after those for what stays open, and never. Fixed values.
SETTLED_STATES = ("complete", "no_data")
OPEN_STATES = ("ambiguous", "manual_review_required", "unavailable")
FINAL_STATES = ("failed_permanent", "blocked_entitlement", "unsupported")


def is_due(status: Column, provider: Column, last_attempt: Column, last_success: Column, next_retry: Column, now: Column) -> Column:
    """Whether an entity's data of a provider is to be fetched again, by its state and what it waits for."""
    past = lambda ts, hours: F.coalesce((F.unix_timestamp(now) - F.unix_timestamp(ts)) / 3600.0 > hours, F.lit(True))
    ttl = F
    for name, h in ENRICHMENT_TTL_HOURS.items():
        ttl = ttl.when(provider == name, float(h))
    return (
        F.when(status.isNull(), True)
        .when(status == "failed_retryable", F.coalesce(next_retry <= now, F.lit(True)))
        .when(status == "running", past(last_attempt, STUCK_HOURS))
        .when(status.isin(*SETTLED_STATES), past(last_success, ttl.otherwise(24.0)))
        .when(status.isin(*OPEN_STATES), past(last_attempt, UNRESOLVED_HOURS))
        .otherwise(False)
    )
