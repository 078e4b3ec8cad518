"""Entitlement policy as an ordered list of decisions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Which permission each action asks for. Fixed values.
ACTIONS = {"display": "may_display", "export": "may_export", "prompt_inclusion": "may_prompt", "send_to_llm": "may_prompt", "search": "may_display", "download": "may_export", "redistribute": "may_redistribute"}


def decision(licensed: Column, known: Column, expired: Column, permitted_users: Column, user: str, flag: Column) -> Column:
    """(allowed, reason): public data, then no entitlement, expiry, user list and the action's flag."""
    named = F.coalesce(F.size(permitted_users) > 0, F.lit(False))
    reason = (
        F.when(~licensed, "public")
        .when(~F.coalesce(known, F.lit(False)), "no_entitlement")
        .when(F.coalesce(expired, F.lit(False)), "expired")
        .when(named & ~F.array_contains(permitted_users, user), "user_not_permitted")
        .when(~F.coalesce(flag, F.lit(False)), "action_not_permitted")
        .otherwise("permitted")
    )
    return F.struct(reason.isin("public", "permitted").alias("allowed"), reason.alias("reason"))


def both(a: Column, b: Column) -> Column:
    """The first of two decisions that denies, or the second."""
    return F.when(~a["allowed"], a).otherwise(b)
