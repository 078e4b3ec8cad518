"""Which universes an issuer's evidence puts it in, and how surely."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.operators.relational import first_by

#: Ranks of verification. Fixed values.
RANKS = {"unverified": 0, "partial": 1, "verified": 2}
CORE = "distressed-core"
#: Type of evidence, universe, and whether it is definitive. Fixed values for the bound event types.
SLUGS = [("error", "chapter-11", True), ("purchase", "exchange", False), ("signup", "liquidity", False)]


def evidence_slugs(alerts: DataFrame) -> DataFrame:
    """(issuer_id, slug, rank, alert_id): definitive evidence needs high severity and verifies its subject;
    suggestive evidence needs high or medium and never does. All of it counts for the core universe too."""
    spark = alerts.sparkSession
    slugs = F.broadcast(spark.createDataFrame(SLUGS, "category string, slug string, definitive boolean"))
    e = alerts.join(slugs, "category")
    counts = (F.col("severity") == "high") | (~F.col("definitive") & (F.col("severity") == "medium"))
    rank = F.when(F.col("definitive") & F.col("is_subject").eqNullSafe(True), RANKS["verified"]).otherwise(RANKS["partial"])
    return e.where(counts).select("issuer_id", rank.alias("rank"), "alert_id", F.explode(F.array("slug", F.lit(CORE))).alias("slug"))


def best_status(evidence: DataFrame) -> DataFrame:
    return first_by(evidence, ["issuer_id", "slug"], F.desc("rank"), F.asc("alert_id"))


def tagged_names(tags: DataFrame) -> DataFrame:
    """(issuer_id, name, by_hand) to each issuer's names in order, by hand before the system's."""
    bare = F.replace("name", F.lit("sys:"), F.lit(""))
    g = tags.groupBy("issuer_id").agg(F.collect_set(F.when(F.col("by_hand"), bare)).alias("hand"), F.collect_set(bare).alias("everything"))
    return g.select("issuer_id", F.array_join(F.sort_array(F.when(F.size("hand") > 0, F.col("hand")).otherwise(F.col("everything"))), ",").alias("names"))
