"""The queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covenant.llm import language_id, language_model, toxicity
from covenant.llm.decontamination import decontaminate
from covenant.llm.exact_dedup import exact_dedup
from covenant.llm.filter_audit import audit
from covenant.llm.html_extraction import extract
from covenant.llm.jaccard_join import jaccard_components
from covenant.llm.line_dedup import line_digests
from covenant.llm.mixing import mix_sources
from covenant.llm.quality_rules import FIGURES, quality_rules
from covenant.llm.sharding import shuffle_into_shards
from covenant.llm.spelling_variants import spelling_variants


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int) -> Column:
    """A document's number in 0 .. n - 1 by the checksum of its doc_id as text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark decontamination."""
    found = decontaminate(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    ids = F.array_join(F.sort_array("items"), ",")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join."""
    return jaccard_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity; learned from documents whose remainder by 4 isn't 2."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs.where(_remainder(4) != 2), _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", (_remainder(4) == 2).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup."""
    return line_digests(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML extraction."""
    return extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharding into 24 shards of equal counts."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return shuffle_into_shards(docs, n_shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LM scoring; learned from documents whose remainder by 10 isn't 0."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = language_model.train(docs.where(_remainder(10) != 0))
    return language_model.score(docs, model).select("doc_id", (_remainder(10) == 0).alias("held_out"), *language_model.ADDED)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup."""
    return exact_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language ID; learned from documents whose remainder by 5 isn't 0."""
    docs = _table(spark, sf_dir, "documents")
    sample = language_id.training_sample(docs.select("doc_id", "text", "lang").where(_remainder(5) != 0))
    found = language_id.identify(docs.select("doc_id", "text"), sample)
    return found.select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", "score")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter interaction audit."""
    return audit(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), _table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variant grouping; a letter is lost in one of 199 pairs of document and word."""
    return spelling_variants(_table(spark, sf_dir, "documents").select("doc_id", "text"), slip_every=199)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules(docs).select("doc_id", *FIGURES, "base_failed", "kept", "log_perplexity", "lower", "upper")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_jaccard_join,
        op3_mixing,
        op4_toxicity,
        op5_line_dedup,
        op6_html_extraction,
        op7_sharding,
        op8_lm_scoring,
        op9_exact_dedup,
        op10_language_id,
        op11_filter_audit,
        op12_spelling_variants,
        op13_quality_rules,
    )
}
