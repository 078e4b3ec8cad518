"""The corpus pipeline: toxic documents go, then near copies, then documents that hold benchmark
passages; what is left is mixed by source and dealt to shards.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last give the columns of docs. A stage decides on all that
the one before kept. Stages work on doc_id, text and source and carry all other columns along in one
struct, so no name of theirs clashes with those that an operator adds; of the last stage's columns, those
it adds win.

Defined results: texts that are null or empty have no words, so they are neither toxic by a hit, nor near
copies, nor contaminated, and stay until the mix, which draws them with their block; rows are told apart
by doc_id and text, so of several texts with one doc_id each is decided on by itself; rows repeated with
one doc_id and text are near copies of each other, of which one stays; a null doc_id is one as any other.
An empty table gives an empty one.

The rows can't be had from SQL, as the first stage scores with a learned model; tests compare each
stage with a plain version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covenant.llm import toxicity
from covenant.llm.decontamination import decontaminate
from covenant.llm.jaccard_join import jaccard_components
from covenant.llm.mixing import mixed_documents
from covenant.llm.sharding import ADDED, shuffle_into_shards
from covenant.llm.shared import few, materialized, rows_without, with_nodes

N_SHARDS = 24


NEEDED = ("doc_id", "text", "source")


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and source, and all other columns as one."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in NEEDED]
    return docs.select(*NEEDED, F.struct(*(rest or [F.lit(0).alias("none")])).alias("_rest"))


def _unpacked(rows: DataFrame, docs: DataFrame, *added: str) -> DataFrame:
    """Rows of packed docs with the columns of docs, and those added."""
    columns = (F.col(c) if c in NEEDED else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns if c not in added)
    return rows.select(*columns, *added)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under the threshold; three of four checksums are learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = _packed(docs)
    learnable = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) != 2
    model = toxicity.learn(rows.where(learnable), labels)
    return _unpacked(toxicity.score(rows, model).where(F.col("toxicity") < toxicity.THRESHOLD), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents joined by similarity, the one of least doc_id, or of least hash where several share it."""
    rows, renamed = with_nodes(_packed(docs))
    groups = materialized(jaccard_components(rows.select(F.col("node").alias("doc_id"), "text")), "near-copies")
    kept = rows_without(rows, groups.where("doc_id <> component_id").select(F.col("doc_id").alias("node")), "node")
    if renamed:  # rows repeated as a whole or but for other columns
        repeated = few(materialized(groups.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("node")), "repeated"))
        first = F.min_by(F.struct(*NEEDED, "_rest"), F.struct(F.to_json("_rest"), F.coalesce("source", F.lit("")))).alias("row")
        several = kept.join(repeated, "node", "left_semi").groupBy("node").agg(first).select("row.*", "node")
        kept = kept.join(repeated, "node", "left_anti").unionByName(several)
    return _unpacked(kept, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decontaminate(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _unpacked(found.where(F.size("spans") == 0), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source as often as its target needs."""
    return _unpacked(mixed_documents(_packed(docs)), docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and place in it."""
    return _unpacked(shuffle_into_shards(_packed(docs), n_shards=N_SHARDS), docs, *ADDED)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder of tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
