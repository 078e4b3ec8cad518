"""Rows that an operator has to get right and that real tables seldom have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} and" for i in range(60_000))
#: Null, empty and blank texts, a very long one, ties, rows repeated, one id with several texts, null ids.
ROWS: list[tuple[int | None, str | None]] = [
    (1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, "The same text, twice told."), (6, "The same text, twice told."),
    (7, "repeated row here"), (7, "repeated row here"), (8, "one text of eight"), (8, "another text of eight"), (8, None), (8, ""),
    (None, "no id at all"), (None, "no id at all"), (None, None), (9, "größer Ünïcode 表 text\nline two\n"), (-3, "\x00 zero byte"), (10, "x"),
]
CLASHING = ("size", "target", "taken", "copies", "shards", "source_size", "toxicity", "spans", "items", "n_words", "shard", "slot", "text_crc32", "score", "node", "_n", "_key", "_rest", "_odd", "lang_pred", "n_tokens")


def table(spark: SparkSession, rows=ROWS) -> DataFrame:
    """The rows as documents, with a source and a column of each clashing name."""
    docs = spark.createDataFrame([(i, t, None if n % 5 == 0 else f"s{n % 3}") for n, (i, t) in enumerate(rows)], "doc_id long, text string, source string")
    return docs.select("*", *(F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHING))
