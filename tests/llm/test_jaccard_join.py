"""Components of the similarity join against all pairs by brute force."""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.parquet as pq
from plain import components, shingles, similar_pairs

from covenant.llm import jaccard_join
from covenant.llm.jaccard_join import jaccard_components
from covenant.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"


def check(found, texts: dict[int, str | None]) -> None:
    want = components(list(texts), similar_pairs(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    assert got == {i: (len(shingles(t)), want[i]) for i, t in texts.items()}


def test_whole_table(spark, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"])
    check(QUERIES["op2_jaccard_join"](spark, sf_dir), dict(zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True)))


def test_groups_borders_and_passages(spark):
    """Copies in chains and crowds, pairs on both sides of the limit, a passage that all share."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(30)]
    texts: dict[int, str | None] = {}
    for group in range(12):
        base = [word() for _ in range(rng.randrange(20, 120))]
        for _ in range(rng.choice([1, 2, 3, 40])):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            if group % 3 == 0:
                copy = passage + copy
            texts[len(texts)] = " ".join(copy)
            if rng.random() < 0.3:
                base = copy[-len(base) :]
    for n in (39, 40, 41, 43):  # sizes around the limit: a text and how it begins
        whole = [word() for _ in range(n + 4)]
        texts[len(texts)] = " ".join(whole)
        texts[len(texts)] = " ".join(whole[: 30 + 4])
    check(jaccard_components(spark.createDataFrame(list(texts.items()), SCHEMA)), texts)


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: " \t\n", 4: "one two", 5: "ONE\ttwo", 6: "one two three", 7: "ü " * 50_000, 8: "ü " * 60_000, 9: "x" * 3_000_000}
    check(jaccard_components(spark.createDataFrame(list(texts.items()), SCHEMA).selectExpr("*", "1 AS f1", "'n' AS n_shingles")), texts)


def test_rows_repeated_null_ids_and_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "x"), (None, None)], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, 1), (None, 1, None), (None, 0, None)], key=str)
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_doc_id_with_several_texts(spark):
    rows = [(1, "a b c d e f"), (1, "x y z w v u"), (2, "a b c d e f"), (3, "x y z w v u"), (5, "x y z w v u"), (5, "p q r s t"), (7, "p q r s t"), (7, ""), (7, None)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (5, 1, 5), (5, 2, 1), (7, 0, 7), (7, 0, 7), (7, 1, 5)]


def test_crowds_that_share_a_passage(spark):
    """Regions with several crowds and documents between them, dealt wide: the recursive turns find every link."""
    rng = random.Random(11)
    word = lambda: f"v{rng.randrange(100_000)}"
    shared = [word() for _ in range(60)]
    texts: dict[int, str | None] = {}
    for _ in range(9):
        tail = [word() for _ in range(rng.randrange(4, 24))]
        for _ in range(rng.choice([1, 2, 6, 15])):
            copy = shared + tail
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            texts[len(texts)] = " ".join(copy)
    check(jaccard_components(spark.createDataFrame(list(texts.items()), SCHEMA), wide=10), texts)


def test_order_counts_documents(spark):
    texts = {i: "a b c d e" + (" f" if i % 2 else f" g{i}") for i in range(6)}
    order = jaccard_join.shingle_order(spark.createDataFrame(list(texts.items()), SCHEMA), 12)
    values, at = jaccard_join.shingle_sets(jaccard_join.WordHasher(jaccard_join.SPACES), pa.array(list(texts.values())))
    counts = order.reader()(values)
    assert sorted(counts[at[1] : at[2]].tolist()) == [3, 6]
    assert sorted(counts[at[0] : at[1]].tolist()) == [0, 6]
