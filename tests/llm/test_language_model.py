"""The language model against Kneser-Ney in dictionaries, and what its probabilities sum to."""

from __future__ import annotations

import math
import os

import numpy as np
import pytest
from odd import LONG, ROWS, table
from plain import KneserNey, words

from covenant.llm import language_model as lm


def check(rows, plain: KneserNey) -> None:
    for r in rows:
        tokens = [*words(r.text), "<end>"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(plain.words[w] > 0 for w in tokens), plain.total)
        base, score, before = 0.0, 0.0, "<begin>"
        for w in tokens:
            base += math.log10(plain.base(w))
            score += math.log10(plain.p(before, w))
            before = w
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9, abs_tol=1e-9)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    train = docs.where("doc_id % 3 <> 0")
    plain = KneserNey([r.text for r in train.collect()])
    check(lm.score(docs, lm.train(train)).collect(), plain)
    # held-out texts are better told by the model than by the base
    held = lm.score(docs.where("doc_id % 3 = 0"), lm.train(train, slices=5, flush_bytes=1 << 16))
    assert held.where("score > base_score").count() > 0.9 * held.count()


def test_probabilities_sum_to_one(spark):
    texts = ["a b a c", "a b b", "c a b d", "", "d d d a"]
    model = lm.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    plain = KneserNey(texts)
    for context in (*plain.words, "<begin>", "unseen"):
        total = sum(plain.p(context, w) for w in plain.words) + plain.p(context, "unknown")
        assert math.isclose(total, 1, rel_tol=1e-12)
    check(lm.score(spark.createDataFrame([(t,) for t in [*texts, "b e a", "e"]], "text string"), model).collect(), plain)
    assert lm.score(spark.createDataFrame([("a b",)], "text string"), model).select(lm.perplexity(lm.F.col("score"), lm.F.col("n_tokens")).alias("x")).first().x > 1


def test_odd_rows(spark):
    docs = table(spark)
    check(lm.score(docs, lm.train(docs)).collect(), KneserNey([t for _, t in ROWS]))
    check(lm.score(docs, lm.train(docs.limit(0))).collect(), KneserNey([]))
    assert lm.score(docs.limit(0), lm.train(docs.where("doc_id < 3"))).collect() == []
    assert len(LONG) > 600_000


def test_a_missing_array_is_an_error(spark):
    model = lm.train(spark.createDataFrame([("a b c",)], "text string"))
    file = next(f for f in os.listdir(model.folder) if f.startswith("words-"))
    os.remove(f"{model.folder}/{file}")
    reader = lm.Reader(model)
    with pytest.raises(FileNotFoundError):
        for s in range(model.slices):
            reader.arrays(f"words-{s}.{file.split('.')[1]}")
    cut = next(f for f in os.listdir(model.folder) if f.startswith("bigrams-") and ".key." in f)
    with open(f"{model.folder}/{cut}", "ab") as f:
        f.write(np.zeros(1, np.uint64).tobytes())
    with pytest.raises(OSError):
        lm.Reader(model).arrays(cut.rsplit(".", 2)[0])
