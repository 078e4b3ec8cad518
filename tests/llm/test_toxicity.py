"""Toxicity: scores against the true shares of labels, and what counts as a hit."""

from __future__ import annotations

import random

import numpy as np
from odd import ROWS, table
from plain import distance

from covenant.llm import toxicity
from covenant.llm.queries import QUERIES

DOCS, LABELS = "doc_id long, text string", "doc_id long, toxic int"


def tables(spark, rows: list[tuple[str, int]]):
    docs = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(rows)], DOCS)
    return docs, spark.createDataFrame([(i, toxic) for i, (_, toxic) in enumerate(rows)], LABELS)


def prose(rng: random.Random, n: int = 12) -> list[str]:
    return ["word" + "".join(rng.choice("bcdfg") for _ in range(4)) for _ in range(n)]


def test_scores_are_shares_of_all_labelled_documents(spark):
    """10 % are toxic, half of them with a telling word, and both labels exceed per_label."""
    rng = random.Random(1)
    rows = []
    for i in range(1200):
        words = prose(rng)
        if i % 20 == 0:
            words[5] = "scumbag"
        rows.append((" ".join(words), int(i % 10 == 0)))
    docs, labels = tables(spark, rows)
    model = toxicity.learn(docs, labels, per_label=80)
    assert "scumbag" in model.words
    scorer = model.scorer()
    none, hit = (scorer.score(scorer.features(t)) for t in ("wordbbbb wordcccc", rows[0][0]))
    assert 0.02 < none < 0.12  # 60 of 1140
    assert hit > toxicity.THRESHOLD


def test_misspelled_and_masked_words_are_hits():
    lexicon = toxicity.Lexicon(["idiot", "moron", "stupid", "ass", "scum"], ["disg"])
    scorer = toxicity.Scorer(lexicon, np.zeros(toxicity.FEATURES + 1))
    kinds = lambda text: [kind for _, kind, *_ in scorer.hits(text)[0]]
    assert kinds("You id1ot, m0ron, st*pid, $cum and a$$!") == [2] * 5
    assert kinds("xdiot tupid xtupid") == [2] * 3  # an error at the first letter
    assert kinds("**idiot** moron!Go ass1") == [1] * 3
    assert kinds("disgusted 1d1ot") == [3, 2]
    assert kinds("2019 a plain text, don't you+me 4 all") == []
    assert scorer.hits("scam asp diot")[2] == 3
    assert lexicon.match("scum") == 1 and lexicon.match("idlers") == 0


def test_quoted_slurs_stay_in_the_lexicon(spark):
    """A word of three letters that clean documents quote in a twentieth of its contexts."""
    rng = random.Random(2)
    rows = []
    for i in range(800):
        words = prose(rng)
        if i % 4 == 0:
            words[5] = "zog"
        if i % 80 == 1:
            words[4:7] = ["wrote", "“zog”", "quoted"]
        rows.append((" ".join(words), int(i % 4 == 0)))
    model = toxicity.learn(*tables(spark, rows))
    assert "zog" in model.words
    scorer = model.scorer()
    abusive, quoted = (scorer.score(scorer.features(rows[i][0])) for i in (0, 1))
    assert abusive > 0.5 > quoted


def test_automaton_against_distances():
    """Hits are just the words at one edit from an entry, by dynamic programming."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(2, 8)))
    entries = sorted({word() for _ in range(12)})
    lexicon = toxicity.Lexicon(entries, [])
    for w in {word() for _ in range(400)}:
        nearest = min(distance(w, e) for e in entries)
        assert lexicon.match(w) == (1 if nearest == 0 else 0 if nearest > 1 else 2 if len(w) >= toxicity.LONG else 4), w


def test_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op4_toxicity"](spark, sf_dir).collect() if r.held_out and labels.get(r.doc_id) is not None]
    toxic = [r.predicted for r in rows if labels[r.doc_id] == 1]
    clean = [r.predicted for r in rows if labels[r.doc_id] == 0]
    assert sum(toxic) > 0.8 * len(toxic) and sum(clean) < 0.05 * len(clean)


def test_odd_rows(spark):
    docs = table(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 1), (6, 0), (7, 1), (8, None), (9, 0), (9, 1), (None, 1), (99, 1)], LABELS)
    found = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
    assert len(found) == len(ROWS) and all(0 <= r.toxicity <= 1 for r in found)
    assert len({r.toxicity for r in found if not (r.text or "").strip()}) == 1
    assert toxicity.learn(docs, labels.where("toxic = 1")) is None
    assert {r.toxicity for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), None).collect() == []
