"""Language identification: the kernel by sets of n-grams, held-out accuracy and odd rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from odd import ROWS, table

from covenant.llm import language_id
from covenant.llm.language_id import N_GRAMS, LanguageModel, identify, packed, presences, training_sample
from covenant.llm.queries import QUERIES


def n_grams(text: str) -> frozenset[int]:
    """Places of the n-grams of a text, one by one."""
    b = [language_id._FOLD[x] for x in text.encode()]
    out = {int(x) % N_GRAMS for x in b}
    for i in range(len(b) - 1):
        two = (int(b[i]) * 257 + int(b[i + 1])) & 0xFFFFFFFF
        out.add(((two * 2654435761 & 0xFFFFFFFF) >> 9) % N_GRAMS)
        if i + 2 < len(b):
            three = (two * 263 + int(b[i + 2])) & 0xFFFFFFFF
            out.add(((three * 2246822519 & 0xFFFFFFFF) >> 9) % N_GRAMS)
    return frozenset(out)


def test_scores_by_kernels_of_sets():
    """With all texts as landmarks the scores are those of kernel ridge regression on the kernel by sets."""
    texts = ["the cat and the dog", "the house and a tree", "der hund und die katze", "ein haus und der baum", "le chat et le chien", "une maison et un arbre"]
    langs = ["en", "en", "de", "de", "fr", "fr"]
    sets = [n_grams(t) for t in texts]
    for row, s in zip(next(presences(pa.array(texts))), sets, strict=True):
        assert set(np.flatnonzero(row).tolist()) == s
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    y = np.array([[1.0 if v == c else -1.0 for c in ("de", "en", "fr")] for v in langs])
    ridge = 1e-2
    # features that span the kernel, with a constant that is penalised alike: the kernel plus one
    solved = np.linalg.solve(k + 1 + ridge * np.eye(len(k)), y)
    asked = ["the tree and the cat", "der baum und das haus", "le chien et un chat"]
    want = np.array([[kernel(n_grams(t), s) + 1 for s in sets] for t in asked]) @ solved
    model = LanguageModel(packed(pa.array(texts)), langs, landmarks=10, ridge=ridge)
    got = model.scores(next(presences(pa.array(asked))))
    assert np.allclose(got, want, atol=1e-3) and [model.langs[i] for i in got.argmax(1)] == ["en", "de", "fr"]


def test_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op10_language_id"](spark, sf_dir).collect() if r.held_out and langs[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == langs[r.doc_id] for r in rows) > 0.97 * len(rows)


def test_odd_rows(spark):
    docs = table(spark).drop("lang").selectExpr("*", "if(doc_id % 2 = 0, 'xx', 'yy') AS lang")
    found = identify(docs, training_sample(docs)).collect()
    assert len(found) == len(ROWS)
    lettered = lambda t: any(c.isalpha() for c in t or "")
    assert all((r.lang_pred in ("xx", "yy")) == lettered(r.text) and 0 <= r.score <= 1 and (lettered(r.text) or r.score == 0) for r in found)
    assert {r.lang_pred for r in identify(docs, []).collect()} == {"und"}
    assert identify(docs.limit(0), training_sample(docs)).collect() == [] and training_sample(docs.limit(0)) == []
