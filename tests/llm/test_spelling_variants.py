"""Near words, forms and roots against comparing all words of a small table."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
from odd import ROWS, table
from plain import lower

from covenant.llm import spelling_variants as sv


def vocabulary(rows, least_letters: int = 6, least_n: int = 5, every: int | None = 199) -> Counter:
    words: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return Counter({w: n for w, n in words.items() if len(w) >= least_letters and n >= least_n})


def near(a: str, b: str) -> bool:
    """Whether one letter more, less or other makes one the other."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words: Counter) -> dict[str, tuple]:
    found = {}
    for w, n in words.items():
        others = [x for x in words if x != w and near(w, x)]
        form = min(others, key=lambda x: (-words[x], x), default=None)
        if form is not None and words[form] < 5 * n:
            form = None
        found[w] = (form, n, len(others), words[form] if form else None)

    def root(w: str) -> str:
        return root(found[w][0]) if found[w][0] else w

    return {w: (form, root(w), n, k, m) for w, (form, n, k, m) in found.items()}


def as_dict(df) -> dict[str, tuple]:
    rows = df.collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    expected = plain(vocabulary([tuple(r) for r in docs.collect()]))
    assert as_dict(sv.spelling_variants(docs, slip_every=199)) == expected
    assert sum(v[0] is not None for v in expected.values()) > 5


def test_chains_ties_and_letters(spark, monkeypatch):
    counts = {
        "abcdef": 3200, "abcdeg": 640, "abcdhg": 128, "abidhg": 25, "jbidhg": 5,  # a chain of four steps
        "xxyyzz": 5, "xxyyz": 50, "xxyyzzz": 25, "xxxyyzz": 25,  # one below the least letters, a tie of two
        "éààààà": 30, "Éààààà": 6, "eààààà": 150, "÷×÷×÷×": 5, "aaaaaa": 5, "aaaaaaa": 5, "aaaaaaaa": 25, "baaaaaa": 25,
    }
    text = " ".join(w for w, n in counts.items() for _ in range(n))
    rows = [(1, text.replace("xxyyzz ", "XXYYZZ ")), (2, "jbidhgs"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = plain(vocabulary(rows, every=None))
    assert expected["jbidhg"][1] == "abcdef" and expected["xxyyzz"][0] == "xxxyyzz" and expected["Éààààà"][1] == "eààààà"
    assert as_dict(sv.spelling_variants(docs)) == expected
    monkeypatch.setattr(sv, "MOST_SENT", 0)  # all joins by a shuffle
    monkeypatch.setattr(sv, "LONG_TEXT", 10)
    monkeypatch.setattr(sv, "HELD_WORDS", 1)
    assert as_dict(sv.spelling_variants(docs)) == expected


def test_neighbourhoods_are_whole_and_distinct():
    rng = random.Random(3)
    letters = ["a", "b", "é"]
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(60)] + ["ab" * 200]
    around = sv.Neighbourhood(letters)
    found: dict[int, list[str]] = {}
    for i, w in around.words(words, lambda h: np.ones(h.shape, bool)):
        found.setdefault(i, []).append(w)
    for i, w in enumerate(words):
        expected = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        assert len(found[i]) == len(set(found[i])) and set(found[i]) == expected - {w}


def test_hashes_of_changed_words_are_those_of_the_words():
    around = sv.Neighbourhood(list("abcé"))
    as_rows = lambda ws: np.frombuffer("".join(ws).encode("latin-1"), np.uint8).reshape(len(ws), -1)
    for more, h, counts, put in around.of(as_rows(["abbéca"])):
        for _, i, c in zip(*np.nonzero(counts), strict=True):
            w = "abbéca"[:i] + (chr(put[c]) if more >= 0 else "") + "abbéca"[i + (more < 1) :]
            assert around.hashes(as_rows([w]))[0] == h[0, i, c]


def test_a_full_filter_drops_nothing(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(sv, "MOST_BITS", 1 << 16)
    assert as_dict(sv.spelling_variants(docs)) == plain(vocabulary([tuple(r) for r in docs.collect()], every=None))


def test_odd_rows(spark):
    docs = table(spark)
    assert as_dict(sv.spelling_variants(docs, slip_every=199)) == plain(vocabulary(ROWS))
    assert as_dict(sv.spelling_variants(docs, least_letters=1, least_n=1, slip_every=7)) == plain(vocabulary(ROWS, 1, 1, 7))
    assert sv.spelling_variants(docs.limit(0)).collect() == []
