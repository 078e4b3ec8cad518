"""The search index and the name index against plain versions."""

from __future__ import annotations

import random

import pytest

from covenant.bindings import Roles
from covenant.functions.stemming import stemmed
from covenant.operators import name_index, search_index
from covenant.operators.search import STOP_WORDS, WEIGHTS
from covenant.plans import searching

VOCABULARY = ["alpha", "beta", "gamma", "the", "filing", "filings", "filed", "of", "court", "x1"]


def words(text: str | None) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in (text or "").lower()).split()


def rank(parts: dict[str, str | None], asked, stems: dict[str, str]) -> float | None:
    """Cover density by trying all stretches."""
    placed = [(w, p) for p in "ABCD" for w in words(parts.get(p))]
    at = [(i, stems.get(w, w), WEIGHTS[p]) for i, (w, p) in enumerate(placed, 1) if w not in STOP_WORDS]
    lex = {i: (w, v) for i, w, v in at}
    holds = lambda phrase, low, high: any(all(lex.get(i + k, ("",))[0] == stems[w] and i + k <= high for w, k in phrase) for i in range(low, high + 1))
    n = len(placed)
    asked = [a for a in asked if not any(not ok and holds(p, 1, n) for ok, p in a)]
    meets = lambda low, high: any(all(holds(p, low, high) for ok, p in a if ok) for a in asked)
    wanted = {stems[w] for a in search_index.worded(CURRENT) for ok, p in a if ok for w, _ in p}
    total, found = 0.0, False
    for high in range(1, n + 1):
        lows = [low for low in range(1, high + 1) if meets(low, high)]
        if lows and not meets(lows[-1], high - 1):
            inside = [v for i, (w, v) in lex.items() if lows[-1] <= i <= high and w in wanted]
            total += len(inside) / sum(1 / v for v in inside) / (1 + high - lows[-1] - (len(inside) - 1))
            found = True
    return round(total, 6) if found else None


CURRENT = ""


@pytest.mark.parametrize("q", ["alpha", "alpha beta", "filed", '"alpha beta"', 'gamma or "beta of court"', "alpha -gamma", 'alpha beta or filing court -"x1 alpha"', "-alpha", "the of", ""])
def test_ranks_and_skipped_blocks(spark, monkeypatch, q):
    global CURRENT
    CURRENT = q
    monkeypatch.setattr(search_index, "BLOCK", 4)
    monkeypatch.setattr(search_index, "FIRST_BLOCKS", 1)
    rng = random.Random(4)
    text = lambda: rng.choice([None, "", " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(1, 14)))])
    rows = [(rng.choice("kl"), i, part, text(), text(), None, text()) for i in range(40) for part in range(2)] + [("k", None, 0, "alpha", None, None, None)]
    schema = "kind string, id long, part long, A string, B string, C string, D string"
    index = search_index.build(spark.createDataFrame(rows, schema))
    stems = {r.word: r.stem for r in stemmed(spark.createDataFrame([(w,) for w in VOCABULARY], "word string")).collect()}
    expected = {}
    for kind, i, part, *parts in rows:
        r = rank(dict(zip("ABCD", parts, strict=True)), search_index.worded(q), stems) if i is not None else None
        if r is not None:
            expected[kind, i, part] = r
    assert {(r.kind, r.id, r.part): r["rank"] for r in search_index.matching(index, q).collect()} == pytest.approx(expected, abs=2e-6)
    top = [k for kind in "kl" for k in sorted((k for k in expected if k[0] == kind), key=lambda k: (-expected[k], k))[:3]]
    assert sorted((r.kind, r.id, r.part) for r in search_index.search(index, q, 3).collect()) == sorted(top)
    assert search_index.search(search_index.build(spark.createDataFrame([], schema)), q, 3).collect() == []


def test_a_search_reads_only_the_rows_of_its_words(spark, sf_dir):
    rows = searching.sources(Roles(spark, sf_dir), ("docket_entry",))
    index = search_index.build(rows)
    heads = search_index.block_bounds(index, search_index.search_of(index, "thea inthe"))
    plan = heads._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(lexeme, [inth,thea])]" in plan
    assert "docs" not in plan.split("ReadSchema")[1]


def test_names_alike(spark, monkeypatch):
    monkeypatch.setattr(name_index, "BLOCK", 3)
    rng = random.Random(5)
    rows = [("k", i, "".join(rng.choice("abc de") for _ in range(rng.randint(0, 12)))) for i in range(60)] + [("k", 99, None), ("l", 1, "Abc De"), ("l", 2, "abc de f")]
    names = name_index.build(spark.createDataFrame(rows, "kind string, id long, name string"))

    def trigrams(x: str) -> set[str]:
        return {f"  {w} "[i : i + 3] for w in words(x) for i in range(len(w) + 1)}

    for q in ("abc de", "cab", "", "zzz"):
        a = trigrams(q)
        expected = {(k, i): len(a & trigrams(n)) / len(a | trigrams(n)) for k, i, n in rows if n and a | trigrams(n)}
        found = {(r.kind, r.id): r.similarity for r in name_index.alike(names, q).collect()}
        assert found == pytest.approx({k: v for k, v in expected.items() if v > 0.3})
    assert {(r.kind, r.id) for r in name_index.beginning(names, "ABC D").collect()} == {(k, i) for k, i, n in rows if n and n.lower().startswith("abc d")}
    assert {(r.kind, r.id) for r in name_index.exactly(names, "ABC De").collect()} == {(k, i) for k, i, n in rows if n and n.lower() == "abc de"}


def test_chunks_found_are_those_with_all_words(spark, sf_dir):
    r = Roles(spark, sf_dir)
    chunks = searching.chunked(r.document.select("doc_id", searching.of_pages("text").alias("pages")), "doc_id", "pages", separator=r"\n").collect()
    in_order: dict[int, list[int]] = {}
    for c in sorted(chunks, key=lambda c: (c.doc_id, c.chunk_index)):
        if {"license", "licenses", "licensed"} & set(words(c.content)) and {"version", "versions"} & set(words(c.content)):
            in_order.setdefault(c.doc_id, []).append(c.chunk_index)
    found = {(x.doc_id, x.chunk_index) for x in searching.chunk_search(r).collect()}
    assert found == {(d, n) for d, ns in in_order.items() for n in ns[:50]} and found


def test_an_index_of_the_words_asked_finds_the_same(spark):
    texts = ["Licensed versions", "licensing of a version, licenses", "eyed and eying eyes", "a lie, lies, lied", "veri version", "y ties skies sky", None, ""]
    rows = [("k", i, 0, t, None, None, texts[-1 - i]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "kind string, id long, part long, A string, B string, C string, D string")
    whole = search_index.build(df)
    asked = ("license version", "eyes or lies", "sky -ties", "of the", "absent")
    some = search_index.build(df, asked=asked)
    for q in asked:
        assert sorted(search_index.matching(some, q).collect()) == sorted(search_index.matching(whole, q).collect())
    assert {r.lexeme for r in some.select("lexeme").distinct().collect()} < {r.lexeme for r in whole.select("lexeme").distinct().collect()}


def test_names_gone_through_are_found_as_by_tables(spark):
    rows = [("k", i, n) for i, n in enumerate(["Abc De", "abc de f", "ABC", None, "", "zz abc", "!!"])] + [("l", 1, "abc de"), ("l", 1, "abc de")]
    names = spark.createDataFrame(rows, "kind string, id long, name string")
    tables, one = name_index.build(names), name_index.scanned(names)
    for q in ("abc de", "zz", "", "none such"):
        for find in (name_index.alike, name_index.beginning, name_index.exactly):
            assert sorted(find(one, q).collect()) == sorted(find(tables, q).collect())
    assert one.by_trigram is None
