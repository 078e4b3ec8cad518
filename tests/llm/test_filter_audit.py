"""The audit of filters against applying every order to every document."""

from __future__ import annotations

import itertools
from collections import Counter

from odd import ROWS, table
from plain import SPACED

from covenant.llm.filter_audit import audit, interactions, joint_failures


def failed(rows) -> list[tuple[str, frozenset[str], int | None]]:
    """Of rows (doc_id, text, part): part, filters failed and doc_id."""
    least: dict[str, int] = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, part in rows:
        t = t or ""
        w = SPACED.findall(t)
        tests = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t],
        }
        out.append((part or "", frozenset(k for k, v in tests.items() if v), i))
    return out


def plain(rows, good: set[int], toxic: set[int]) -> dict[tuple[str, str, int], tuple]:
    docs = failed(rows)
    out, shapley = {}, Counter()
    for part in {p for p, *_ in docs}:
        for order in itertools.permutations("ABCDE"):
            left = [(f, i) for p, f, i in docs if p == part]
            gone: list = []
            for k, letter in enumerate(order, 1):
                now = [x for x in left if letter in x[0]]
                redundant = sum(letter in f for f, _ in gone)
                left, gone = [x for x in left if letter not in x[0]], gone + now
                shapley[part, letter] += len(now)
                unique = sum(p == part and f == {letter} for p, f, _ in docs)
                out[part, "".join(order), k] = (len(left), len(now), redundant, unique, sum(i in good for _, i in now), sum(i in toxic for _, i in now))
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def as_dict(df) -> dict:
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(found) == len(rows)
    return found


def test_odd_rows(spark):
    more = [(20, "A " * 99), (21, "A " * 100), (22, "A " * 100), (23, "# one"), (24, "# one"), (5, "# one"), (None, "# one"), (11, "ABCDEFGHI j"), (12, "Abcdefghij klmnopqrst")]
    docs = table(spark, [*ROWS, *more]).withColumnRenamed("source", "lang")
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (22, 1, 1), (24, None, 1), (None, 1, 1), (99, 1, 1), (8, 0, 0)], "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    assert as_dict(audit(docs, labels)) == plain(rows, {5, 22}, {5, 22, 24})
    assert audit(docs.limit(0), labels).collect() == []
    assert as_dict(audit(docs, labels.limit(0))) == plain(rows, set(), set())


def test_any_number_of_filters(spark):
    flags = [(x, y, z, n) for n, (x, y, z) in enumerate(itertools.product((0, 1), repeat=3), 1)]
    rows = spark.createDataFrame([("p", *f, 1, 0) for f in flags], "part string, X int, Y int, Z int, n long, good int, toxic int")
    found = interactions(joint_failures(rows, ["X", "Y", "Z"]), ["X", "Y", "Z"]).collect()
    assert len(found) == 18
    for r in found:
        at = ["XYZ".index(c) for c in r.filter_order]
        gone = lambda f: any(f[i] for i in at[: r.step - 1])
        assert r.removed == sum(f[3] for f in flags if f[at[r.step - 1]] and not gone(f))
        assert r.good_lost == r.removed and r.toxic_lost == 0


def test_copies_are_added_up_before_they_meet(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'the same text', concat('text ', id)) AS text", "if(id % 2 = 0, 'en', null) AS lang")
    labels = spark.range(0).selectExpr("id AS doc_id", "0 AS quality", "0 AS toxic")
    by = {(r.part, r.filter_order, r.step): r for r in audit(docs, labels).collect()}
    assert (by["en", "EABCD", 1].removed, by["", "EABCD", 1].removed) == (3333, 3333)
    assert by["en", "EABCD", 2].kept == 0
