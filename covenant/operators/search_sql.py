"""The same ranked search as SQL for DuckDB, without an index: every place of every word, and stretches by joins."""

from __future__ import annotations

from covenant.functions.stemming import stems_sql
from covenant.operators.search import STOP_WORDS, WEIGHTS
from covenant.operators.search_index import PARTS, worded

_SAME = "{0}.kind = {1}.kind AND {0}.id = {1}.id AND {0}.part = {1}.part"


def _stem(word: str) -> str:
    return f"(SELECT stem FROM stems WHERE word = '{word}')"


def ranks_sql(sources: str, q: str) -> str:
    """SQL of tables, the last of which, ``ranks``, has (kind, id, part, rank); ``sources`` is a table (kind, id, part, A, B, C, D)."""
    asked = worded(q)
    items = list(dict.fromkeys(tuple(p) for a in asked for _, p in a))
    words = sorted({w for p in items for w, _ in p})
    wanted = sorted({w for a in asked for ok, p in a if ok for w, _ in p})
    split = [f"list_transform(list_filter(string_split_regex(lower(coalesce({p}, '')), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: {{'w': w, 'v': {WEIGHTS[p]}::DOUBLE}})" for p in PARTS]
    stop = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
    out = [
        f"tok AS (SELECT kind, id, part, x.w AS word, x.v AS value, pos FROM (SELECT kind, id, part, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT kind, id, part, {' || '.join(split)} AS l FROM {sources} WHERE id IS NOT NULL)) WHERE x.w NOT IN ({stop}))",
        f"vocabulary AS (SELECT DISTINCT word FROM tok UNION SELECT unnest([{', '.join(repr(w) for w in words)}]))", stems_sql("vocabulary"),
        f"o AS (SELECT DISTINCT kind, id, part, pos, value, stem FROM tok JOIN stems USING (word) WHERE stem IN ({', '.join(map(_stem, words))}))",
    ]
    for i, p in enumerate(items):
        joins = " ".join(f"JOIN o AS o{j} ON {_SAME.format('o0', f'o{j}')} AND o{j}.pos = o0.pos + {k} AND o{j}.stem = {_stem(w)}" for j, (w, k) in enumerate(p[1:], 1))
        out.append(f"item_{i} AS (SELECT o0.kind, o0.id, o0.part, o0.pos AS start, o0.pos + {p[-1][1]} AS stop FROM o AS o0 {joins} WHERE o0.stem = {_stem(p[0][0])})")
    latest = ", ".join(f"(SELECT max(start) FROM item_{i} AS t WHERE {_SAME.format('t', 'o')} AND stop <= o.pos) AS b_{i}, EXISTS (SELECT 1 FROM item_{i} AS t WHERE {_SAME.format('t', 'o')}) AS has_{i}" for i in range(len(items)))
    out.append(f"ends AS (SELECT kind, id, part, pos, {latest} FROM o)")
    starts = []
    for a in asked:
        nth = [(ok, items.index(tuple(p))) for ok, p in a]
        met = " AND ".join(f"b_{i} IS NOT NULL" if ok else f"NOT has_{i}" for ok, i in nth)
        starts.append(f"CASE WHEN {met} THEN least({', '.join(f'b_{i}' for ok, i in nth if ok)}) END")
    out += [
        f"covers AS (SELECT kind, id, part, begun, min(pos) AS ended FROM (SELECT *, greatest({', '.join(starts)}) AS begun FROM ends) WHERE begun IS NOT NULL GROUP BY ALL)",
        f"stretches AS (SELECT covers.kind, covers.id, covers.part, begun, ended, count(*) AS n, sum(1 / value) AS inverse FROM covers JOIN o ON {_SAME.format('o', 'covers')} AND pos BETWEEN begun AND ended AND stem IN ({', '.join(map(_stem, wanted))}) GROUP BY ALL)",
        "ranks AS (SELECT kind, id, part, round(sum(n / inverse / (1 + (ended - begun) - (n - 1))), 6) AS rank FROM stretches GROUP BY ALL)",
    ]
    return ", ".join(out)
