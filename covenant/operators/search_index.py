"""A positional inverted index as a table, and ranked search that reads only what the words of a search need.

A row of the index is a word in a block of one kind of document: (lexeme, kind, block, page, n, most, weight, docs).
A block is a range of ids and a page of it a range of parts, so the most frequent word has as many rows as there are
blocks, and no task holds them all. ``docs`` has, for each document of the block with the word, its id as the step
from the first of the block, its part, and its places as position times four plus weight. ``n``, ``most`` and
``weight`` are the documents, the most places in one of them and the best weight: from these follows a bound on
the rank that a document of the block can have. The table is sorted by lexeme, so a search reads row groups of its words.

A search finds its blocks from the narrow columns. It ranks those of the best bounds first, and then only those
others whose bound isn't under the rank of the last document found: the result is that of ranking all.

Rank is cover density: of the shortest stretches of a document that meet the search, each adds the harmonic mean of
the weights of its found words over one more than the number of words between them. Words that a search excludes
don't count. A search of nothing but excluded words or stop words finds nothing.

Defined results: a null text is an empty one; rows without an id aren't indexed; rows repeated with one kind, id and
part are one document of their places together; ties in rank go to the smallest id and part; ranks are rounded to six
places, before they are compared.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covenant.functions.stemming import stemmed
from covenant.operators.search import STOP_WORDS, WEIGHTS
from covenant.operators.storage import few, shared_table

#: Ids in a block and parts in a page of it.
BLOCK = 4096
#: Blocks of a kind that are ranked before bounds are compared with what they have.
FIRST_BLOCKS = 4
PARTS = ("A", "B", "C", "D")
KEYS = ["kind", "id", "part"]
WHERE = ["kind", "block", "page"]


def tokens(rows: DataFrame, heads: list[str] | None = None) -> DataFrame:
    """Rows (kind, id, part, A, B, C, D) to (kind, id, part, word, pos, weight): words that aren't stop words, by their
    place among all words of A, then B and so on. ``weight`` is 3 for A down to 0 for D. With ``heads``, those words that begin with one."""
    words = {p: F.filter(F.split(F.lower(F.coalesce(F.col(p), F.lit(""))), "[^a-z0-9]+"), lambda w: w != "") for p in PARTS}
    split = rows.where("id is not null").select(*KEYS, *(w.alias(p) for p, w in words.items()))
    before, every = F.lit(0), []
    for i, p in enumerate(PARTS):
        every.append(F.transform(F.col(p), _place(before, 3 - i)))
        before = before + F.size(p)
    placed = F.concat(*every)
    if heads is not None:
        placed = F.filter(placed, lambda x: reduce(lambda a, b: a | b, (F.startswith(x["word"], F.lit(h)) for h in heads), F.lit(False)))
    return split.select(*KEYS, F.inline(placed)).where(~F.col("word").isin(*sorted(STOP_WORDS)))


def _place(before: Column, weight: int) -> Callable[[Column, Column], Column]:
    return lambda w, k: F.struct(w.alias("word"), (before + k + 1).alias("pos"), F.lit(weight).alias("weight"))


def heads_of(lexemes: list[str]) -> list[str]:
    """How words with these stems begin. Steps keep at least two letters of what they change, or leave a stem of two or fewer."""
    return sorted({x[: 2 if len(x) > 2 else 1] for x in lexemes})


def words_asked(rows: DataFrame, asked: tuple[str, ...], name: str = "search-index") -> DataFrame:
    """(word, lexeme) of the words of rows that have a stem which one of some searches asks for, as a written table."""
    lexemes = sorted({x for q in asked for x in search_of(rows, q).lexemes(True, False)})
    words = tokens(rows, heads_of(lexemes)).select("word").distinct()
    # written before it is filtered: a filter that moves under the steps of stems repeats them all
    return shared_table(stemmed(words).select("word", F.col("stem").alias("lexeme")), f"{name}-stems").where(F.col("lexeme").isin(*lexemes))


def has_all(text: Column, words: DataFrame, q: str) -> Column:
    """Whether a text has what some alternative of a search wants, by its words (word, lexeme), wherever they stand."""
    of: dict[str, list[str]] = {}
    for r in words.collect():
        of.setdefault(r.lexeme, []).append(r.word)
    low = F.lower(text)
    has = lambda x: F.rlike(low, F.lit(f"(?<![a-z0-9])(?:{'|'.join(sorted(of[x]))})(?![a-z0-9])")) if x in of else F.lit(False)
    alternatives = [reduce(lambda a, b: a & b, (has(w) for ok, p in a if ok for w, _ in p)) for a in search_of(words, q).alternatives]
    return reduce(lambda a, b: a | b, alternatives) if alternatives else F.lit(False)


def build(rows: DataFrame, name: str = "search-index", asked: tuple[str, ...] | None = None, words: DataFrame | None = None) -> DataFrame:
    """The index of rows (kind, id, part, A, B, C, D: texts by weight), written to the shared folder.

    With ``asked``, searches, it has only their words, of all rows: what those searches find is the same, and what no
    search reads isn't shuffled or written. ``words`` are the rows' ``words_asked`` where these are there already."""
    if asked is None:
        placed = tokens(rows)
        stems = few(shared_table(stemmed(placed.select("word").distinct()).select("word", F.col("stem").alias("lexeme")), f"{name}-stems"))
    else:
        words = words_asked(rows, asked, name) if words is None else words
        placed, stems = tokens(rows, heads_of([x for q in asked for x in search_of(rows, q).lexemes(True, False)])), few(words)
    keys = ["lexeme", *WHERE]
    block, page = (F.floor(F.col(c) / BLOCK).cast("long") for c in ("id", "part"))
    of = placed.join(stems, "word").select("lexeme", "kind", block.alias("block"), page.alias("page"), "id", "part", (F.col("pos") * 4 + F.col("weight")).alias("place"))
    in_doc = of.repartition(*keys).groupBy(*keys, "id", "part").agg(F.array_sort(F.collect_set("place")).alias("places"))
    doc = F.struct((F.col("id") - F.col("block") * BLOCK).cast("int").alias("step"), "part", "places")
    best = F.max(F.array_max(F.transform("places", lambda p: p % 4)))
    index = in_doc.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.size("places")).alias("most"), best.alias("weight"), F.array_sort(F.collect_list(doc)).alias("docs"))
    return shared_table(index.repartitionByRange(*keys).sortWithinPartitions(*keys), name)


@dataclass(frozen=True)
class Search:
    """A search: alternatives of (wanted, phrase); a phrase is lexemes with their steps from its first."""

    alternatives: tuple[tuple[tuple[bool, tuple[tuple[str, int], ...]], ...], ...]

    @property
    def items(self) -> list[tuple[tuple[str, int], ...]]:
        return list(dict.fromkeys(p for a in self.alternatives for _, p in a))

    def lexemes(self, *wanted: bool) -> list[str]:
        return sorted({w for a in self.alternatives for ok, p in a if ok in wanted for w, _ in p})


def worded(q: str) -> list[list[tuple[bool, list[tuple[str, int]]]]]:
    """A search in words: alternatives of (wanted, phrase) by ``or``, a leading minus and "phrases"; those that want nothing are left out."""
    out: list[list[tuple[bool, list[tuple[str, int]]]]] = [[]]
    rest = q.lower().strip()
    while rest:
        wanted, rest = not rest.startswith("-"), rest.lstrip("-")
        quoted = rest.startswith('"')
        piece, _, rest = rest[quoted:].partition('"' if quoted else " ")
        rest = rest.strip()
        if piece == "or" and wanted and not quoted:
            out.append([])
            continue
        words = "".join(c if c.isascii() and c.isalnum() else " " for c in piece).split()
        kept = [(w, k) for k, w in enumerate(words) if w not in STOP_WORDS]
        if kept:
            out[-1].append((wanted, [(w, k - kept[0][1]) for w, k in kept]))
    return [a for a in out if any(ok for ok, _ in a)]


#: Stems of words that were asked for; they depend on nothing else.
_STEMS: dict[str, str] = {}


def search_of(index: DataFrame, q: str) -> Search:
    """A search in lexemes. The few words are stemmed where they are, without a job."""
    asked = worded(q)
    words = sorted({w for a in asked for _, p in a for w, _ in p})
    new = [w for w in words if w not in _STEMS]
    if new:
        _STEMS.update({r.word: r.stem for r in stemmed(index.sparkSession.createDataFrame([(w,) for w in new], "word string")).collect()})
    return Search(tuple(tuple((ok, tuple((_STEMS[w], k) for w, k in p)) for ok, p in a) for a in asked))


def _value(weight: Column) -> Column:
    """What a place of a weight counts."""
    return F.element_at(F.array(*(F.lit(WEIGHTS[p]) for p in reversed(PARTS))), weight + 1)


def block_bounds(index: DataFrame, s: Search) -> DataFrame:
    """(kind, block, page, bound) of blocks that have all wanted words of an alternative. No document of a block ranks higher:
    each stretch begins at a place of its own and adds no more than the best weight."""
    wanted = s.lexemes(True)
    of = lambda c, w: F.max(F.when(F.col("lexeme") == w, F.col(c)))
    heads = index.where(F.col("lexeme").isin(*wanted)).groupBy(*WHERE).agg(*(of("most", w).alias(f"most_{i}") for i, w in enumerate(wanted)), F.max("weight").alias("weight"))
    at = {w: F.col(f"most_{i}") for i, w in enumerate(wanted)}
    holds = [reduce(lambda x, y: x & y, (at[w].isNotNull() for ok, p in a if ok for w, _ in p)) for a in s.alternatives]
    bound = reduce(lambda x, y: x + y, (F.coalesce(c, F.lit(0)) for c in at.values())) * _value(F.col("weight"))
    return heads.where(reduce(lambda x, y: x | y, holds)).select(*WHERE, bound.alias("bound"))


def ranked(index: DataFrame, s: Search, blocks: DataFrame) -> DataFrame:
    """(kind, id, part, rank) of the documents of some blocks that match a search."""
    asked = index.where(F.col("lexeme").isin(*s.lexemes(True, False))).select("lexeme", *WHERE, "docs").join(blocks.select(*WHERE), WHERE, "left_semi")
    docs = asked.select("lexeme", "kind", "block", F.inline("docs")).select("lexeme", "kind", (F.col("block") * BLOCK + F.col("step")).alias("id"), "part", F.explode("places").alias("place"))
    here = docs.select(*KEYS, "lexeme", F.shiftright("place", 2).alias("pos"), _value((F.col("place") % 4).cast("int")).alias("value"))
    doc = Window.partitionBy(*KEYS)
    by_pos = doc.orderBy("pos")
    counts = F.col("lexeme").isin(*s.lexemes(True))
    # each item begins where its words stand at their steps; a place has one word, so a step of k is no more than k rows ahead
    at_step = lambda w, k: reduce(lambda x, y: x | y, ((F.lead("lexeme", j).over(by_pos) == w) & (F.lead("pos", j).over(by_pos) == F.col("pos") + k) for j in range(1, k + 1)))
    begins = [reduce(lambda x, y: x & y, (F.coalesce(at_step(w, k), F.lit(False)) for w, k in p[1:]), F.col("lexeme") == p[0][0]) for p in s.items]
    here = here.select(
        "*", F.sum(counts.cast("int")).over(by_pos).alias("count"), F.sum(F.when(counts, 1 / F.col("value")).otherwise(0.0)).over(by_pos).alias("inverse"),
        *(b.alias(f"begins_{i}") for i, b in enumerate(begins)),
    )
    before = F.struct("pos", (F.col("count") - 1).alias("count"), (F.col("inverse") - 1 / F.col("value")).alias("inverse"))
    latest = {p: F.max(F.when(F.col(f"begins_{i}"), before)).over(by_pos.rangeBetween(Window.unboundedPreceding, -p[-1][1])).alias(f"latest_{i}") for i, p in enumerate(s.items)}
    there = {p: F.max(f"begins_{i}").over(doc).alias(f"there_{i}") for i, p in enumerate(s.items)}
    here = here.select(*KEYS, "pos", "count", "inverse", *latest.values(), *there.values())
    nth = {p: i for i, p in enumerate(s.items)}

    def begin(a: tuple) -> Column:
        wanted, not_ = [nth[p] for ok, p in a if ok], [nth[p] for ok, p in a if not ok]
        met = reduce(lambda x, y: x & y, [*(F.col(f"latest_{i}").isNotNull() for i in wanted), *(~F.col(f"there_{i}") for i in not_)])
        first = [F.col(f"latest_{i}") for i in wanted]
        return F.when(met, F.least(*first) if len(first) > 1 else first[0])

    starts = [begin(a) for a in s.alternatives]
    here = here.select(*KEYS, "pos", "count", "inverse", (F.greatest(*starts) if len(starts) > 1 else starts[0]).alias("begin"))
    last = F.lag("begin.pos").over(by_pos)
    covers = here.withColumn("last", last).where("begin IS NOT NULL AND (last IS NULL OR last < begin.pos)")
    n = F.col("count") - F.col("begin.count")
    noise = F.col("pos") - F.col("begin.pos") - (n - 1)
    return covers.groupBy(*KEYS).agg(F.round(F.sum(n / (F.col("inverse") - F.col("begin.inverse")) / (1 + noise)), 6).alias("rank"))


def matching(index: DataFrame, q: str) -> DataFrame:
    """(kind, id, part, rank) of all documents that match a search."""
    s = search_of(index, q)
    return ranked(index, s, block_bounds(index, s)) if s.alternatives else _none(index)


def _none(index: DataFrame) -> DataFrame:
    return index.limit(0).select("kind", F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("part"), F.lit(0.0).alias("rank"))


def _first(rows: DataFrame, k: int, by: list[str], *order: Column | str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def search(index: DataFrame, q: str, limit: int, kinds: list[str] | None = None) -> DataFrame:
    """(kind, id, part, rank): of each kind the documents that match a search best, ``limit`` at most."""
    s = search_of(index, q)
    of_kinds = index.where(F.col("kind").isin(*kinds)) if kinds else index
    if not s.alternatives:
        return _none(of_kinds)
    best = (F.desc("rank"), "id", "part")
    bounds = shared_table(block_bounds(of_kinds, s), "search-blocks")
    first = _first(bounds, FIRST_BLOCKS, ["kind"], F.desc("bound"), "block", "page")
    found = shared_table(_first(ranked(of_kinds, s, F.broadcast(first)), limit, ["kind"], *best), "search-first")
    last = found.groupBy("kind").agg(F.count("*").alias("have"), F.min("rank").alias("least"))
    others = bounds.join(first.select(*WHERE), WHERE, "left_anti").join(F.broadcast(last), "kind", "left")
    open_ = others.where((F.coalesce("have", F.lit(0)) < limit) | (F.col("bound") + 1e-6 >= F.col("least")))
    return _first(found.unionByName(ranked(of_kinds, s, open_)), limit, ["kind"], *best)
