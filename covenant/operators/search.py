"""Search over names and texts: tiers of names, and ranked full text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covenant.functions.text import trigram_similarity

#: Ranks by weight of where a word stands. Fixed values.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
#: English words too frequent to search for. Fixed values.
STOP_WORDS = frozenset(
    """a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further
    had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own
    s same she should so some such t than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why
    will with you your yours yourself yourselves""".split()
)


def tiered(sources: dict[str, DataFrame], q: str, limit: int, least: float = 0.3) -> DataFrame:
    """Names (id, name) of each source: exact matches, then by prefix, then by trigrams, ``limit`` of each."""
    union = reduce(DataFrame.unionByName, (df.select(F.lit(kind).alias("kind"), "id", "name") for kind, df in sources.items()))
    low = F.lower("name")
    scored = union.select("*", F.when(low == q, 3).when(F.startswith(low, F.lit(q)), 2).otherwise(1).alias("tier"), trigram_similarity(F.col("name"), F.lit(q)).alias("similarity"))
    found = scored.where((F.col("tier") > 1) | (F.col("similarity") > least))
    n = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("tier"), F.desc("similarity"), "id"))
    return found.withColumn("n", n).where(F.col("n") <= limit).drop("n")


def lexemes(text: Column) -> Column:
    """The words of a text in order, lower-cased and without stop words."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*sorted(STOP_WORDS)))


def parsed(q: str) -> list[list[tuple[bool, list[str]]]]:
    """A search as alternatives of (wanted, phrase): words, "phrases", ``or`` and a leading minus."""
    out: list[list[tuple[bool, list[str]]]] = [[]]
    rest = q.lower()
    while rest := rest.strip():
        wanted = not rest.startswith("-")
        rest = rest.lstrip("-")
        if rest.startswith('"'):
            phrase, _, rest = rest[1:].partition('"')
        else:
            phrase, _, rest = rest.partition(" ")
            if phrase == "or" and wanted:
                out.append([])
                continue
        words = [w for w in "".join(c if c.isalnum() else " " for c in phrase).split() if w not in STOP_WORDS]
        if words:
            out[-1].append((wanted, words))
    return [a for a in out if a]


def matches(words: Column, q: str) -> Column:
    """Whether lexemes match a search."""

    def has(p: list[str]) -> Column:
        if len(p) == 1:
            return F.array_contains(words, p[0])
        return F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(f" {' '.join(p)} "))

    alternatives = [reduce(lambda a, b: a & b, (has(p) if wanted else ~has(p) for wanted, p in a)) for a in parsed(q)]
    return reduce(lambda a, b: a | b, alternatives) if alternatives else F.lit(False)


def weighted_vector(parts: dict[str, Column]) -> Column:
    """Lexemes by weight as an array of (lexeme, weight), each with its best weight, in order."""

    def tagged(words: Column, weight: str) -> Column:
        return F.transform(words, lambda w: F.struct(w.alias("lexeme"), F.lit(weight).alias("weight")))

    every = F.array_sort(F.array_distinct(F.flatten(F.array(*(tagged(words, weight) for weight, words in parts.items())))))
    return F.filter(every, lambda x, i: (i == 0) | (F.get(every, i - 1)["lexeme"] != x["lexeme"]))


def found_in(sources: dict[str, DataFrame], q: str, limit: int) -> DataFrame:
    """(kind, id, part, hits) of each source (id, part, text): the rows with most words of a search, ``limit`` of each."""
    wanted = sorted({w for a in parsed(q) for ok, p in a if ok for w in p})

    def top(kind: str, df: DataFrame) -> DataFrame:
        words = df.select("id", "part", lexemes(F.col("text")).alias("w")).where(matches(F.col("w"), q))
        return words.select(F.lit(kind).alias("kind"), "id", "part", F.size(F.filter("w", lambda x: x.isin(*wanted))).alias("hits")).orderBy(F.desc("hits"), "id", "part").limit(limit)

    return reduce(DataFrame.unionByName, (top(kind, df) for kind, df in sources.items()))
