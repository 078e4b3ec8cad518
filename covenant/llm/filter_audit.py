"""How filters interact: what each removes, alone and after others, in every order, from counts of joint failures.

Each document fails some of k filters. One pass counts, for each part of the table and each of the 2^k sets
S of filters, the documents that fail all of S: J(S), the sum of the product of the flags in S. From these
few numbers all else follows without another look at the documents:

- survivors of the filters in P, by inclusion and exclusion: sum over S within P of (-1)^|S| J(S), which is
  the Moebius inversion of J;
- what a filter f removes after those in P: survivors(P) - survivors(P and f);
- what it would have removed but that came too late (redundant): J(f) less that;
- what only f fails (unique): survivors(all but f) - survivors(all);
- f's Shapley value: the game "documents removed by the filters of S" has the Harsanyi dividends
  (-1)^(|S|+1) J(S), and f gets an |S|th of the dividend of each set S that it is in.

Copies of a text share all flags of the text itself, so documents are first counted by the hash of their
text; that a document repeats one of smaller id is then told from the smallest id of each hash. Only ids,
hashes and flags are shuffled. A text's copies are added up in the tasks that read them, so a text that is
a third of the table costs no task more than others do.

Defined results: a null text is an empty one (no words, no characters: it fails only what an empty text
fails); a null part is the empty string, and so one with an empty part; a null doc_id is no smaller than
any other and none is smaller, so it never repeats; rows repeated with one doc_id and text don't repeat
each other; a doc_id with several labels counts as marked if any of them is; an empty table gives no row;
other columns, of whatever name, are not read.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """The production filters that a text alone decides, by letter: what it is to fail each."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n_words = F.size(words).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", "")).cast("long")
    return {
        "A": n_words < 100,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 80 * n_words,
        "C": 100 * capitals > 10 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame, part: str = "lang", repeats: str = "E") -> DataFrame:
    """docs (doc_id, text, part) as counted rows: part, a flag for each filter, good, toxic and n documents.

    ``repeats`` names the filter failed by a document whose text is that of one with a smaller doc_id.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    letters = list(text_failures(text))
    rows = docs.select(
        "doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), F.sha2(text, 256).alias("sha"), *(c.cast("int").alias(k) for k, c in text_failures(text).items())
    )
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))))
    # a null doc_id has no mark; as part of the key, its text keeps such rows apart
    apart = F.when(F.col("doc_id").isNull(), F.xxhash64("sha")).otherwise(F.lit(0))
    rows = rows.withColumn("apart", apart).groupBy("doc_id", "apart", "sha", "part", *letters).agg(F.count("*").alias("n"))
    ids = rows.join(marks.withColumn("apart", F.lit(0).cast("long")), ["doc_id", "apart"], "left")
    ids = ids.withColumns({m: F.coalesce(m, F.lit(0)) for m in ("good", "toxic")})
    by_text = ["sha", "part", *letters, "good", "toxic"]
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    unknown = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    texts = ids.groupBy(*by_text).agg(F.sum("n").alias("n"), unknown.alias("unknown"), first.alias("first"))
    # a text's parts and marks: few rows, of which those with the smallest id hold the documents that don't repeat
    texts = texts.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("sha")))
    originals = F.col("unknown") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    counted = F.array(F.struct(F.lit(0).alias(repeats), originals.alias("n")), F.struct(F.lit(1).alias(repeats), (F.col("n") - originals).alias("n")))
    return texts.select("part", *letters, "good", "toxic", F.inline(counted)).where("n > 0")


def _sets(n: int) -> range:
    """All sets of n filters: filter i is in set s if bit i of s is set."""
    return range(1 << n)


def joint_failures(rows: DataFrame, filters: list[str]) -> DataFrame:
    """Per part, for each set of filters, how many documents fail all of it: all, good and toxic ones."""

    def failing(weight: str) -> str:
        sums = (" * ".join([weight, *(f"`{f}`" for i, f in enumerate(filters) if s >> i & 1)]) for s in _sets(len(filters)))
        return f"array({', '.join(f'sum({x})' for x in sums)})"

    return rows.groupBy("part").agg(*(F.expr(f"{failing(w)} AS {name}_failing") for name, w in (("docs", "n"), ("good", "n * good"), ("toxic", "n * toxic"))))


def _survivors(failing: str, n: int) -> str:
    """Moebius inversion of joint failures: for each set of filters, the documents that fail none of it."""
    terms = ([f"{'-' if s.bit_count() & 1 else '+'} {failing}[{s}]" for s in _sets(n) if s & p == s] for p in _sets(n))
    return f"array({', '.join(' '.join(['0L', *t]) for t in terms)})"


def _dividends(failing: str, filters: list[str], orders: int) -> str:
    """For each filter the dividends of the sets it is in, shared out; times the number of orders they are whole."""
    share = lambda s: (-1) ** (s.bit_count() + 1) * orders // s.bit_count()
    return f"array({', '.join(' + '.join(f'{failing}[{s}] * {share(s)}L' for s in _sets(len(filters)) if s >> i & 1) for i in range(len(filters)))})"


def interactions(joint: DataFrame, filters: list[str]) -> DataFrame:
    """For each part, order of the filters and step of it, what the step's filter does there."""
    n, everything = len(filters), (1 << len(filters)) - 1
    solved = joint.select(
        "part", "docs_failing", *(F.expr(f"{_survivors(f'{w}_failing', n)} AS {w}") for w in ("docs", "good", "toxic")),
        F.expr(f"{_dividends('docs_failing', filters, math.factorial(n))} AS dividends"),
    )
    at = [
        f"struct('{''.join(filters[i] for i in order)}', {k + 1}, {f}, {1 << f}, {sum(1 << i for i in order[:k])})"
        for order in itertools.permutations(range(n)) for k, f in enumerate(order)
    ]
    steps = solved.select("*", F.expr(f"inline(array({', '.join(at)})) AS (filter_order, step, filter, bit, before)"))
    lost = "{0}[before] - {0}[before | bit]".format
    return steps.selectExpr(
        "part", "filter_order", "step", "docs[before | bit] AS kept", f"{lost('docs')} AS removed", f"docs_failing[bit] - ({lost('docs')}) AS redundant",
        f"docs[{everything} - bit] - docs[{everything}] AS unique_fails", f"{lost('good')} AS good_lost", f"{lost('toxic')} AS toxic_lost", "dividends[filter] AS shapley",
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The five production filters, in all 120 orders, for each value of a column of docs."""
    filters = [*text_failures(F.lit("")), "E"]
    return interactions(joint_failures(failures(docs, labels, part), filters), filters)
