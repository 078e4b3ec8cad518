"""Text functions as column builders; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say what kind of company it is and not which. Fixed values.
COMPANY_SUFFIXES = ("incorporated", "inc", "corporation", "corp", "company", "co", "holdings?", "group", "llc", r"l\.l\.c", "ltd", "limited", "plc", "lp", r"l\.p")


def company_key(name: Column) -> Column:
    """A company's name without case, kind of company and punctuation."""
    bare = F.regexp_replace(F.lower(name), r"\b(" + "|".join(COMPANY_SUFFIXES) + r")\b\.?", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", " "), " +", " "))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def number_in(text: Column, number: Column, least: int = 4) -> Column:
    """Whether the digits of a number, if enough, stand in the digits of a text."""
    d = digits(number)
    return (F.length(d) >= least) & F.contains(digits(text), d)


def truncated(x: Column, n: int) -> Column:
    """Trimmed; null if empty; cut to n characters, the last an ellipsis, if longer."""
    t = F.trim(x)
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.substring(t, 1, n - 1)), F.lit("…"))).otherwise(F.nullif(t, F.lit("")))


def first_filled(*values: Column) -> Column:
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def padded_number(x: Column, width: int = 10) -> Column:
    """A whole number as digits with leading zeros; null if it is none."""
    return F.lpad(x.try_cast("bigint").cast("string"), width, "0")


def humanized(label: Column) -> Column:
    return F.initcap(F.replace(label, F.lit("_"), F.lit(" ")))


def slug(x: Column, default: str = "item") -> Column:
    dashed = F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit(default))


def file_name(x: Column, default: str = "document.pdf", most: int = 255) -> Column:
    """A name without path, control characters and those that file systems reserve."""
    bare = F.regexp_replace(F.regexp_replace(x, r"^.*[/\\]", ""), r'[\x00-\x1f\x7f<>:"|?*]', "")
    return F.coalesce(F.nullif(F.substring(F.trim(bare), 1, most), F.lit("")), F.lit(default))


def unfenced(x: Column) -> Column:
    """Text without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def blocks(x: Column, separator: str = r"\n\s*\n") -> Column:
    """The trimmed blocks of a text that aren't empty."""
    return F.filter(F.transform(F.split(x, separator), lambda b: F.trim(b)), lambda b: b != "")


def is_table(block: Column) -> Column:
    lines = F.split(block, "\n")
    return (F.size(lines) >= 2) & F.forall(lines, lambda line: F.rlike(line, F.lit(r"^\s*\|.*\|\s*$")))


def heading_level(block: Column) -> Column:
    """How many signs a one-line heading has, 0 for other blocks."""
    return F.length(F.regexp_extract(block, r"^(#{1,6})\s+[^\n]+$", 1))


def is_list(block: Column) -> Column:
    lines = F.split(block, "\n")
    return F.size(F.filter(lines, lambda line: F.rlike(line, F.lit(r"^\s*([-*]|[0-9]+[.)])\s+")))) * 2 > F.size(lines)


def estimated_tokens(x: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(x) / 4).cast("int"))


def absolute_url(x: Column, host: str) -> Column:
    return F.when(F.rlike(x, F.lit("^https?://")), x).when(F.startswith(x, F.lit("/")), F.concat(F.lit(host), x)).otherwise(F.concat(F.lit(host + "/"), x))


def excerpt(text: Column, start: Column, end: Column, around: int = 160) -> Column:
    """The text from before a 0-based start to after an end, trimmed."""
    low = F.greatest(start - around, F.lit(0))
    high = F.least(end + around, F.length(text))
    return F.trim(F.substring(text, low + 1, high - low))


def trigrams(x: Column) -> Column:
    """Distinct runs of three characters of the words, each word with two spaces before and one after."""
    words = F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: w != "")
    return F.array_distinct(
        F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, 3))))
    )


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all."""
    x, y = trigrams(a), trigrams(b)
    shared = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(shared, F.size(x) + F.size(y) - shared), F.lit(0.0))


def coupon(x: Column) -> Column:
    """The rate of a description like ``4.5 06/15/29``."""
    return F.nullif(F.regexp_extract(x, r"([0-9]+(?:\.[0-9]+)?)\s+[0-9]{2}/[0-9]{2}/[0-9]{2}", 1), F.lit("")).cast("decimal(10,4)")


def packed_words(x: Column, most: int) -> Column:
    """A text cut at single spaces into pieces of at most so many characters; a longer word stands alone."""
    return F.aggregate(
        F.split(x, " "),
        F.array().cast("array<string>"),
        lambda out, w: F.when(
            (F.size(out) > 0) & (F.length(F.element_at(out, -1)) + 1 + F.length(w) <= most),
            F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat(F.element_at(out, -1), F.lit(" "), w))),
        ).otherwise(F.concat(out, F.array(w))),
    )
