"""Porter's published algorithm (1980) as steps of expressions, for Spark and as SQL for DuckDB.

Each step rewrites all words of a table at once. The rules are given once; the two engines differ only in how
they name a group in a replacement and a test by a regular expression. Words of two letters or fewer stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A run of consonants, and one of vowels; y is a vowel but after another one or at the beginning.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: What a stem begins with if it has a vowel, one or more runs of vowel and consonant, two or more.
_VOWEL, _SOME, _MORE = f"(?:{_C})?[aeiouy]", f"(?:{_C})?{_V}{_C}", f"(?:{_C})?{_V}{_C}{_V}{_C}"
_SHORT = f"^{_C}[aeiouy][^aeiouwxy]"
#: Endings and what stands for them, by step. Fixed values.
_STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = "al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize".split()
_DOUBLES = "|".join(c + c for c in "bcdfghjkmnpqrtvwx")


def _steps(group: str, test: str) -> list[dict[str, str]]:
    """Columns to be rewritten, step by step; ``group`` names the first group, ``test`` is applied to (word, pattern)."""

    def is_(pattern: str) -> str:
        return test.format("w", pattern)

    def swap(pattern: str, to: str) -> str:
        return f"regexp_replace(w, '{pattern}', '{to}')"

    def cases(*pairs: tuple[str, str]) -> str:
        return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + " ELSE w END"

    def endings(rules: dict[str, str], begins: str) -> str:
        # the longest ending decides, even where what is before it is too short to lose it
        # and what an ending keeps of itself counts among what is before it
        own = lambda a, b: len(b) if a.startswith(b) and begins == _MORE else 0
        return cases(*((f"w LIKE '%{a}'", swap(f"^({begins}.*){a[own(a, b):]}$", group + b[own(a, b):])) for a, b in sorted(rules.items(), key=lambda r: -len(r[0]))))

    less = lambda n: f"substr(w, 1, length(w) - {n})"
    step_4 = {e: e[0] if e in ("sion", "tion") else "" for e in _STEP_4}
    stripped = is_(f"^{_VOWEL}.*(?:ed|ing)$")
    return [
        {"w": cases(("w LIKE '%sses' OR w LIKE '%ies'", less(2)), ("w LIKE '%ss'", "w"), ("w LIKE '%s'", less(1)))},
        {"cut": f"w NOT LIKE '%eed' AND {stripped}", "w": cases(("w LIKE '%eed'", swap(f"^({_SOME}.*)eed$", f"{group}ee")), (stripped, swap("^(.*)(?:ed|ing)$", group)))},
        {"w": cases(("NOT cut", "w"), (is_("(?:at|bl|iz)$"), "concat(w, 'e')"), (is_(f"(?:{_DOUBLES})$"), less(1)), (is_(f"{_SHORT}$"), "concat(w, 'e')"))},
        {"w": swap(f"^({_VOWEL}.*)y$", f"{group}i")},
        {"w": endings(_STEP_2, _SOME)},
        {"w": endings(_STEP_3, _SOME)},
        {"w": endings(step_4, _MORE)},
        {"w": cases((is_(f"^{_MORE}.*e$"), less(1)), (f"{is_(f'^{_SOME}(?:{_V})?e$')} AND NOT {is_(f'{_SHORT}e$')}", less(1)))},
        {"w": cases((f"{is_(f'^{_MORE}')} AND w LIKE '%ll'", less(1)))},
    ]


def stemmed(words: DataFrame, word: str = "word", stem: str = "stem") -> DataFrame:
    """A table with the stem of one of its columns added; give it distinct words."""
    out = words.withColumn("w", F.col(word)).withColumn("cut", F.lit(False))
    for step in _steps("$1", "{0} RLIKE '{1}'"):
        out = out.selectExpr(*(f"`{c}`" for c in words.columns), f"{step['w']} AS w", f"{step.get('cut', 'cut')} AS cut")
    return out.select(*words.columns, F.when(F.length(word) < 3, F.col(word)).otherwise(F.col("w")).alias(stem))


def stems_sql(words: str, name: str = "stems") -> str:
    """SQL of tables, the last of which has the given name and (word, stem) of each row of a table of words."""
    out = [f"{name}_0 AS (SELECT word, word AS w, false AS cut FROM {words})"]
    steps = _steps(r"\1", "regexp_matches({0}, '{1}')")
    for k, step in enumerate(steps):
        out.append(f"{name}_{k + 1} AS (SELECT word, {step['w']} AS w, {step.get('cut', 'cut')} AS cut FROM {name}_{k})")
    return ", ".join([*out, f"{name} AS (SELECT word, CASE WHEN length(word) < 3 THEN word ELSE w END AS stem FROM {name}_{len(steps)})"])
