"""Search, rules, chunks and HTML over whole texts (inventory H and the text rows of N)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.bindings import Roles
from covenant.functions.html_text import html_text
from covenant.functions.text import trigram_similarity
from covenant.operators.chunking import chunked, of_pages
from covenant.operators.rules import RULES, Rule, item_hits, phrase_hits
from covenant.operators.search import STOP_WORDS, lexemes, matches
from covenant.plans.combining import _TRIGRAMS
from covenant.registry import query

_STOP = ",".join(f"'{w}'" for w in sorted(STOP_WORDS))
_LEX = f"list_filter(string_split_regex(lower({{x}}), '[^a-z0-9]+'), lambda w: w <> '' AND NOT list_contains([{_STOP}], w))"


@query("t02_lexemes", "T02", f"SELECT doc_id, len(w) AS words, len(list_distinct(w)) AS distinct_words FROM (SELECT doc_id, {_LEX.format(x='text')} AS w FROM document)")
def lexeme_counts(r: Roles) -> DataFrame:
    w = r.document.select("doc_id", lexemes(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("words"), F.size(F.array_distinct("w")).cast("long").alias("distinct_words"))


@query(
    "t03_websearch",
    "T03",
    f"""WITH w AS (SELECT doc_id, {_LEX.format(x='text')} AS w FROM document)
    SELECT doc_id FROM w WHERE (list_contains(w, 'license') AND NOT list_contains(w, 'mit')) OR contains(' ' || array_to_string(w, ' ') || ' ', ' rights reserved ')""",
)
def websearch(r: Roles) -> DataFrame:
    """Words, phrases, alternatives and exclusions."""
    w = r.document.select("doc_id", lexemes(F.col("text")).alias("w"))
    return w.where(matches(F.col("w"), 'license -mit or "rights reserved"')).select("doc_id")


@query("t04_plain_words", "T04", f"SELECT doc_id FROM (SELECT doc_id, {_LEX.format(x='text')} AS w FROM document) WHERE list_contains(w, 'license') AND list_contains(w, 'version')")
def plain_words(r: Roles) -> DataFrame:
    w = r.document.select("doc_id", lexemes(F.col("text")).alias("w"))
    return w.where(matches(F.col("w"), "license version")).select("doc_id")


@query(
    "t06_trigram_similarity",
    "T06",
    f"""WITH t AS (SELECT p_partkey AS part_id, {_TRIGRAMS.format(x="p_name")} AS a, {_TRIGRAMS.format(x="'small rings'")} AS b FROM part)
    SELECT part_id, round(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS similarity FROM t WHERE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) > 0.3""",
)
def trigram_search(r: Roles) -> DataFrame:
    s = r.table("part").select(F.col("p_partkey").alias("part_id"), trigram_similarity(F.col("p_name"), F.lit("small rings")).alias("s"))
    return s.where("s > 0.3").select("part_id", F.round("s", 6).alias("similarity"))


@query(
    "t07_item_rules",
    "T07",
    """SELECT issuer_id, rule FROM (SELECT DISTINCT l_orderkey AS issuer_id, '1.0' || l_linenumber AS code FROM lineitem) JOIN (VALUES ('1.03', '8k_item_1_03_bankruptcy'), ('1.04', 'none')) v(code, rule) USING (code) WHERE rule <> 'none'""",
)
def item_rules(r: Roles) -> DataFrame:
    """Codes in a comma-separated list held against the rules for items."""
    items = F.array_join(F.sort_array(F.collect_set(F.concat(F.lit("1.0"), F.col("l_linenumber").cast("string")))), ", ")
    filings = r.table("lineitem").groupBy(F.col("l_orderkey").alias("issuer_id")).agg(items.alias("items"))
    return item_hits(filings, "items").select("issuer_id", "rule")


#: Rules with the same engine for words that the texts at hand have.
SUBSTITUTES = (
    Rule("license", "phrase", "licensed under the .{0,20} license", "license", "medium", 0.7, needs=("licensed under the ",)),
    Rule("rights", "phrase", "(all )?rights reserved", "rights", "low", 0.4, needs=("rights reserved",)),
    Rule("key", "phrase", "(token|api_key|secret)", "secret", "high", 0.9, needs=("token", "api_key", "secret")),
)


@query(
    "t08_phrase_rules",
    "T08 T09",
    """WITH p(rule, pattern) AS (VALUES ('license', 'licensed under the .{0,20} license'), ('rights', '(all )?rights reserved'), ('key', '(token|api_key|secret)')),
    h AS (SELECT doc_id, rule, text, regexp_extract(text, '(?i)' || pattern) AS found FROM document, p WHERE regexp_matches(text, '(?i)' || pattern)),
    s AS (SELECT *, strpos(text, found) - 1 AS start FROM h)
    SELECT doc_id, rule, start, start + length(found) AS "end", trim(substr(text, greatest(start - 160, 0) + 1, least(start + length(found) + 160, length(text)) - greatest(start - 160, 0))) AS excerpt FROM s""",
)
def phrase_rules(r: Roles) -> DataFrame:
    """First hit of each rule with what stands around it."""
    hits = phrase_hits(r.document.select("doc_id", "text"), "text", SUBSTITUTES)
    return hits.select("doc_id", "rule", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "excerpt")


#: A text for each phrase rule, and one that it isn't to hit; each document has one of them put in front.
PHRASES = (
    "filed a voluntary petition", "see Chapter 11 of it", "chapter 11 of the Internal Revenue Code", "a chapter 7 liquidation", "missed an interest payment", "an Event of Default", "acceleration of the indebtedness", "substantial doubt about its ability to continue as a going concern",
    "a going concern", "insufficient liquidity", "retained a restructuring advisor", "restructuring support agreement", "an exchange offer", "liability management exercise", "amend and extend", "extended the maturity", "refinanced its debt", "debtor-in-possession financing", "emergency funding",
    "sale of substantially all of its assets", "a delisting", "reduction in force", "closed the plant", "an impairment charge", "the auditor will resign", "an adverse opinion", "review of strategic alternatives", "amended the credit agreement", "order confirming the plan", "order dismissing it",
    "converted to chapter 7", "appointment of a trustee", "the bar date", "relief from the automatic stay", "nothing of note",
)
_PHRASE_RULES = ", ".join("('{}', '{}')".format(x.name, x.pattern.replace("'", "''")) for x in RULES if x.kind == "phrase")


@query(
    "t08_reference_rules",
    "T08",
    f"""WITH p(rule, pattern) AS (VALUES {_PHRASE_RULES}), t AS (SELECT doc_id, list_extract({list(PHRASES)}, CAST(doc_id % {len(PHRASES)} + 1 AS INTEGER)) || '. ' || text AS text FROM document)
    SELECT doc_id, rule FROM t JOIN p ON regexp_matches(text, '(?i)' || pattern) WHERE rule <> 'phrase_chapter_11_bare_mention' OR NOT regexp_matches(substr(text, 1, 200), '(?i)(internal revenue code|title 11.{{0,20}}code|chapter 11 of the)')""",
)
def reference_rules(r: Roles) -> DataFrame:
    """All phrase rules over all texts, each with a phrase in front."""
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % len(PHRASES) + 1).cast("int"))
    texts = r.document.select("doc_id", F.concat(phrase, F.lit(". "), "text").alias("text"))
    return phrase_hits(texts, "text", RULES).select("doc_id", "rule")


@query("t18_html_text", "T18")
def html_texts(r: Roles) -> DataFrame:
    """Text of pages by a parser, which SQL can't express."""
    return r.filing.select("filing_id", html_text("html").alias("text"))


@query("w15_chunks", "W15")
def document_chunks(r: Roles) -> DataFrame:
    """Chunks of every document, its lines taken as blocks; a scan with state, which SQL can't express."""
    pages = r.document.select("doc_id", of_pages("text").alias("pages"))
    c = chunked(pages, "doc_id", "pages", separator=r"\n")
    return c.select("doc_id", "chunk_index", "kind", "path", "page_start", "page_end", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("checksum"))
