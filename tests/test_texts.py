"""Chunks, HTML and rules on texts that take every branch."""

from __future__ import annotations

import re

from covenant.functions.html_text import html_text, text_of
from covenant.operators.chunking import chunked, chunks, pieces

PAGES = [
    "# One\n\nFirst text.\n\nSecond text.\n\n| a | b |\n|---|---|\n\nAfter the table.\n\n## Two\n\n- x\n- y\nnot an item",
    "1. z\n\n### Three\n\n# Four\n\nLast.",
    None,
]


def test_chunks_follow_headings_and_tables():
    assert chunks(PAGES) == [
        ("text", "One", "One", 1, 1, "# One\n\nFirst text.\n\nSecond text."),
        ("table", "One", "One", 1, 1, "| a | b |\n|---|---|"),
        ("text", "One", "One", 1, 1, "After the table."),
        ("list", "One > Two", "Two", 1, 2, "## Two\n\n- x\n- y\nnot an item\n\n1. z"),
        ("heading", "One > Two > Three", "Three", 2, 2, "### Three"),
        ("text", "Four", "Four", 2, 2, "# Four\n\nLast."),
    ]
    assert chunks([]) == chunks(["", " \n\n "]) == []


def test_packing_and_long_blocks():
    text = "\n\n".join("w" * n for n in (10, 10, 10, 10))
    assert [c[-1] for c in chunks([text], target=25)] == ["w" * 10 + "\n\n" + "w" * 10] * 2
    assert [c[-1] for c in chunks(["aa bb cc " + "d" * 9 + " e"], target=5, ceiling=5)] == ["aa bb", "cc", "d" * 9, "e"]


def test_pieces_by_packing_words():
    for text in ("a bb ccc dddd", "x" * 20, "a  b   c", "one two three four five six", " lead", "trail "):
        for most in (1, 3, 5, 8):
            out: list[str] = []
            for w in text.split(" "):
                if out and len(out[-1]) + 1 + len(w) <= most:
                    out[-1] += " " + w
                else:
                    out.append(w)
            assert " ".join(pieces(text, most)) == text and (len(text) <= most or len(pieces(text, most)) <= len(out)), (text, most)


def test_chunks_of_a_table(spark):
    docs = spark.createDataFrame([(1, PAGES), (2, None), (3, ["x"])], "doc_id long, pages array<string>")
    rows = chunked(docs, "doc_id", "pages").orderBy("doc_id", "chunk_index").collect()
    assert [(r.kind, r.path, r.heading, r.page_start, r.page_end, r.content) for r in rows if r.doc_id == 1] == chunks(PAGES)
    assert [(r.doc_id, r.chunk_index, r.content) for r in rows if r.doc_id != 1] == [(3, 0, "x")]


def test_text_of_html(spark):
    page = "<html><head><style>p > a {}</style><title>T &amp; U</title></head><!-- <p>no</p> --><body class='a>b'><p> One\n two</p><SCRIPT>if (a < b) {}</SCRIPT><br/>3 < 4 &eacute;</body>"
    assert text_of(page) == "T & U One\n two 3 < 4 é"
    assert text_of(None) is None and text_of("") == "" and text_of("<p>") == "" and text_of("plain") == "plain" and text_of("<script>x") == ""
    # without scripts and styles it is what is left between tags
    simple = "<div><p>a</p> <p> b <b>c</b></p></div>"
    assert text_of(simple) == " ".join(x.strip() for x in re.split("<[^>]*>", simple) if x.strip())
    found = spark.createDataFrame([(page,), (None,)], "html string").select(html_text("html").alias("t")).collect()
    assert [r.t for r in found] == [text_of(page), None]
