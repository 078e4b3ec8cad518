"""Markup of pages against a regular expression on small pages, and its time on pages of tags without an end."""

from __future__ import annotations

import random
import re
import time

import pytest

from covenant.functions.html_text import text_of
from covenant.functions.markup import markup

RAW = frozenset({"script", "style", "title"})
PLAIN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>", re.DOTALL | re.IGNORECASE
)


def test_random_pages():
    rng = random.Random(9)
    bits = ["<", "</", ">", "<b", "<p ", "a=", '="', "='", '"', "'", " ", "=", "<!--", "-->", "<!", "<?x", "<script", "</script >", "<Style>", "</style>", "x", "\n", "<a href=", "<title>"]
    for _ in range(20_000):
        page = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        expected = [(m.start(), m.end(), m[3].lower() if m[3] else None, bool(m[2]), m[4] or "") for m in PLAIN.finditer(page)]
        assert [tuple(m) for m in markup(page, RAW)] == expected, page


@pytest.mark.parametrize("piece", ["<b ", "<!", "<b =\">\" ", "<b ='", "<", "</", "<?", "<script ", "<!-- ", "<b a='\"", "= ", "<b>", "<a href=\"x>y\">"])
def test_ten_megabytes_take_seconds(piece):
    page = piece * (10_000_000 // len(piece))
    began = time.time()
    for _ in markup(page, RAW):
        pass
    assert time.time() - began < 30


def test_open_tags_are_text():
    began = time.time()
    assert len(text_of("<b " * 300_000)) > 0 and text_of("a <b c") == "a <b c" and text_of("<p>x</p><script>y") == "x" and text_of(None) is None
    assert time.time() - began < 5
