"""Main text of pages that names, languages, page ends and marks could hide."""

from __future__ import annotations

import random
import time

import pytest

from covenant.llm.html_extraction import extract, main_blocks

LONG = "It was the first of the days in which they had to see that all of this is for the good of the town and not for its market."
OTHER = "Uutisten mukaan kaupunki rakentaa uuden kirjaston keskustan laidalle, missä vanha tehdas seisoi vuosikymmeniä tyhjänä."


@pytest.mark.parametrize("opened", ['<body class="has-sidebar">', '<body class="page no-comments" id="search">', '<body><article class="post no-sidebar">', '<body><main class="content search">'])
def test_names_of_the_elements_that_hold_the_text(opened):
    assert main_blocks(f"<html>{opened}<p>{LONG}</p></html>") == [LONG]


def test_only_whole_names_count():
    page = f'<body><article><div class="article-header">The title</div><p class="share-price">{LONG}</p><div class="x share">Share it</div><div id="site_footer">About</div></article></body>'
    assert main_blocks(page) == ["The title", LONG]
    assert main_blocks(f'<div aria-label="Share of the market"><p>{LONG}</p></div><div aria-label="Share"><p>{LONG}</p></div>') == [LONG]


def test_language_without_stop_words_here():
    assert main_blocks(f"<body><h1>Kirjasto</h1><p>{OTHER}</p><p><a href=x>{OTHER}</a></p></body>") == ["Kirjasto", OTHER]


def test_short_blocks_at_page_ends():
    assert main_blocks(f"<p>Short.</p><p>{LONG}</p><p>The end.</p>") == ["Short.", LONG, "The end."]
    assert main_blocks(f"<p>Short.</p><p><a href=x>{LONG}</a></p><p>{LONG}</p><p><a href=x>{LONG}</a></p><p>Below.</p>") == [LONG]
    assert main_blocks("<p>Nothing but this.</p>") == ["Nothing but this."]
    assert main_blocks(None) == main_blocks("") == []


def test_teaser_cards_do_not_hide_the_text():
    cards = "".join(f"<article><h3><a href=/{i}>Card {i} with its linked title</a></h3><p>Read on</p></article>" for i in range(3))
    assert main_blocks(f"<body><div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div>{cards}</body>") == ["Title", LONG, LONG]


def test_link_lists_in_an_article_are_judged():
    links = "".join(f"<li><a href=/{i}>Another page of this site, number {i}</a></li>" for i in range(3))
    assert main_blocks(f"<article><h1>Title</h1><p>{LONG}</p><ul>{links}</ul><p>Short.</p><p>{LONG}</p></article><p>Imprint</p>") == ["Title", LONG, "Short.", LONG]


def test_marks_still_count():
    code = "x = y(z); " * 20
    assert main_blocks(f"<main><h2><a href=x>Linked title</a></h2><p>{LONG}</p><pre>{code}</pre><p>End.</p></main><div>Imprint</div>") == ["Linked title", LONG, code.strip(), "End."]
    assert main_blocks("<article><h1>Sold out</h1><p>No more today.</p></article>") == ["Sold out", "No more today."]
    replies = "".join(f"<article><p>{LONG}</p></article>" for _ in range(2))
    assert main_blocks(f"<div><p>{LONG}</p></div>{replies}") == [LONG] * 3


def test_quotes_in_tags():
    assert main_blocks(f"<p>{LONG} <a title='it's here' href=x>more</a> text</p>") == [f"{LONG} more text"]
    assert main_blocks(f'<p class="a>b" data-x=\'c">d\'>{LONG}</p><p title="open>{LONG}</p>') == [LONG, LONG]
    assert main_blocks(f"<p>{LONG} 3 < 4 &amp; 5 &gt; 4 &#8211; &nope; &copy;</p>") == [f"{LONG} 3 < 4 & 5 > 4 – &nope; ©"]


def test_deep_pages_take_time_in_proportion():
    page = lambda n: "<div>" * n + f"<p>{LONG}</p>" + "</div>" * n
    began = time.time()
    assert main_blocks(page(100_000)) == [LONG]
    assert time.time() - began < 5


@pytest.mark.parametrize("piece", ["<b ", "<!", "<b a=\"", "</"])
def test_long_pages_of_open_tags_take_time_in_proportion(piece):
    began = time.time()
    main_blocks(f"<p>{LONG}</p>" + piece * (10_000_000 // len(piece)))
    assert time.time() - began < 15


@pytest.mark.parametrize("opened", ['<div class="comment-body">', '<div id="comments-section">', '<div class="sidebar-left">', '<div class="x advert-box">', '<section class="post-comments">', '<article class="comment">', '<div id="related_posts">'])
def test_doubtful_names_beside_an_article(opened):
    closed = f"</{opened[1:].split()[0]}>"
    for before, after in (("<article>", "</article>"), ("<div>", "</div>")):
        inside = f"{before}<p>{LONG}</p>{opened}<p>{OTHER} {LONG}</p>{closed}<p>{LONG}</p>{after}"
        outside = f"{before}<p>{LONG}</p><p>{LONG}</p>{after}{opened}<p>{OTHER} {LONG}</p><p>Me too.</p>{closed}"
        assert main_blocks(f"<body>{inside}</body>") == main_blocks(f"<body>{outside}</body>") == [LONG, LONG]


@pytest.mark.parametrize("opened", ['<div class="content-sidebar-wrap">', '<div class="lead-block">', '<div class="has-sidebar">', '<div class="no-comments">', '<div class="comment-on-politics">', '<div class="page-header-lead">', '<div class="widget-area-free text">'])
def test_names_that_only_sound_doubtful(opened):
    assert main_blocks(f"<body><p>{LONG}</p>{opened}<p>{LONG}</p></div></body>") == [LONG, LONG]


def test_a_page_all_in_doubt_is_judged_as_any():
    assert main_blocks(f'<body><h1>Title</h1><div class="comment-body"><p>{LONG}</p><p>Short.</p></div></body>') == ["Title", LONG, "Short."]
    assert main_blocks(f'<div class="widget-container"><article><p>{LONG}</p></article></div><p>{LONG}</p>') == [LONG, LONG]


def test_pages_made_of_known_parts():
    """Articles between menus, notices, adverts, forms, comments and footers come out whole, with and without marks."""
    rng = random.Random(8)
    words = LONG.split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    junk = [
        lambda: "<nav><ul>" + "".join(f"<li><a href=/{i}>Part {i}</a></li>" for i in range(8)) + "</ul></nav>",
        lambda: f'<div class="cookie-banner"><p>{prose(40)}</p><button>OK</button></div>',
        lambda: f'<aside><p>{prose(30)}</p></aside>',
        lambda: f'<form><label>Mail</label><input name=m><p>{prose(30)}</p></form>',
        lambda: f"<script>var x = '<p>{prose(30)}</p>';</script><style>p {{ color: red }}</style><!-- {prose(9)} -->",
        lambda: f'<section id="comments"><p>{prose(60)}</p></section>',
        lambda: f'<div class="advert box"><a href=x>{prose(40)}</a></div>',
        lambda: f"<footer><p>{prose(30)}</p></footer>",
    ]
    for opened, closed in (("<article>", "</article>"), ("<main>", "</main>"), ("<div class=content>", "</div>")):
        for _ in range(20):
            parts = [f"Title {rng.randrange(99)}"] + [prose(rng.randrange(30, 80)) for _ in range(rng.randrange(2, 6))]
            body = f"<h1>{parts[0]}</h1>" + "".join(f"<p>{t.replace(' ', rng.choice([' ', '  ', chr(10)]), 3)}</p>" for t in parts[1:])
            rng.shuffle(junk)
            page = f"<html><head><title>T</title></head><body>{''.join(j() for j in junk[:4])}{opened}{body}{closed}{''.join(j() for j in junk[4:])}</body></html>"
            assert main_blocks(page) == parts


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "no markup"), (3, "u", "no markup"), (None, "u", f"<p>{LONG}</p>" * 3000), (4, "u", "<p"), (5, "u", "<script>x"), (6, "u", "\x00&#0;&#x110000;")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "'x' AS n_chars")
    found = {(r.page_id, r.html): (r.text, r.n_chars) for r in extract(pages).collect()}
    assert len(found) == 7 and all(n == len(t) for t, n in found.values())
    assert found[1, None] == ("", 0) and found[2, ""] == ("", 0) and found[3, "no markup"] == ("no markup", 9) and found[5, "<script>x"] == ("", 0)
    assert found[None, rows[4][2]][1] == 3000 * (len(LONG) + 1) - 1
    assert extract(pages.limit(0)).collect() == []
