"""Markup of HTML, found in time that is linear in the page, whatever is left open.

Where a tag ends depends on quotes after equals signs, and a quote that isn't closed is a character like any other. Both are
settled for the whole page in one pass from its end, so that a page of tags without an end isn't searched again for each.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

_ENDS = re.compile(r">|=\s*([\"'])")
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")


class Markup(NamedTuple):
    """A piece of markup: where it is, and of a tag its name, whether it closes, and its attributes."""

    start: int
    end: int
    name: str | None = None
    closing: bool = False
    attributes: str = ""


class _TagEnds:
    """The ends of tags of a page."""

    def __init__(self, page: str) -> None:
        self.at: list[int] = []
        quotes: list[int] = []  # where the quote stands, or -1 for an end
        for m in _ENDS.finditer(page):
            self.at.append(m.start())
            quotes.append(m.start(1))
        self.ends = [-1] * (len(self.at) + 1)
        for i in range(len(self.at) - 1, -1, -1):
            if quotes[i] < 0:
                self.ends[i] = self.at[i] + 1
                continue
            close = page.find(page[quotes[i]], quotes[i] + 1)
            self.ends[i] = self.ends[bisect_left(self.at, close + 1, i + 1) if close >= 0 else i + 1]

    def after(self, start: int) -> int:
        """Where a tag ends whose attributes begin at a place, or -1."""
        return self.ends[bisect_left(self.at, start)]


def markup(page: str, raw: frozenset[str]) -> Iterator[Markup]:
    """Comments, declarations, tags and whole elements of the ``raw`` kinds, in order.

    A comment or raw element that isn't closed goes on to the end of the page; a tag or declaration that isn't
    ended is text.
    """
    ends = _TagEnds(page)
    closes = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in raw}
    starts = re.compile(rf"(?:{'|'.join(sorted(raw))})\b", re.IGNORECASE)
    at, last = 0, page.rfind(">")
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield Markup(at, end)
            at = end
            continue
        if at > last:  # nothing from here on has an end but a comment
            at += 1
            continue
        if (m := starts.match(page, at + 1)) is not None:
            closed = closes[m[0].lower()].search(page, page.find(">", m.end()) + 1)
            end = closed.end() if closed else len(page)
            yield Markup(at, end)
            at = end
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at + 2) + 1
            yield Markup(at, end)
            at = end
            continue
        closing = page.startswith("</", at)
        name = _NAME.match(page, at + 1 + closing)
        end = ends.after(name.end()) if name else -1
        if end < 0:
            at += 1
            continue
        yield Markup(at, end, name[0].lower(), closing, page[name.end() : end - 1])
        at = end
