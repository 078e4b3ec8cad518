"""Pages of documents cut into chunks along their headings, tables alone, a document at a time in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that a chunk aims at, and that a piece of text never exceeds unless a word does. Fixed values.
TARGET, CEILING = 2400, 4000
_HEADING = re.compile(r"(#{1,6})\s+([^\n]+)\Z")
_ROW = re.compile(r"\s*\|.*\|\s*\Z")
_ITEM = re.compile(r"\s*([-*]|[0-9]+[.)])\s+")


def _lines(block: str) -> list[str]:
    return [x for x in block.splitlines() if x.strip()]


def pieces(text: str, most: int = CEILING) -> list[str]:
    """A text cut at single spaces into parts of at most so many characters; a longer word is a part of its own."""
    if len(text) <= most:
        return [text]
    out: list[str] = []
    low = 0
    while len(text) - low > most:
        at = text.rfind(" ", low, low + most + 1)
        at = text.find(" ", low) if at < low else at
        if at < 0:
            break
        out.append(text[low:at])
        low = at + 1
    return [*out, text[low:]]


@dataclass
class Chunk:
    """Parts of text on some pages under one path of headings."""

    path: tuple[str, ...]
    kind: str | None = None
    parts: list[str] = field(default_factory=list)
    pages: list[int] = field(default_factory=list)

    def room(self, part: str, target: int) -> bool:
        return not self.parts or sum(map(len, self.parts)) + len(part) <= target

    def add(self, part: str, page: int) -> None:
        self.parts.append(part)
        self.pages.append(page)

    def row(self) -> tuple[str, str, str | None, int, int, str]:
        content = "\n\n".join(self.parts).strip()
        lines = _lines(content)
        kind = self.kind or ("list" if 2 * sum(bool(_ITEM.match(x)) for x in lines) > len(lines) else "text")
        return kind, " > ".join(self.path), self.path[-1] if self.path else None, self.pages[0], self.pages[-1], content


def chunks(pages: list[str | None], separator: str = r"\n\s*\n", target: int = TARGET, ceiling: int = CEILING) -> list[tuple[str, str, str | None, int, int, str]]:
    """(kind, path of headings, last heading, first page, last page, content) of each chunk, pages counted from 1.

    A heading begins a chunk, and is one of kind heading if no text follows; a table is one of its own;
    text is packed up to the target, and a block over the ceiling is cut at spaces first.
    """
    out: list[Chunk] = []
    levels: list[int] = []
    path: tuple[str, ...] = ()
    current: Chunk | None = None
    for page, text in enumerate(pages, 1):
        for block in filter(None, (b.strip() for b in re.split(separator, text or ""))):
            lines = _lines(block)
            if len(lines) > 1 and all(map(_ROW.match, lines)):
                out.append(Chunk(path, "table", [block], [page]))
                current = None
                continue
            heading = _HEADING.match(lines[0]) if len(lines) == 1 else None
            if heading:
                keep = sum(level < len(heading[1]) for level in levels)
                # deeper or equal ones go; they stand at the end, as levels rise
                levels, path = [*levels[:keep], len(heading[1])], (*path[:keep], heading[2])
                current = Chunk(path, "heading")
                current.add(block, page)
                out.append(current)
                continue
            for part in pieces(block, ceiling):
                if current is None or not current.room(part, target):
                    current = Chunk(path)
                    out.append(current)
                current.add(part, page)
                current.kind = None
    return [c.row() for c in out]


def chunked(docs: DataFrame, key: str, pages: str, separator: str = r"\n\s*\n", target: int = TARGET, ceiling: int = CEILING) -> DataFrame:
    """(key, chunk_index, kind, path, heading, page_start, page_end, content) of documents with an array of pages, chunk by chunk."""
    names = ["chunk_index", "kind", "path", "heading", "page_start", "page_end", "content"]
    kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, texts in enumerate(b.column(pages)):  # one document's pages at a time are Python objects
                found = [(n, *c) for n, c in enumerate(chunks(texts.as_py() or [], separator, target, ceiling))]
                if found:
                    owner = b.column(key).take(pa.array([i] * len(found)))
                    yield pa.RecordBatch.from_arrays([owner, *(pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True))], [key, *names])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, pages).mapInArrow(run, f"{key} {kind}, chunk_index int, kind string, path string, heading string, page_start int, page_end int, content string")


def of_pages(text: str, mark: str = "\f"):
    """A text as an array of its pages."""
    return F.split(text, mark)
