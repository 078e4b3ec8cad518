"""Benchmark decontamination by Wu-Manber search over words.

Texts and benchmark items become words: A-Z lower-cased, then runs of letters, digits and bytes above
ASCII. Each run of ten words of an item is a pattern; an item of fewer, but not none, is one pattern.
Patterns of one length share tables: for each block of three words, how far a search may jump on (the
shift), and for each block that ends a pattern, the patterns that it ends, by the block that begins them;
those of both blocks are then compared word by word. In most places of a text a block is in no pattern and the search jumps eight words.

The tables are built from the items in parts of at most ``part_words`` words, each sent to the
documents in turn, in one pass without a shuffle; a document's spans and items are joined over parts.

Defined results: null and empty texts have no words and no hits; items without words match nothing;
items with the same id count once and a null id reads as ``null``; rows repeated give repeated
results; an empty table gives an empty one, and an empty benchmark hits nothing; columns that clash
with those added are replaced by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from covenant.llm.shared import by_bytes

WINDOW = 10
BLOCK = 3
ADDED = ["n_words", "spans", "items"]
#: Bytes that are no part of a word become spaces, and A-Z become a-z.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: str | bytes | None) -> list[bytes]:
    if not text:
        return []
    raw = text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
    return raw.translate(_FOLD).split()


class WuManber:
    """Patterns of one length in words, each with the items that have it."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]]) -> None:
        self.length = len(next(iter(patterns)))
        self.block = min(BLOCK, self.length)
        self.furthest = self.length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.ending: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[tuple[list[bytes], set[str]]]]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, self.length + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.furthest), self.length - end)
            self.ending.setdefault(pattern[-self.block :], {}).setdefault(pattern[: self.block], []).append((list(pattern), items))

    def search(self, words: list[bytes], spans: list[tuple[int, int]], items: set[str]) -> None:
        """Add the span of each occurrence, and the items whose pattern it is."""
        m, size, get, furthest = self.length, self.block, self.shift.get, self.furthest
        at, n = m, len(words)
        while at <= n:
            block = tuple(words[at - size : at])
            jump = get(block, furthest)
            if jump:
                at += jump
                continue
            here = words[at - m : at]
            for pattern, owners in self.ending[block].get(tuple(here[:size]), ()):
                if pattern == here:
                    spans.append((at - m, at))
                    items |= owners
            at += 1


def tables(items: list[tuple[str, str | None]], window: int = WINDOW) -> list[WuManber]:
    """A search for each length of pattern among the items (id, text)."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            by_length.setdefault(n, {}).setdefault(tuple(words[i : i + n]), set()).add(item)
    return [WuManber(patterns) for _, patterns in sorted(by_length.items())]


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _parts(items: DataFrame, part_words: int) -> Iterator[list[tuple[str, str | None]]]:
    part: list[tuple[str, str | None]] = []
    n = 0
    for row in items.select("item_id", "text").toLocalIterator():
        part.append(("null" if row.item_id is None else str(row.item_id), row.text))
        n += len(row.text or "") // 4
        if n >= part_words:
            yield part
            part, n = [], 0
    yield part


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, part_words: int = 200_000) -> DataFrame:
    """docs with n_words, spans (from and to, in words, of what occurs in the benchmark) and items added."""
    docs = docs.drop(*ADDED)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    added = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("items", T.ArrayType(T.StringType()))])
    schema = T.StructType([*docs.schema.fields, *added.fields])
    kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]
    spark = docs.sparkSession
    out = docs
    for part in _parts(items, part_words):
        sent = spark.sparkContext.broadcast(part)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            searches = tables(sent.value, window)
            for b in by_bytes(batches):
                before = b.column("spans").to_pylist() if "spans" in b.schema.names else None
                known = b.column("items").to_pylist() if before is not None else None
                counts, all_spans, all_items = [], [], []
                for i, text in enumerate(b.column("text").cast(pa.large_binary()).to_pylist()):
                    words = words_of(text)
                    spans = [(s["start"], s["end"]) for s in before[i]] if before else []
                    found = set(known[i]) if known else set()
                    for search in searches:
                        search.search(words, spans, found)
                    counts.append(len(words))
                    all_spans.append([{"start": s, "end": e} for s, e in joined(spans)])
                    all_items.append(sorted(found))
                kept = [b.column(c) for c in b.schema.names if c not in ADDED]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *(pa.array(v, k) for v, k in zip((counts, all_spans, all_items), kinds, strict=True))], [f.name for f in schema.fields]
                )

        out = out.mapInArrow(scan, schema)
    return out
