"""Line dedup over all documents by sorted hashes, giving a keep bitmap for each document.

A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of at least
``least_chars`` code points become rows of a 128-bit hash, document, text and line number, which are
dealt out by ranges of hash and document and sorted by hash, document (largest first) and line. Running
through a range, the first document of a hash is the one that keeps its lines, and once five
documents have it, the lines of all others go. Only the first and last hash of a range can go on in
another: their counts, two for each range, are added up, and their lines are decided after that. So a
line that a third of all documents hold is spread over as many ranges as its rows fill.

Lines that go are gathered for each text as a bitmap, one bit for each line up to the last that goes,
compressed. To apply them, texts and bitmaps meet in one shuffle by document, the same at every size.

Defined results: a null or empty text is one empty line, which stays; documents are told apart by
doc_id, so several texts with one doc_id are one document that has the lines of all, each row keeping
its own; rows repeated give the same result each; lines of a null doc_id count for nothing and stay; an
empty table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.llm.shared import by_bytes, materialized, n_slices

_WHITE = b" \t\n\x0b\x0c\r"


def _hashed_lines(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches):
            high, low, docs, texts, lines = [], [], [], [], []
            for doc, of, text in zip(b.column("doc_id").to_pylist(), b.column("of").to_pylist(), b.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                if doc is None or not text:
                    continue
                for i, line in enumerate(text.lower().split(b"\n")):
                    if len(line) < least_chars:
                        continue
                    key = line.strip(_WHITE)
                    if len(key) < least_chars or (not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < least_chars):
                        continue
                    h = xxhash.xxh3_128_intdigest(key)
                    high.append((h >> 64) - (1 << 63))
                    low.append((h & ((1 << 64) - 1)) - (1 << 63))
                    docs.append(doc)
                    texts.append(of)
                    lines.append(i)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (high, low, docs, texts)), pa.array(lines, pa.int32())], ["h1", "h2", "doc_id", "of", "line"])

    return run


def _decided(least_docs: int):
    """Rows of a range, sorted, to lines that go (n null), open lines, and counts of open hashes (line null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), schema=pa.schema([*((c, pa.int64()) for c in ("h1", "h2", "doc_id", "of")), ("line", pa.int32())]))
        n = len(rows)
        if not n:
            return
        h1, h2, doc, of, line = (rows[c].combine_chunks().to_numpy() for c in ("h1", "h2", "doc_id", "of", "line"))
        new_run = np.ones(n, bool)
        new_run[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new_doc = new_run.copy()
        new_doc[1:] |= doc[1:] != doc[:-1]
        run_of = np.cumsum(new_run) - 1
        starts = np.flatnonzero(new_run)
        n_docs = np.add.reduceat(new_doc.astype(np.int64), starts)
        keeper = doc[starts]
        boundary = (run_of == 0) | (run_of == run_of[-1])
        goes = ~boundary & (n_docs[run_of] >= least_docs) & (doc != keeper[run_of])
        ends = np.unique([0, len(starts) - 1])

        def made(at: np.ndarray, docs: np.ndarray, lines: pa.Array, counts: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h1[at]), pa.array(h2[at]), pa.array(docs), pa.array(of[at]), lines, counts], ["h1", "h2", "doc_id", "of", "line", "n"])

        for at, count in ((np.flatnonzero(goes), None), (np.flatnonzero(boundary), 0)):
            counts = pa.nulls(len(at), pa.int64()) if count is None else pa.array(np.zeros(len(at), np.int64))
            yield made(at, doc[at], pa.array(line[at]), counts)
        yield made(starts[ends], keeper[ends], pa.nulls(len(ends), pa.int32()), pa.array(n_docs[ends]))

    return run


def _text_number() -> Column:
    """What tells the texts of one doc_id apart."""
    return F.xxhash64("text")


def dropped_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, range_rows: int = 400_000) -> DataFrame:
    """(doc_id, of, line) of every line that goes; ``of`` is the number of its text."""
    lines = docs.select("doc_id", _text_number().alias("of"), "text").mapInArrow(_hashed_lines(least_chars), "h1 long, h2 long, doc_id long, of long, line int")
    keys = materialized(lines, "line-hashes")
    n_ranges = max(n_slices(docs.sparkSession, 12), -(-keys.count() // range_rows))
    by = ["h1", "h2", F.col("doc_id").desc()]
    ranged = keys.repartitionByRange(n_ranges, *by).sortWithinPartitions(*by, "of", "line")
    seen = materialized(ranged.mapInArrow(_decided(least_docs), "h1 long, h2 long, doc_id long, of long, line int, n long"), "line-runs")
    open_hashes = seen.where("line is null").groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.max("doc_id").alias("keeper"))
    open_lines = seen.where("n = 0 and line is not null").join(F.broadcast(open_hashes) if n_ranges <= 1 << 18 else open_hashes, ["h1", "h2"])
    return seen.where("n is null").select("doc_id", "of", "line").union(
        open_lines.where((F.col("docs") >= least_docs) & (F.col("doc_id") != F.col("keeper"))).select("doc_id", "of", "line")
    )


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        maps, counts = [], []
        for gone in b.column("gone").to_pylist():
            keep = np.ones(max(gone) // 8 * 8 + 8, bool)  # whole bytes, as lines past the last that goes stay
            keep[gone] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            counts.append(int(len(keep) - keep.sum()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("of"), pa.array(counts, pa.int64()), pa.array(maps, pa.binary())], ["doc_id", "of", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, of, n_dropped, keep) of every text that loses a line."""
    gone = dropped_lines(docs, **options).groupBy("doc_id", "of").agg(F.collect_set("line").alias("gone"))
    return gone.mapInArrow(_bitmaps, "doc_id long, of long, n_dropped long, keep binary")


def kept_lines(text: bytes | None, keep: bytes | None) -> list[bytes]:
    """What stays of a text under its bitmap; lines past its end do."""
    lines = (text or b"").split(b"\n")
    if keep is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8)).tolist()
    return [line for i, line in enumerate(lines) if i >= len(bits) or bits[i]]


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in by_bytes(batches):
        n_lines, sha = [], []
        for text, keep in zip(b.column("text").cast(pa.large_binary()).to_pylist(), b.column("keep").to_pylist(), strict=True):
            n_lines.append((text or b"").count(b"\n") + 1)
            sha.append(hashlib.sha256(b"\n".join(kept_lines(text, keep))).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_lines, pa.int64()), b.column("n_dropped"), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def line_digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every row of docs, by its bitmap."""
    docs = docs.select("doc_id", "text")
    bitmaps = materialized(keep_bitmaps(docs, **options), "bitmaps")
    # each partition's bitmaps are held and its texts run past them, without a sort of texts
    with_map = docs.withColumn("of", _text_number()).join(bitmaps.hint("shuffle_hash"), ["doc_id", "of"], "left")
    return with_map.select("doc_id", "text", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "keep").mapInArrow(
        _applied, "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
    )
