"""Exact dedup by composable polynomial fingerprints, confirmed by comparing chunks of text.

A text's bytes are cut into chunks from its end, so that a chunk's hash times a power of the base
given by its distance from the end is its share of the whole: shares add up, whatever task hashed
them. Texts longer than ``segment_bytes`` become several rows, and a grouped sum of their shifted
hashes gives the fingerprint of the whole.

Rows of equal fingerprint and length meet in a grouped count; groups that hold a large share of all
rows are sent to the rows, so that no task gets such a group whole. Each text of a group with two rows
or more is then compared with the text of the group's representative, chunk by chunk, in an equi-join on
(group, salt, chunk number). A text that differs from its representative, as hashes may collide, joins
the next round among those that differed from the same one.

Defined results: a null text counts as empty; empty texts are equal to each other; rows are told apart
by doc_id and text, so of several texts with one doc_id each has its own group; a row repeated comes out
as often, each with the same result; a null doc_id counts as smaller than any other, and keeps a null
where only such rows share a text; an empty table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.llm.shared import buffers, by_bytes, few, joined_by_group, materialized

#: Two prime moduli of 31 bits, and a base for each.
MODULI = (2147483647, 2147483629)
BASES = (1000003, 69069069)
CHUNK = 1024


def _power_table(modulus: int, base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    for i in range(1, n):
        out[i] = out[i - 1] * base % modulus
    return out


class Fingerprinter:
    """Polynomial hashes modulo each prime of many byte strings at once."""

    def __init__(self, moduli: tuple[int, ...] = MODULI, bases: tuple[int, ...] = BASES) -> None:
        self.moduli = moduli
        self.tables = [_power_table(m, b, CHUNK)[::-1].copy() for m, b in zip(moduli, bases, strict=True)]
        self.shift = [pow(b, CHUNK, m) for m, b in zip(moduli, bases, strict=True)]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """For byte strings data[offsets[i]:offsets[i + 1]]: for each modulus, their hashes."""
        lengths = np.diff(offsets)
        chunks = (lengths + CHUNK - 1) // CHUNK
        out = [np.zeros(len(lengths), np.int64) for _ in self.moduli]
        most = 4 << 20  # bytes laid out in chunks at once
        first = 0
        while first < len(lengths):
            take = max(1, int(np.searchsorted(np.cumsum(chunks[first:]) * CHUNK, most, "right")))
            rows = slice(first, first + take)
            n = int(chunks[rows].sum())
            grid = np.zeros(n * CHUNK, np.uint8)  # texts stand right-aligned in whole chunks; zeros add nothing
            ends = np.cumsum(chunks[rows]) * CHUNK
            for end, low, high in zip(ends.tolist(), offsets[first : first + take].tolist(), offsets[first + 1 : first + take + 1].tolist(), strict=True):
                grid[end - (high - low) : end] = data[low:high]
            grid = grid.reshape(n, CHUNK).astype(np.float64)
            level = int(chunks[rows].max(initial=0))
            begin = ends // CHUNK - chunks[rows]
            for h, m, table, shift in zip(out, self.moduli, self.tables, self.shift, strict=True):
                # products stay under 2 ** 53: powers are split in halves of 16 bits
                high, low = grid @ (table >> 16).astype(np.float64), grid @ (table & 65535).astype(np.float64)
                each = ((high.astype(np.int64) % m) * 65536 + low.astype(np.int64)) % m
                for k in range(level):  # Horner over the chunks: the length-shifted sum
                    on = np.flatnonzero(chunks[rows] > k)
                    h[first + on] = (h[first + on] * shift + each[begin[on] + k]) % m
            first += take
        return out


def fingerprints(docs: DataFrame, segment_bytes: int = 4 << 20, moduli: tuple[int, ...] = MODULI, bases: tuple[int, ...] = BASES) -> DataFrame:
    """(doc_id, sha, n_bytes, h1, h2) of every row, by a grouped sum over the segments of its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    segments = (
        docs.select("doc_id", F.sha2(text, 256).alias("sha"), F.octet_length(text).cast("long").alias("n_bytes"), text.cast("binary").alias("whole"))
        .select("*", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.col("n_bytes") - 1, F.lit(0)) / segment_bytes).cast("int"))).alias("k"))
        .select("*", F.greatest(F.col("n_bytes") - (F.col("k") + 1) * segment_bytes, F.lit(0)).alias("from"))
        .select(
            "doc_id", "sha", "n_bytes", (F.col("k").cast("long") * segment_bytes).alias("after"),
            F.col("whole").substr((F.col("from") + 1).cast("int"), (F.col("n_bytes") - F.col("k") * segment_bytes - F.col("from")).cast("int")).alias("part"),
        )
    )

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fingerprint = Fingerprinter(moduli, bases)
        for b in by_bytes(batches, "part"):
            hashes = fingerprint(*buffers(b.column("part")))
            after = b.column("after").to_numpy()
            for i in np.flatnonzero(after):
                for h, m, base in zip(hashes, moduli, bases, strict=True):
                    h[i] = int(h[i]) * pow(base, int(after[i]), m) % m
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "sha", "n_bytes", "after")), *map(pa.array, hashes)], ["doc_id", "sha", "n_bytes", "after", "h1", "h2"])

    shared = segments.mapInArrow(shares, "doc_id long, sha string, n_bytes long, after long, h1 long, h2 long")
    # a row repeated adds its shares again; so many rows have an end, and as many come out
    copies = F.count_if(F.col("after") == 0)
    return (
        shared.groupBy("doc_id", "sha", "n_bytes")
        .agg(copies.alias("copies"), *(F.expr(f"sum({c}) div count_if(after = 0) % {m}").alias(c) for c, m in zip(("h1", "h2"), moduli, strict=True)))
        .select("doc_id", "sha", "n_bytes", "h1", "h2", "copies")
    )


def _chunks(size: int) -> Column:
    """The text as an array of chunks of bytes, at least one."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.expr("cast(text as binary)").substr(k * size + 1, F.lit(size)))


def _id() -> Column:
    """A doc_id as a key without null."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def exact_dedup(docs: DataFrame, salt_rows: int = 64, compare_bytes: int = 1 << 16, **fingerprint) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts, the largest doc_id stays. ``salt_rows`` bounds the members of a group whose
    chunks are compared in one task, so the largest group is dealt to many.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    prints = materialized(fingerprints(docs, **fingerprint), "fingerprints")
    key = ["h1", "h2", "n_bytes"]
    rep = F.max(F.struct("doc_id", "sha")).alias("rep")
    groups = materialized(prints.groupBy(*key).agg(rep, F.sum("copies").alias("n"), F.count("*").alias("rows")), "fingerprint-groups")
    joined = materialized(joined_by_group(prints, groups, key, "rows"), "grouped-fingerprints")
    settled = joined.where("rows = 1")
    members = joined.where("rows > 1")
    texts = materialized(_texts_of(docs, members), "texts-to-compare")
    while True:
        # in a group, texts are told apart by what they are and not by whose they are
        salts = F.ceil(F.col("n") / salt_rows)
        told = members.select(_id().alias("id"), "sha", F.col("rep.sha").alias("group"), *key, "n", (F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("sha") == F.col("rep.sha"))).alias("is_rep"))
        chunked = texts.join(told, ["id", "sha"]).select("id", "sha", "group", *key, "is_rep", salts.alias("salts"), F.posexplode(_chunks(compare_bytes)).alias("k", "part"))
        meet = ["group", *key, "salt", "k"]
        theirs = chunked.where("not is_rep").withColumn("salt", F.pmod(F.xxhash64("id", "sha"), F.col("salts")))
        own = chunked.where("is_rep").select("group", *key, "k", F.col("part").alias("rep_part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        differ = materialized(theirs.join(own, meet).where("part <> rep_part").select("id", "sha", F.col("group")).distinct(), "differ")
        if differ.isEmpty():
            settled = settled.unionByName(members)
            break
        keyed = members.withColumn("id", _id()).withColumn("group", F.col("rep.sha"))
        other = keyed.join(few(differ), ["id", "sha", "group"])
        same = keyed.join(few(differ), ["id", "sha", "group"], "left_anti")
        by = [*key, "group"]
        settled = settled.unionByName(_regrouped(same, by).select(*settled.columns))
        members = materialized(_regrouped(other, by).select(*settled.columns), "members")
    return settled.select("*", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(
        "doc_id", F.col("rep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("rep.doc_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def _texts_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, sha, text) of the texts that members have, once each."""
    wanted = members.select(_id().alias("id")).distinct()
    return docs.select(_id().alias("id"), "text").join(few(wanted), "id", "left_semi").select("id", F.sha2("text", 256).alias("sha"), "text").distinct()


def _regrouped(members: DataFrame, by: list[str]) -> DataFrame:
    """Members with the largest row and the numbers of their group anew."""
    members = materialized(members.drop("rep", "n", "rows"), "members")
    groups = members.groupBy(*by).agg(F.max(F.struct("doc_id", "sha")).alias("rep"), F.sum("copies").alias("n"), F.count("*").alias("rows"))
    return joined_by_group(members, materialized(groups, "groups"), by, "rows")
