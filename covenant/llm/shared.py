"""Helpers of this subpackage: the shared folder, cut lineage, components, text hashing.

The hashing works on a whole Arrow batch at a time: the bytes of all its texts are one numpy array,
so that no Python object is made for a word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text hashed at once; bounds the size of the numpy temporaries.
PIECE_BYTES = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. In a session of one machine without that
    setting it is a temporary folder; on a cluster its absence is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="covenant-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialized(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at files any executor can read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, a job's shuffle files go when it ends; else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def rows_of(df: DataFrame, ids: DataFrame, key: str = "doc_id", most: int = 1_000_000, bound: int | None = None) -> DataFrame:
    """The rows of df whose key is in ids. Up to ``most`` ids are sent to the rows; beyond that both sides are
    shuffled. Ids are counted first, unless ``bound``, a counted number that they don't exceed, is low enough."""
    if bound is not None and bound <= most:
        return df.join(F.broadcast(ids.select(key)), key, "left_semi")
    return df.join(_counted(ids, key, most), key, "left_semi")


def rows_without(df: DataFrame, ids: DataFrame, key: str = "doc_id", most: int = 1_000_000) -> DataFrame:
    """The rows of df whose key isn't in ids, in the same way."""
    return df.join(_counted(ids, key, most), key, "left_anti")


def _counted(ids: DataFrame, key: str, most: int) -> DataFrame:
    ids = ids.select(key).distinct()
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def few(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df, to be sent to all rows if it is counted to have no more than so many, or else joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def joined_by_group(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, most_hot: int = 10_000) -> DataFrame:
    """Rows joined with their group, of which there is one for each value of the keys.

    ``size`` is a column of groups with the number of their rows. Groups that hold more than one row in
    ``most_hot`` of all, so fewer than that in number, are sent to the rows; the rest meet by a shuffle, in
    which no key has more than that share.
    """
    total = groups.agg(F.sum(size).alias("n")).first()["n"] or 0
    hot = groups.where(F.col(size) * most_hot > max(total, 1000 * most_hot))
    if hot.isEmpty():
        return rows.join(groups, keys)
    cold = groups.where(F.col(size) * most_hot <= max(total, 1000 * most_hot))
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


#: Ids from here on are given to rows that their doc_id doesn't tell from others.
FIRST_NODE = 1 << 62


def with_nodes(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs (doc_id, text, ...) with ``node``, a number for each doc_id and text, and whether any node isn't a doc_id.

    A doc_id of one row is its node. Where several rows have one, or it is null or no less than
    FIRST_NODE, the node is a hash of both that no other such row has, FIRST_NODE at least.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("_n"))
    odd = materialized(ids.where((F.col("_n") > 1) | F.col("doc_id").isNull() | (F.col("doc_id") >= FIRST_NODE)).select("doc_id", F.lit(True).alias("_odd")), "odd-ids")
    if odd.isEmpty():
        return docs.withColumn("node", F.col("doc_id")), False
    told = docs.join(few(odd.where("doc_id is not null")), "doc_id", "left")
    is_odd = F.col("_odd").isNotNull() | F.col("doc_id").isNull()
    seed = 0
    while True:
        made = F.lit(FIRST_NODE) + F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), "doc_id", "text"), F.lit(FIRST_NODE))
        names = told.where(is_odd).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), F.col("text").isNull().alias("none"), made.alias("node")).distinct()
        if names.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return told.withColumn("node", F.when(is_odd, made).otherwise(F.col("doc_id"))).drop("_odd"), True
        seed += 1


def n_slices(spark: SparkSession, least: int = 32) -> int:
    """Partitions to deal hashed rows to; follows the cluster's setting and not the data's keys."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: So many labels of components are sent to the edges.
MOST_LABELS = 1_000_000


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """Edges (a, b) to (id, component): the smallest id that each id of an edge reaches.

    An id's label meets those of its neighbours in one grouped min, which Spark combines before the
    shuffle, and labels are then twice replaced by their own labels (pointer jumping), so rounds grow with
    the logarithm of a component's diameter. A label is an id of its component and no larger than the id it is
    of, so labels are final once no edge has two: edges are held against the labels, without a shuffle where
    labels are sent. Up to a million labels are sent to the edges; beyond that both are shuffled. Edges are
    read again each round, so they should be a written table.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # there are no more labels than ends of edges
    small = edges.limit(MOST_LABELS // 2 + 1).count() <= MOST_LABELS // 2
    sent = F.broadcast if small else few

    def further(labels: DataFrame) -> DataFrame:
        known = sent(labels)
        near = both.join(known.select(F.col("a").alias("b"), "label"), "b").select("a", "label")
        stepped = near.unionByName(labels.select("a", "label")).groupBy("a").agg(F.min("label").alias("label"))
        jump = lambda rows: rows.join(known.select(F.col("a").alias("label"), F.col("label").alias("further")), "label", "left").select("a", F.least("label", "further").alias("label"))
        return jump(jump(stepped))

    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"))
    while True:
        # labels that are sent needn't be written between rounds
        labels = materialized(further(further(labels)) if small else labels, f"{name}-labels")
        known = sent(labels)
        of = lambda side: known.select(F.col("a").alias(side), F.col("label").alias(f"of_{side}"))
        if edges.select("a", "b").join(of("a"), "a").join(of("b"), "b").where("of_a <> of_b").isEmpty():
            return labels.select(F.col("a").alias("id"), F.col("label").alias("component"))
        if not small:
            labels = further(labels)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    b = np.uint64(base)
    with np.errstate(over="ignore"):
        while done < n:
            more = min(done, n - done)
            step = out[done - 1] * b
            out[done : done + more] = out[:more] * step
            done += more
    return out


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class WordHasher:
    """64-bit hashes of the words of texts given as bytes, by a table of what separates words.

    A word's hash is a polynomial in its bytes, each replaced by a random number of 64 bits, with
    A-Z read as a-z. It doesn't depend on the word's place, the process or the batch.
    """

    def __init__(self, separators: bytes, seed: int = 7) -> None:
        self.separator = np.zeros(256, bool)
        self.separator[np.frombuffer(separators, np.uint8)] = True
        table = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)
        table[65:91] = table[97:123]
        self.table = table
        self.up = _powers(_BASE, PIECE_BYTES + 1)
        self.down = _powers(_INVERSE, PIECE_BYTES + 1)

    def _piece(self, data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and starts of the words of a piece; a word never crosses one of the breaks."""
        n = len(data)
        if n >= len(self.up):
            self.up, self.down = _powers(_BASE, n + 1), _powers(_INVERSE, n + 1)
        inside = ~self.separator[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cut = breaks[(breaks > 0) & (breaks < n)]
        first[cut] = inside[cut]
        starts = np.flatnonzero(first)
        if not len(starts):
            return np.empty(0, np.uint64), starts
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[cut - 1] = inside[cut - 1]
        ends = np.flatnonzero(last) + 1
        sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.table[data] * self.up[:n], out=sums[1:])
            h = (sums[ends] - sums[starts]) * self.down[starts]
            return mixed(h + (ends - starts).astype(np.uint64)), starts

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of a batch of texts, and per text where its words start in them (one more)."""
        data, offsets = buffers(texts)
        hashes, counts = [], np.zeros(len(texts) + 1, np.int64)
        for low, high in pieces(data, offsets, self.separator):
            h, starts = self._piece(data[low:high], offsets - low)
            hashes.append(h)
            counts[1:] += np.bincount(np.searchsorted(offsets, starts + low, "right") - 1, minlength=len(texts))
        return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), np.cumsum(counts)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary array, and its offsets in them; null is empty."""
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return data, at - at[0]


def pieces(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE_BYTES that end at the end of a text or at a separator."""
    low, end = 0, len(data)
    while low < end:
        high = min(low + PIECE_BYTES, end)
        if high < end:
            at = offsets[np.searchsorted(offsets, high, "right") - 1]
            if at > low:
                high = int(at)
            else:
                stop = int(offsets[np.searchsorted(offsets, low, "right")])
                found = np.flatnonzero(separator[data[low:high]])
                if len(found):
                    high = low + int(found[-1]) + 1
                else:
                    after = np.flatnonzero(separator[data[high:stop]])
                    high = high + int(after[0]) + 1 if len(after) else stop
        yield low, high
        low = high


def by_bytes(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about so many bytes of a text column, one row at least."""
    for b in batches:
        _, offsets = buffers(b.column(column))
        low = 0
        while low < len(b):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
            yield b.slice(low, high - low)
            low = high


#: Bytes that end a token: space and the controls from tab to carriage return.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
