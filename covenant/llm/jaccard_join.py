"""Exact self-join of texts by the Jaccard similarity of their word shingles, and its components.

Jaccard distance is a metric, and documents within a distance of 1/4 link. The first pivots are single
shingles, which are points of the same space: a document that has the shingle is nearer to it than any
that doesn't, so its Voronoi region is the documents that share it. Were only a document's first shingle
(in one order of all shingles, rare before frequent) its pivot, links would cross borders; a document at
distance 1/4 lacks at most a quarter of the shingles, so a window of the first quarter, and one more,
replicates it to every region in which a link can be met first. Whole documents as the first pivots
would be at distance 1 from almost all others, and windows around their borders would take in everything.

Inside a region pivots are documents. The one of least id meets all others first; those that link with
it are its ball, of radius 1/4, and the rest are balls of one document. Linked documents become
components, and regions of one component are settled. In the others balls join recursively: pivots are
balls outside the region's largest component, more of them each turn, and a pivot's centre meets the
centres of the balls of other components. By the triangle inequality,

- centres within 1/4 of each other link, and all of both balls is one component;
- centres further apart than 1/4 and both radii leave no link between the balls;
- in between, a document alone meets the members of the other's ball; of two crowds, those members of one
  that are within 1/2 of the other's centre meet its members.

The pivot's ball is then done with. So crowds of copies cost a pair each and not a pair of pairs, what is
far from a crowd meets its centre and not its members, and no link between components is missed. Pairs
are verified exactly: a sketch of each set, whose distance is never more than the sets' own, rules most
out, and the whole sets of the rest are compared. Regions of more than ``wide`` documents are dealt to
many tasks by document, each with a ball of its own, and their balls meet as those of one region.

Documents with equal sets are one from the start. The order of shingles is by the number of documents
that have them, counted over all and read from arrays mapped into memory; it decides how many pairs
there are to verify and never which links are found. Shingles that one document has make no region.

Defined results: null and empty texts, and texts without words, have an empty set and link with
nothing; texts of one to four words have one shingle, all of them; rows are told apart by doc_id and
text, so of several texts with one doc_id each has its own result, and a row repeated gets the same one;
a row with a null doc_id links as any other, and its component has the least doc_id that there is in it,
or null if there is none; an empty table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covenant.llm.arrays import Arrays, as_bytes, grouped, narrow, of_bytes, write_arrays
from covenant.llm.shared import FIRST_NODE, SPACES, WordHasher, by_bytes, connected_components, few, joined_by_group, materialized, mixed, n_slices, rows_of, rows_without, shared_dir, with_nodes

WORDS = 5
#: Links are where PARTS * shared >= NEED * all.
NEED, PARTS = 75, 100
SKETCH = 256
#: Sketches of so many documents at most, about 30 MB, are sent to the pairs; more are met by a shuffle.
SENT = 100_000


def shingle_sets(hasher: WordHasher, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, in order, and where each text's begin (one more)."""
    h, at = hasher.batch(texts)
    n_words = np.diff(at)
    texts_of = np.repeat(np.arange(len(n_words)), n_words)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h), np.uint64)
        for k in range(min(WORDS, len(h))):
            out[: len(h) - k] += h[k:] * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
        out = mixed(out)
        # what is left of a text after a word: a shingle needs five, or all of a shorter text
        left = at[texts_of + 1] - np.arange(len(h))
        full = left >= WORDS
        short = np.flatnonzero((n_words > 0) & (n_words < WORDS))
        for i in short:
            words = h[at[i] : at[i + 1]]
            value = np.uint64(len(words))
            for w in words:
                value = mixed(value * np.uint64(31) + w)
            out[at[i]] = value
            full[at[i]] = True
    values, owners = out[full], texts_of[full]
    # sorted by text and value: each text's values are sorted in place
    counts = np.bincount(owners, minlength=len(n_words))
    begin = np.concatenate([[0], np.cumsum(counts)])
    for i in range(len(counts)):
        if counts[i] > 1:
            values[begin[i] : begin[i + 1]].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    counts = np.bincount(owners[fresh], minlength=len(n_words))
    return values[fresh], np.concatenate([[0], np.cumsum(counts)])


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of runs of values, modulo 2 ** 64; at holds where they begin and end."""
    total = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values, out=total[1:])
        return total[at[1:]] - total[at[:-1]]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher(SPACES)
    for b in by_bytes(batches):
        values, at = shingle_sets(hasher, b.column("text"))
        f1, f2 = _sums(values, at), _sums(mixed(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("node"), pa.array(np.diff(at)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), sketches(values, at)],
            ["doc_id", "node", "n_shingles", "f1", "f2", "sketch"],
        )


def sketches(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """How many shingles of each set fall in each of SKETCH classes, up to 255, a byte each.

    Two sets differ in at least as many shingles as these numbers do, which rules pairs out.
    """
    n = len(at) - 1
    places = np.repeat(np.arange(n), np.diff(at)) * SKETCH + (values >> np.uint64(56)).astype(np.int64)
    counts = np.minimum(np.bincount(places, minlength=n * SKETCH), 255).astype(np.uint8)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(SKETCH), n, [None, pa.py_buffer(counts.tobytes())]).cast(pa.binary())


def _shingle_counts(slices: int, bits: int, flush: int = 2_000_000):
    """How many documents have each shingle, as runs of the upper bits of hashes, by slice."""

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = grouped(np.concatenate(held))
        cuts = np.searchsorted(_slice_of(keys, slices, bits), np.arange(slices + 1))
        some = [(s, a, z) for s, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a]
        return pa.RecordBatch.from_arrays(
            [pa.array([s for s, _, _ in some], pa.int32()), pa.array([int(keys[a]) for _, a, _ in some], pa.int64()),
             pa.array([as_bytes(narrow(np.diff(keys[a:z]))) for _, a, z in some], pa.binary()),
             pa.array([as_bytes(narrow(counts[a:z])) for _, a, z in some], pa.binary())],
            ["slice", "first", "gaps", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, n = WordHasher(SPACES), [], 0
        for b in by_bytes(batches):
            held.append(shingle_sets(hasher, b.column("text"))[0] >> np.uint64(64 - bits))
            n += len(held[-1])
            if n > flush:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    return run


def _slice_of(keys: np.ndarray, slices: int, bits: int) -> np.ndarray:
    return (keys * np.uint64(slices) >> np.uint64(bits)).astype(np.int64)


def _base(part: int, slices: int, bits: int) -> np.uint64:
    """The least key of a slice."""
    return np.uint64(-(-(part << bits) // slices))


def _counts_added(folder: str, slices: int, bits: int):
    """Writes the shingles of a slice that several documents have, in order, and how many have them."""

    def run(batch: pa.Table) -> pa.Table:
        keys, counts = [], []
        for first, gaps, n in zip(batch["first"].to_pylist(), batch["gaps"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            keys.append(first + np.append(0, np.cumsum(of_bytes([gaps]))))
            counts.append(of_bytes([n]))
        keys, counts = grouped(np.concatenate(keys).astype(np.uint64), np.concatenate(counts))
        keys, counts = keys[counts > 1], counts[counts > 1]
        part = int(batch["slice"][0].as_py())
        write_arrays(folder, f"shared-{part}", {"key": narrow(keys - _base(part, slices, bits)), "docs": narrow(counts)})
        return pa.table({"slice": pa.array([part], pa.int32()), "n": pa.array([len(keys)], pa.int64())})

    return run


@dataclass
class Order:
    """How many documents have a shingle that several have: arrays in the shared folder, by slice."""

    folder: str
    slices: int
    bits: int
    parts: tuple[str, ...] = ()

    def reader(self) -> Callable[[np.ndarray], np.ndarray]:
        """Numbers of documents of shingles; 0 for those that only one has."""
        arrays = Arrays(self.folder, self.parts)

        def look(values: np.ndarray) -> np.ndarray:
            by_value = np.argsort(values)
            keys = values[by_value] >> np.uint64(64 - self.bits)
            cuts = np.searchsorted(_slice_of(keys, self.slices, self.bits), np.arange(self.slices + 1))
            out = np.zeros(len(values), np.int64)
            for s, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                table, docs = (arrays(f"shared-{s}.{x}") for x in ("key", "docs")) if z > a else ((), ())
                if len(table):
                    mine = (keys[a:z] - _base(s, self.slices, self.bits)).astype(np.uint64)
                    fits = mine <= np.uint64(table[-1])
                    mine = np.where(fits, mine, 0).astype(table.dtype)
                    at = np.searchsorted(table, mine)
                    found = fits & (table[at] == mine)
                    out[by_value[a:z]] = np.where(found, docs[at], 0)
            return out

        return look


def shingle_order(docs: DataFrame, total: int, slice_rows: int = 4_000_000) -> Order:
    """Count the shingles of all documents, of which there are ``total``.

    Shingles are told apart by so many bits that one in 128 or so shares its number with another; a
    number is then too high, which moves a shingle back in the order of all documents alike.
    """
    spark = docs.sparkSession
    slices = max(n_slices(spark), -(-total // slice_rows))
    bits = min(44, max(34, total.bit_length() + 7))
    order = Order(f"{shared_dir(spark)}/shingle-order-{uuid.uuid4().hex}", slices, bits)
    packed = docs.select("text").mapInArrow(_shingle_counts(slices, bits), "slice int, first long, gaps binary, counts binary")
    done = packed.repartition(slices, "slice").groupBy("slice").applyInArrow(_counts_added(order.folder, slices, bits), "slice int, n long").collect()
    order.parts = tuple(f"shared-{r.slice}" for r in done)
    return order


def window(n: np.ndarray) -> np.ndarray:
    """How many of its first shingles a document of n is replicated to."""
    return n - (NEED * n + PARTS - 1) // PARTS + 1


def _windows(shingles: Order, slices: int, wide: int):
    """Packed (shingle, document, size, place) of the windows of documents, by slices of shingles.

    A shingle that no other document has is first in the order and makes no region. Those that more than
    ``wide`` documents have are dealt by document too, to as many slices again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(SPACES)
        n_docs = shingles.reader()
        held: list[tuple[np.ndarray, ...]] = []
        n_held = 0

        def packed() -> pa.RecordBatch:
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            is_wide = rows.pop()
            with np.errstate(over="ignore"):
                dealt = np.where(is_wide, mixed(rows[0] ^ mixed(rows[1].view(np.uint64))), rows[0])
            part = ((dealt >> np.uint64(32)).astype(np.int64) * slices >> 32) + is_wide * slices
            order = np.argsort(part, kind="stable")
            rows = [x[order] for x in rows]
            cuts = np.searchsorted(part[order], np.arange(2 * slices + 1))
            some = [(s, cuts[s], cuts[s + 1]) for s in range(2 * slices) if cuts[s + 1] > cuts[s]]
            return pa.RecordBatch.from_arrays(
                [pa.array([s for s, _, _ in some], pa.int32()), *(pa.array([x[a:z].tobytes() for _, a, z in some], pa.binary()) for x in rows)],
                ["slice", "h", "doc", "size", "place"],
            )

        for b in by_bytes(batches):
            values, at = shingle_sets(hasher, b.column("text"))
            sizes = np.diff(at)
            ids = b.column("node").to_numpy(zero_copy_only=False)
            owners = np.repeat(np.arange(len(sizes)), sizes)
            rank = n_docs(values)
            # by document, then number of documents, then hash, which they are in already
            order = np.argsort(owners * (int(rank.max(initial=0)) + 1) + rank, kind="stable")
            values, rank = values[order], rank[order]
            place = np.arange(len(values)) - at[owners]
            keep = (place < window(sizes)[owners]) & (rank > 0)
            # the place as a share of the size in 255ths, rounded down
            share = place[keep] * 255 // sizes[owners[keep]]
            held.append((values[keep], ids[owners[keep]].astype(np.int64), sizes[owners[keep]].astype(np.int32), share.astype(np.uint8), rank[keep] > wide))
            n_held += int(keep.sum())
            if n_held > 1_000_000:
                yield packed()
                held, n_held = [], 0
        if n_held:
            yield packed()

    return run


def _fits(a: np.ndarray, b: np.ndarray, place_a: np.ndarray, place_b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can link if what stands at these places is the first they share."""
    most = np.minimum(a - place_a * a // 255, b - place_b * b // 255)
    return PARTS * most >= NEED * (a + b - most)


def _can_link(a: Column, b: Column, place_a: Column, place_b: Column) -> Column:
    """The same of columns."""
    most = F.least(a - F.floor(place_a * a / 255), b - F.floor(place_b * b / 255))
    return PARTS * most >= NEED * (a + b - most)


def _regions(slices: int):
    """Of a slice: pivot pairs of each region (h null), and members of regions of three or more, and of all wide
    ones, with the pivot that they met (lead)."""

    def run(batch: pa.Table) -> pa.Table:
        return _slice_regions(batch, batch["slice"][0].as_py() >= slices)

    return run


def _slice_regions(batch: pa.Table, wide: bool) -> pa.Table:
    h, doc, size, place = (np.frombuffer(b"".join(batch[c].to_pylist()), k) for c, k in (("h", np.uint64), ("doc", np.int64), ("size", np.int32), ("place", np.uint8)))
    order = np.argsort(h)
    h, doc, size, place = h[order], doc[order], size[order].astype(np.int64), place[order].astype(np.int64)
    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    lengths = np.diff(np.append(starts, len(h)))
    several = np.repeat(lengths > 1, lengths) | wide
    h, doc, size, place = h[several], doc[several], size[several], place[several]
    lengths = lengths[(lengths > 1) | wide]
    order = np.lexsort((doc, np.repeat(np.arange(len(lengths)), lengths)))
    doc, size, place = doc[order], size[order], place[order]
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    pair = np.flatnonzero((doc != doc[first]) & _fits(size, size[first], place, place[first]))
    a, b = doc[first[pair]], doc[pair]
    if len(a):
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        a, b = a[fresh], b[fresh]
    larger = np.repeat((lengths > 2) | wide, lengths)
    m_h, m_doc, m_size, m_place = h[larger].view(np.int64), doc[larger], size[larger], place[larger]
    none = np.zeros(len(a), np.int64)
    return pa.table({
        "h": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(m_h)]),
        "a": pa.array(np.concatenate([a, m_doc])),
        "b": pa.concat_arrays([pa.array(b), pa.nulls(len(m_doc), pa.int64())]),
        "size": pa.array(np.concatenate([none, m_size])),
        "place": pa.array(np.concatenate([none, m_place])),
        "lead": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(doc[first][larger])]),
    })


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher(SPACES)
    for b in by_bytes(batches):
        values, at = shingle_sets(hasher, b.column("text"))
        blobs = [values[at[i] : at[i + 1]].tobytes() for i in range(len(at) - 1)]
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(blobs, pa.binary())], ["node", "shingles"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of which the sets share need / PARTS of all their shingles at least, with both numbers."""
    for batch in batches:
        shared, total = [], []
        for one, two in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist(), strict=True):
            x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
            if len(x) > len(y):
                x, y = y, x
            shared.append(int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()))
            total.append(len(x) + len(y) - shared[-1])
        shared, total = np.array(shared, np.int64), np.array(total, np.int64)
        at = pa.array(np.flatnonzero(PARTS * shared >= batch.column("need").to_numpy() * total))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a").take(at), batch.column("b").take(at), pa.array(shared).take(at), pa.array(total).take(at)], ["a", "b", "shared", "total"]
        )


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches don't rule out that they share need / PARTS of all their shingles."""
    for batch in batches:
        one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16) for c in ("one", "two"))
        differ = np.abs(one - two).sum(1)
        both = batch.column("n_one").to_numpy() + batch.column("n_two").to_numpy()
        # sets that differ in so many share (both - differ) / 2 at most, of (both + differ) / 2 at least
        at = pa.array(np.flatnonzero(PARTS * (both - differ) >= batch.column("need").to_numpy() * (both + differ)))
        yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("a", "b", "need")], ["a", "b", "need"])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))


def possible(pairs: DataFrame, prints: DataFrame, n_prints: int, name: str) -> DataFrame:
    """The distinct pairs (a, b), with the least need of each, whose sketches, of which there are ``n_prints``, don't rule out that similarity."""
    pairs = pairs.groupBy("a", "b").agg(F.min("need").alias("need"))
    if n_prints <= SENT:
        prints = F.broadcast(prints)
    else:
        pairs = materialized(pairs, f"{name}-candidates")
        n = pairs.count()
        if not n:
            return pairs
        prints = rows_of(prints, _ends(pairs), "node", bound=2 * n)
        if 2 * n <= SENT:
            prints = F.broadcast(prints)
    of = lambda side, x: prints.select(F.col("node").alias(side), F.col("sketch").alias(x), F.col("n_shingles").alias(f"n_{x}"))
    near = pairs.join(of("b", "two"), "b").join(of("a", "one"), "a")
    return materialized(near.select("a", "b", "need", "one", "two", "n_one", "n_two").mapInArrow(_possible, "a long, b long, need int"), f"{name}-possible")


def compared(pairs: DataFrame, prints: DataFrame, n_prints: int, docs: DataFrame, name: str) -> DataFrame:
    """The candidate pairs (a, b) that share need / PARTS, with how many shingles they share and have: by
    sketches first, then by the whole sets of both."""
    pairs = possible(pairs, prints, n_prints, name)
    n = pairs.count()
    if not n:
        return pairs.select("a", "b", F.lit(0).cast("long").alias("shared"), F.lit(0).cast("long").alias("total"))
    sets = rows_of(docs, _ends(pairs), "node", bound=2 * n).select("node", "text").mapInArrow(_sets, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("two")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("shingles").alias("one")), "a"
    )
    return materialized(both.select("a", "b", "need", "one", "two").mapInArrow(_verified, "a long, b long, shared long, total long"), f"{name}-compared")


def links(pairs: DataFrame, prints: DataFrame, n_prints: int, docs: DataFrame, name: str, need: int = NEED) -> DataFrame:
    """The candidate pairs (a, b) that share need / PARTS."""
    return compared(pairs.select("a", "b", F.lit(need).alias("need")), prints, n_prints, docs, name).select("a", "b")


def _pivots(balls: DataFrame, most: int) -> DataFrame:
    """Of each unsettled region, up to ``most`` balls outside its largest component, as columns p, p_size and so on."""
    of_label = balls.groupBy("h", "label").agg(F.sum("n").alias("docs"))
    largest = materialized(of_label.groupBy("h").agg(F.count("*").alias("labels"), F.max(F.struct("docs", "label"))["label"].alias("largest")).where("labels > 1"), "open-regions")
    others = balls.join(few(largest), "h").where("label <> largest")
    place = F.row_number().over(Window.partitionBy("h").orderBy("c"))
    return others.select("h", "c", "size", "place", "n", "label", place.alias("_place")).where(F.col("_place") <= most).drop("_place").toDF("h", "p", "p_size", "p_place", "p_n", "p_label")


def _joined_regions(members: DataFrame, edges: DataFrame, prints: DataFrame, n_prints: int, docs: DataFrame, first_pivots: int = 64) -> DataFrame:
    """Labels (id, component) of all documents that link, by joining members (h, a, size, place, lead) recursively."""
    labels = connected_components(edges, "turn-0")
    near_lead = edges.select(F.col("a").alias("lead"), F.col("b").alias("a"), F.lit(True).alias("linked"))
    members = members.join(near_lead, ["lead", "a"], "left").select("h", "a", "size", "place", F.when(F.col("linked") | (F.col("a") == F.col("lead")), F.col("lead")).otherwise(F.col("a")).alias("c"))
    members = materialized(members, "members")
    balls = members.groupBy("h", "c").agg(F.count("*").alias("n"), F.max(F.when(F.col("a") == F.col("c"), F.struct("size", "place"))).alias("x")).select("h", "c", "x.size", "x.place", "n")
    turn, most = 1, first_pivots
    while True:
        labelled = _labelled(balls, labels, "c", "label").select("h", "c", "size", "place", "n", "label")
        labelled = materialized(labelled, "balls")
        pivots = materialized(_pivots(labelled, most), "pivots")
        if pivots.isEmpty():
            return labels
        open_ = labelled.join(few(pivots.select("h").distinct()), "h", "left_semi")
        met = open_.join(few(pivots), "h").where("label <> p_label")
        fit = _can_link(F.col("size"), F.col("p_size"), F.col("place"), F.col("p_place"))
        # links of balls need centres within 1/4 and both radii: they share 1/2 with one ball of several, 1/4 with two
        alone = (F.col("n") == 1).cast("int") + (F.col("p_n") == 1).cast("int")
        met = met.withColumn("balls", (alone < 2) & (F.least("size", "p_size") * 4 >= F.greatest("size", "p_size") * (1 + alone)))
        need = F.when(F.col("balls"), (1 + alone) * (PARTS // 4)).otherwise(NEED)
        centres = compared(met.where(fit | F.col("balls")).select(F.col("p").alias("a"), F.col("c").alias("b"), need.alias("need")), prints, n_prints, docs, f"turn-{turn}")
        new = centres.where(PARTS * F.col("shared") >= NEED * F.col("total")).select("a", "b")
        if not new.isEmpty():
            edges = edges.unionByName(new)
            labels = connected_components(edges, f"turn-{turn}")
        crossing = _crossing(met.where("balls"), centres, members, labels, prints, n_prints, docs, f"balls-{turn}")
        if crossing is not None and not crossing.isEmpty():
            edges = edges.unionByName(crossing)
            labels = connected_components(edges, f"crossing-{turn}")
        balls = open_.join(pivots.select("h", F.col("p").alias("c")), ["h", "c"], "left_anti").select("h", "c", "size", "place", "n")
        turn, most = turn + 1, most * 16


def _labelled(rows: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """Rows with the component of the document in a column."""
    return rows.join(few(labels.select(F.col("id").alias(column), "component")), column, "left").withColumn(name, F.coalesce("component", column)).drop("component")


def _crossing(met: DataFrame, centres: DataFrame, members: DataFrame, labels: DataFrame, prints: DataFrame, n_prints: int, docs: DataFrame, name: str) -> DataFrame | None:
    """Links between balls that met and whose components differ, if any centres are near enough for one; ``centres``
    holds the pairs of those that are."""
    if centres.isEmpty():
        return None
    columns = ["h", "p", "p_size", "p_place", "p_n", "c", "size", "place", "n"]
    wide = met.join(few(centres.select(F.col("a").alias("p"), F.col("b").alias("c"))), ["p", "c"])
    wide = _labelled(_labelled(wide.select(*columns), labels, "c", "label"), labels, "p", "p_label").where("label <> p_label")
    wide = materialized(wide.select(*columns), f"{name}-met")
    if wide.isEmpty():
        return None

    # one document alone, and the centre of the others
    single = wide.where("n = 1 or p_n = 1")
    one = F.when(F.col("p_n") == 1, F.struct(F.col("p").alias("s"), F.col("p_size").alias("s_size"), F.col("p_place").alias("s_place"), F.col("c").alias("c"))).otherwise(
        F.struct(F.col("c").alias("s"), F.col("size").alias("s_size"), F.col("place").alias("s_place"), F.col("p").alias("c"))
    )
    pairs = [(single.select("h", one.alias("one")).select("h", "one.*"), members)]
    # two crowds: the members of the second that are within 1/2 of the first's centre
    crowds = wide.where("n > 1 and p_n > 1")
    if not crowds.isEmpty():
        between = crowds.select("h", "p", "c").join(members, ["h", "c"]).select("h", "p", F.col("a").alias("c"), F.col("size").alias("s_size"), F.col("place").alias("s_place"))
        close = links(between.select(F.col("p").alias("a"), F.col("c").alias("b")), prints, n_prints, docs, f"{name}-between", PARTS // 2)
        some = between.join(few(close.select(F.col("a").alias("p"), F.col("b").alias("c"))), ["p", "c"]).select("h", F.col("c").alias("s"), "s_size", "s_place", F.col("p").alias("c"))
        pairs.append((some, members))
    fit = _can_link(F.col("size"), F.col("s_size"), F.col("place"), F.col("s_place"))
    out = [few(of).join(inside, ["h", "c"]).where(fit & (F.col("s") != F.col("a"))).select(F.col("s").alias("a"), F.col("a").alias("b")) for of, inside in pairs]
    return links(out[0] if len(out) == 1 else out[0].unionByName(out[1]), prints, n_prints, docs, f"{name}-members")


def jaccard_components(docs: DataFrame, slice_rows: int = 1_000_000, wide: int = 10_000) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text)."""
    docs, renamed = with_nodes(docs.select("doc_id", "text"))
    prints = materialized(docs.mapInArrow(_fingerprints, "doc_id long, node long, n_shingles long, f1 long, f2 long, sketch binary"), "shingle-prints")
    key = ["f1", "f2", "n_shingles"]
    classes = materialized(prints.where("n_shingles > 0").groupBy(*key).agg(F.min("node").alias("rep"), F.count("*").alias("n")), "shingle-classes")
    total = classes.agg(F.sum("n_shingles").alias("shingles")).first()["shingles"] or 0
    copies = materialized(joined_by_group(prints.select("node", *key), classes.where("n > 1"), key, "n").where("node <> rep").select("node").distinct(), "shingle-copies")
    reps = rows_without(docs, copies, "node")
    order = shingle_order(reps, total)
    slices = max(n_slices(docs.sparkSession), total // (4 * slice_rows))
    packed = reps.select("node", "text").mapInArrow(_windows(order, slices, wide), "slice int, h binary, doc binary, size binary, place binary")
    found = packed.repartition(slices, "slice").groupBy("slice").applyInArrow(_regions(slices), "h long, a long, b long, size long, place long, lead long")
    found = materialized(found, "regions")
    if renamed:  # nodes of rows repeated
        prints_of_nodes = materialized(prints.select("node", "n_shingles", "sketch").dropDuplicates(["node"]), "shingle-sketches")
    else:
        prints_of_nodes = prints.select("node", "n_shingles", "sketch")
    n_prints = prints_of_nodes.count()
    edges = links(found.where("h is null"), prints_of_nodes, n_prints, docs, "turn-0")
    labels = _joined_regions(found.where("h is not null").select("h", "a", "size", "place", "lead"), edges, prints_of_nodes, n_prints, docs)
    of_class = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(*key, "n", F.coalesce("component", "rep").alias("component"))
    of_class = materialized(of_class, "class-components")
    out = joined_by_group(prints.where("n_shingles > 0").select("doc_id", "node", *key), of_class, key, "n").select("doc_id", "node", "n_shingles", "component")
    out = out.unionByName(prints.where("n_shingles = 0").select("doc_id", "node", "n_shingles", F.col("node").alias("component")))
    if not renamed:
        return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    # the least doc_id of a component, where nodes that are none take part
    out = materialized(out, "node-components")
    least = out.where(F.col("node") >= FIRST_NODE).groupBy("component").agg(F.min("doc_id").alias("least"))
    named = F.least(F.when(F.col("component") < FIRST_NODE, F.col("component")), "least")
    return out.join(few(least), "component", "left").select("doc_id", "n_shingles", named.alias("component_id"))
