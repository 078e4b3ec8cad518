"""An interpolated modified Kneser-Ney bigram model, counted in Spark and read from mapped arrays.

Tokens are words, then one end, hashed to 64 bits. Counting goes by slices of hashes: each task of the
training texts packs its distinct words and bigrams with their counts, by slice, and the tasks of the
slices add up. A slice of words is a range of word hashes. A slice of bigrams is a range of hashes of
their first word, so that a context's figures are added up in one place; the few words that are first
so often that a slice would overflow are spread by their second word, and their figures added up after.

Each slice is written to the shared folder as sorted arrays: words (hash, count, contexts it follows),
contexts (hash, followers seen once, twice, more often), bigrams (hash, count). Workers map those files
into memory and look up all tokens of a batch at once, in order of hash. Where the shared folder isn't
a path of the machine, a worker first copies the slices it needs to its own temporary folder, and
removes them from there when it ends.

The lower order uses the number of different words before a word, with discounts of its own, and
leaves its rest to a uniform share for each known word and one for all unknown ones.

Defined results: a null or empty text has one token, its end; words not seen in training are known by
nothing but the uniform share; rows repeated are counted and scored as often as they come; a null
doc_id is trained on; without training texts every token has probability 1 in the uniform share and in
the base; an array file that is missing is an error; an empty table gives an empty one; columns that clash with those added are replaced by them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.llm.arrays import Arrays, as_bytes, grouped, narrow, of_bytes, write_arrays
from covenant.llm.shared import SPACES, WordHasher, by_bytes, materialized, mixed, n_slices, shared_dir

BEGIN, END = np.uint64(0x1B873593CC9E2D51), np.uint64(0x2545F4914F6CDD1D)
#: Stands for the words seen once, where those aren't kept apart.
RARE = np.uint64(0x6A09E667F3BCC909)
#: Of a second word's hash, the bytes that tell it from others after the same first word.
LOW48 = np.uint64(0xFFFFFFFFFFFF0000)
ADDED = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


def tokens(hasher: WordHasher, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of each text, an end after each, and where each text's begin (one more)."""
    return with_ends(*hasher.batch(texts))


def with_ends(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and where each text's begin, with an end after each text."""
    n = np.diff(at)
    begin = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(len(h) + len(n), END, np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
    return out, begin


def contexts(tok: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The token before each, or the beginning of its text."""
    before = np.empty_like(tok)
    before[1:] = tok[:-1]
    before[begin[:-1]] = BEGIN
    return before


def _slice(h: np.ndarray, slices: int) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.int64) * slices >> 32


def bigram_slice(first: np.ndarray, second: np.ndarray, spread: np.ndarray, slices: int) -> np.ndarray:
    part = _slice(first, slices)
    if len(spread):
        wide = np.isin(first, spread)
        part[wide] = _slice(mixed(first[wide] ^ second[wide]), slices)
    return part


def bigram_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(first * np.uint64(0x9E3779B97F4A7C15) ^ (second & LOW48))


def _short(h: np.ndarray) -> bytes:
    """The upper 48 bits of hashes."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _long(blobs: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 2:] = raw
    return out.reshape(-1).view(np.uint64)


@dataclass
class Model:
    """Figures of a model and where its arrays are."""

    folder: str
    slices: int
    parts: list[str] = field(default_factory=list)
    n_tokens: int = 0
    n_words: int = 0
    n_texts: int = 0
    spread: list[int] = field(default_factory=list)
    spread_counts: list[list[int]] = field(default_factory=list)
    discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    n_bigrams: int = 0
    low_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    low_rest: float = 1.0


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Of the numbers of n-grams seen once to four times: what to take from counts of 1, 2 and more."""
    if not n[0] or not n[1]:  # too few n-grams to estimate from
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    out = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.0 for k in (1, 2, 3)]
    return tuple(min(max(d, 0.0), float(k)) for k, d in zip((1, 2, 3), out, strict=True))


def _of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _lower_cased() -> WordHasher:
    return WordHasher(SPACES)


def _held(batches: Iterator[pa.RecordBatch], flush_bytes: int, hasher: WordHasher) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens and where texts begin, for batches of texts joined up to a size."""
    toks, begins, n = [], [np.zeros(1, np.int64)], 0
    for b in by_bytes(batches):
        t, begin = tokens(hasher, b.column("text"))
        toks.append(t)
        begins.append(begin[1:] + n)
        n += len(t)
        if n * 8 > flush_bytes:
            yield np.concatenate(toks), np.concatenate(begins)
            toks, begins, n = [], [np.zeros(1, np.int64)], 0
    if n:
        yield np.concatenate(toks), np.concatenate(begins)


def _word_counts(slices: int, flush_bytes: int, hasher: Callable[[], WordHasher]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tok, begin in _held(batches, flush_bytes, hasher()):
            words, counts = grouped(tok)
            cuts = np.searchsorted(_slice(words, slices), np.arange(slices + 1))
            rows = [(s, a, z) for s, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, *_ in rows], pa.int32()), pa.array([words[a:z].tobytes() for _, a, z in rows], pa.binary()), pa.array([as_bytes(narrow(counts[a:z])) for _, a, z in rows], pa.binary()), pa.array([len(begin) - 1 if i == 0 else 0 for i in range(len(rows))], pa.int64())],
                ["slice", "words", "counts", "texts"],
            )

    return run


def _words_added(folder: str, least: int):
    def run(batch: pa.Table) -> pa.Table:
        words, counts = grouped(np.frombuffer(b"".join(batch["words"].to_pylist()), np.uint64), of_bytes(batch["counts"].to_pylist()))
        stay = counts >= least
        write_arrays(folder, f"words-{batch['slice'][0].as_py()}", {"hash": words[stay], "count": narrow(counts[stay])})
        top = np.argsort(-counts, kind="stable")[:64]
        return pa.table({"slice": pa.array([batch["slice"][0].as_py()], pa.int32()), "n": [int(counts.sum())], "v": [len(words)], "stored": [int(stay.sum())], "texts": [sum(batch["texts"].to_pylist())], "top": pa.array([words[top].view(np.int64).tolist()], pa.list_(pa.int64())), "tops": pa.array([counts[top].tolist()], pa.list_(pa.int64()))})

    return run


def _bigram_counts(slices: int, spread: np.ndarray, flush_bytes: int, hasher: Callable[[], WordHasher], common: Model | None, turn: int = 0, turns: int = 1):
    """``common`` is the model so far, if all words that it doesn't have are to be counted as one. Of the slices it's each turn's one of ``turns``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(common) if common else None
        for tok, begin in _held(batches, flush_bytes, hasher()):
            if reader:
                words, back = np.unique(tok, return_inverse=True)
                tok = np.where(reader.counts(words) > 0, words, RARE)[back]
            # words by their place among the distinct ones of these texts: a bigram is one number
            words, _ = grouped(np.append(tok, BEGIN))
            place = np.searchsorted(words, tok).astype(np.uint64)
            before = contexts(place, begin)
            before[begin[:-1]] = np.searchsorted(words, BEGIN)
            pairs, counts = grouped(before << np.uint64(32) | place)
            first, second = words[(pairs >> np.uint64(32)).astype(np.int64)], words[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)]
            part = bigram_slice(first, second, spread, slices)
            if turns > 1:
                mine = part % turns == turn
                first, second, counts, part = first[mine], second[mine], counts[mine], part[mine]
            order = np.argsort(part, kind="stable")
            first, second, counts = first[order], second[order], counts[order]
            cuts = np.searchsorted(part[order], np.arange(slices + 1))
            out: dict[str, list] = {"slice": [], "first": [], "runs": [], "second": [], "counts": []}
            for s, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if z > a:
                    starts = np.flatnonzero(np.append(True, first[a + 1 : z] != first[a : z - 1]))
                    out["slice"].append(s)
                    out["first"].append(first[a:z][starts].tobytes())
                    out["runs"].append(as_bytes(narrow(np.diff(np.append(starts, z - a)))))
                    out["second"].append(_short(second[a:z]))
                    out["counts"].append(as_bytes(narrow(counts[a:z])))
            yield pa.RecordBatch.from_arrays([pa.array(out["slice"], pa.int32()), *(pa.array(out[c], pa.binary()) for c in ("first", "runs", "second", "counts"))], list(out))

    return run


_BIGRAM_FIGURES = "kind int, slice int, words binary, counts binary, figures array<long>"


def _bigrams_added(folder: str, slices: int, spread: np.ndarray, least: int):
    """Writes a slice's bigrams and contexts; gives its counts of counts, and contexts of second words."""

    def run(batch: pa.Table) -> pa.Table:
        first = np.repeat(np.frombuffer(b"".join(batch["first"].to_pylist()), np.uint64), of_bytes(batch["runs"].to_pylist()))
        second, counts = _long(batch["second"].to_pylist()), of_bytes(batch["counts"].to_pylist())
        order = np.lexsort((second, first))
        first, second, counts = first[order], second[order], counts[order]
        starts = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        first, second, counts = first[starts], second[starts], np.add.reduceat(counts, starts)
        part = int(batch["slice"][0].as_py())
        # a bigram with a rare word comes once, so those of one word and the rare ones are as many as were counted
        after_rare, rare = first == RARE, second == RARE & LOW48
        single = after_rare | rare
        n_single, context_of_rare, n_of_rare = int(counts[single].sum()), first[rare & ~after_rare], counts[rare & ~after_rare]
        followed, n_followed = second[~rare], np.where(after_rare, counts, 1)[~rare]
        first, second, counts = first[~single], second[~single], counts[~single]
        keys = bigram_key(first, second)
        by_key = np.argsort(keys)
        words, at = np.unique(np.concatenate([first, context_of_rare]), return_inverse=True)
        of = lambda hit: np.bincount(at[: len(first)][hit], minlength=len(words))
        by = [of(counts == 1) + np.bincount(at[len(first) :], n_of_rare, len(words)).astype(np.int64), of(counts == 2), of(counts > 2)]
        own = ~np.isin(words, spread)
        by_key = by_key[counts[by_key] >= least]
        # a context that every bigram left out follows gives all to the lower order, as one that isn't there
        kept = own & (by[1] + by[2] > 0) if least > 1 else own
        write_arrays(
            folder, f"bigrams-{part}",
            {"key": keys[by_key], "count": narrow(counts[by_key]), "context": words[kept], **{f"n{k + 1}": narrow(by[k][kept]) for k in range(3)}},
        )
        n1, *more = _of_counts(counts)
        rows: list[tuple] = [(0, part, None, None, [part, n1 + n_single, *more, len(counts) + n_single])]
        rows += [(1, part, None, None, [int(h), *(int(x[i]) for x in by)]) for i, h in zip(np.flatnonzero(~own), words[~own].view(np.int64), strict=True)]
        seconds, n = grouped(followed, n_followed)
        cuts = np.searchsorted(_slice(seconds, slices), np.arange(slices + 1))
        rows += [(2, s, _short(seconds[a:z]), as_bytes(narrow(n[a:z])), None) for s, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "slice", "words", "counts", "figures"])

    return run


def _followers_added(folder: str, least: int):
    """Writes, for the words of a slice, how many different words each follows; passes figures on."""

    def run(batch: pa.Table) -> pa.Table:
        kinds = batch["kind"].to_numpy()
        figures = [[int(k), *f] for k, f in zip(kinds, batch["figures"].to_pylist(), strict=True) if k < 2]
        pick = np.flatnonzero(kinds == 2)
        if len(pick):
            part = batch["slice"][int(pick[0])].as_py()
            rows = batch.take(pa.array(pick))
            short, n = grouped(_long(rows["words"].to_pylist()), of_bytes(rows["counts"].to_pylist()))
            stay = n >= least
            write_arrays(folder, f"follows-{part}", {"short": short[stay], "n": narrow(n[stay])})
            figures.append([2, part, *_of_counts(n), int((n > 2).sum()), int(n.sum())])
        return pa.table({"figures": pa.array(figures, pa.list_(pa.int64()))})

    return run


def train(
    texts: DataFrame,
    folder: str | None = None,
    slices: int | None = None,
    flush_bytes: int = 48 << 20,
    slice_bytes: int = 32 << 20,
    hasher: Callable[[], WordHasher] = _lower_cased,
    singles: bool = True,
    turns: int = 1,
) -> Model:
    """Count texts (text) and write the model's arrays to a folder that all workers share.

    There are so many slices that each has about ``slice_bytes`` of the texts, and a task for each.
    Without ``singles``, what is seen once is discounted whole, so it isn't stored; it still counts
    among the distinct words, contexts and totals. Bigrams with a word seen once come once themselves,
    so they are counted by their other word and not kept apart. Bigrams are counted in so many ``turns``, each
    over all texts and for its share of the slices, so that no more than that share is shuffled at once.
    """
    least = 1 if singles else 2
    spark = texts.sparkSession
    folder = folder or f"{shared_dir(spark)}/language-model-{uuid.uuid4().hex}"
    texts = texts.select("text")
    slices = slices or max(n_slices(spark), (texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // slice_bytes)
    model = Model(folder, slices)
    packed = texts.mapInArrow(_word_counts(slices, flush_bytes, hasher), "slice int, words binary, counts binary, texts long")
    rows = packed.repartition(slices, "slice").groupBy("slice").applyInArrow(_words_added(folder, least), "slice int, n long, v long, stored long, texts long, top array<long>, tops array<long>").collect()
    model.parts = [f"words-{r.slice}" for r in rows]
    model.n_tokens, model.n_words, model.n_texts = (sum(r[c] for r in rows) for c in ("n", "v", "texts"))
    often = [w for r in rows for w, n in zip(r.top, r.tops, strict=True) if n * 4 * slices > model.n_tokens]
    spread = np.array(sorted({*(w & 0xFFFFFFFFFFFFFFFF for w in often), int(BEGIN), *([] if singles else [int(RARE)])}), np.uint64)
    model.spread = spread.tolist()
    common = None if singles else replace(model)
    counted = None
    for turn in range(turns):
        packed = texts.mapInArrow(_bigram_counts(slices, spread, flush_bytes, hasher, common, turn, turns), "slice int, first binary, runs binary, second binary, counts binary")
        rows_added = packed.repartition(slices, "slice").groupBy("slice").applyInArrow(_bigrams_added(folder, slices, spread, least), _BIGRAM_FIGURES)
        added = rows_added if turns == 1 else materialized(rows_added, "bigram-figures")
        counted = added if counted is None else counted.unionByName(added)
    figures = [r.figures for r in counted.repartition(slices, "slice").groupBy("slice").applyInArrow(_followers_added(folder, least), "figures array<long>").collect()]
    model.parts += [f"bigrams-{f[1]}" for f in figures if f[0] == 0] + [f"follows-{f[1]}" for f in figures if f[0] == 2]
    seen = np.sum([f[2:] for f in figures if f[0] == 0] or [[0] * 5], axis=0).tolist()
    whole = lambda d: d if singles else (1.0, *d[1:])
    model.discounts, model.n_bigrams = whole(_discounts(seen)), seen[4]
    wide: dict[int, list[int]] = {h: [0, 0, 0] for h in model.spread}
    for f in figures:
        if f[0] == 1:
            wide[f[1] & 0xFFFFFFFFFFFFFFFF] = [x + y for x, y in zip(wide[f[1] & 0xFFFFFFFFFFFFFFFF], f[2:], strict=True)]
    model.spread_counts = [wide[h] for h in model.spread]
    low = np.sum([f[2:] for f in figures if f[0] == 2] or [[0] * 6], axis=0).tolist()
    if not singles:  # a rare word follows one word
        low[0], low[5] = low[0] + model.n_words - sum(r.stored for r in rows), low[5] + model.n_words - sum(r.stored for r in rows)
    model.low_discounts = whole(_discounts(low))
    taken = model.low_discounts[0] * low[0] + model.low_discounts[1] * low[1] + model.low_discounts[2] * low[4]
    model.low_rest = taken / low[5] if low[5] else 1.0
    return model


class Reader:
    """Looks tokens up in a model's arrays."""

    def __init__(self, model: Model) -> None:
        self.m, self.arrays = model, Arrays(model.folder, model.parts)
        self.spread = np.array(model.spread, np.uint64)
        self.d = np.array([0.0, *model.discounts])
        self.low_d = np.array([0.0, *model.low_discounts])

    def _find(self, keys: np.ndarray, queries: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        if not len(keys):
            return [np.zeros(len(queries), np.int64) for _ in values]
        at = np.minimum(np.searchsorted(keys, queries), len(keys) - 1)
        here = keys[at] == queries
        return [np.where(here, v[at], 0).astype(np.int64) for v in values]

    def counts(self, words: np.ndarray) -> np.ndarray:
        """Of distinct words in order: how often each was seen."""
        out = np.zeros(len(words), np.int64)
        cuts = np.searchsorted(_slice(words, self.m.slices), np.arange(self.m.slices + 1))
        for s, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if z > a:
                (out[a:z],) = self._find(self.arrays(f"words-{s}.hash"), words[a:z], self.arrays(f"words-{s}.count"))
        return out

    def words(self, words: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of distinct words in order: their count, how many words they follow, and as contexts: 1, 2, more."""
        out = np.zeros((5, len(words)), np.int64)
        cuts = np.searchsorted(_slice(words, self.m.slices), np.arange(self.m.slices + 1))
        for s, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if z > a:
                q, get = words[a:z], self.arrays
                (out[0, a:z],) = self._find(get(f"words-{s}.hash"), q, get(f"words-{s}.count"))
                (out[1, a:z],) = self._find(get(f"follows-{s}.short"), q & LOW48, get(f"follows-{s}.n"))
                out[2:, a:z] = self._find(get(f"bigrams-{s}.context"), q, *(get(f"bigrams-{s}.n{k}") for k in (1, 2, 3)))
        wide = np.searchsorted(words, self.spread)
        for i, h, n in zip(wide, self.spread, self.m.spread_counts, strict=True):
            if i < len(words) and words[i] == h:
                out[2:, i] = n
        # only the end of a text is a context of nothing; its beginning is one of the first tokens
        out[0, words == BEGIN] = self.m.n_texts
        return tuple(out)

    def bigrams(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Counts of distinct bigrams."""
        part = bigram_slice(first, second, self.spread, self.m.slices)
        keys = bigram_key(first, second)
        order = np.lexsort((keys, part))
        cuts = np.searchsorted(part[order], np.arange(self.m.slices + 1))
        out = np.zeros(len(first), np.int64)
        for s, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if z > a:
                at = order[a:z]
                (out[at],) = self._find(self.arrays(f"bigrams-{s}.key"), keys[at], self.arrays(f"bigrams-{s}.count"))
        return out

    def score(self, tok: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
        """For each text: tokens, known tokens, the base's log10 probability and the model's."""
        m = self.m
        words, _ = grouped(np.append(tok, BEGIN))
        place = np.searchsorted(words, tok)
        before = contexts(place.astype(np.uint64), begin)
        before[begin[:-1]] = np.searchsorted(words, BEGIN)
        count, follows, n1, n2, n3 = self.words(words)
        low = np.maximum(follows - self.low_d[np.minimum(follows, 3)], 0) / max(1, m.n_bigrams) + m.low_rest / (m.n_words + 1)
        as_context = np.maximum(count, 1)
        rest = np.where(n1 + n2 + n3 > 0, (self.d[1] * n1 + self.d[2] * n2 + self.d[3] * n3) / as_context, 1.0)
        pairs, back = np.unique(before << np.uint64(32) | place.astype(np.uint64), return_inverse=True)
        first, second = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        c = self.bigrams(words[first], words[second])
        p = np.maximum(c - self.d[np.minimum(c, 3)], 0) / as_context[first] + rest[first] * low[second]
        base = np.log10((count + 0.1) / (m.n_tokens + 0.1 * (m.n_words + 1)))
        known = (count > 0).astype(np.int64)
        known[words == BEGIN] = 0
        at = begin[:-1]
        if not len(at):
            return [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)]
        return [np.diff(begin), np.add.reduceat(known[place], at), np.add.reduceat(base[place], at), np.add.reduceat(np.log10(p)[back], at)]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score added."""
    docs = docs.drop(*ADDED)
    kinds = [T.LongType()] * 3 + [T.DoubleType()] * 2
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, k) for c, k in zip(ADDED, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, reader = WordHasher(SPACES), Reader(model)
        for b in by_bytes(batches):
            tok, begin = tokens(hasher, b.column("text"))
            n, known, base, logs = reader.score(tok, begin)
            train_tokens = np.full(len(n), model.n_tokens, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x) for x in (n.astype(np.int64), known.astype(np.int64), train_tokens, base, logs))], [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def perplexity(score: Column, n_tokens: Column) -> Column:
    """Of a text, from its log10 probability."""
    return F.pow(F.lit(10.0), -score / n_tokens)
