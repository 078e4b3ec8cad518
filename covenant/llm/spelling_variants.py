"""Spelling variants: words of a corpus that differ by one letter, each led to the frequent form it stands for.

Two words are near if one letter more, less or other makes one of them the other. Each word of the vocabulary
is turned into its whole neighbourhood: all distinct deletions, replacements and insertions over the letters
that the vocabulary has. A neighbourhood joins the vocabulary by equality, so what meets is near, and no
distance is ever computed. A word of L letters over k has at most L + L (k - 1) + (L + 1) k - L candidates,
whatever the corpus, so no key and no group grows with it: a word can't have more near words than that.
Candidates are first held against a Bloom filter of the vocabulary, of bounded size, so that few of those that
aren't words are shuffled; what it lets through wrongly finds no partner in the join.

Words are counted in the tasks that read the texts and added up by word. A vocabulary counted to be small is
sent to the candidates; a larger one meets them in a shuffle by candidate. A form is at least ``ratio`` times as
frequent as its word, so chains of forms end after log(most frequent) steps, and their ends are found in the
logarithm of that many rounds by replacing each word's form by that form's own.

Defined results: a null or empty text has no word; a null doc_id counts as an empty text in the checksum; rows
repeated are counted as often as they come; ties between forms go to the smallest in code-point order; an
empty table, or one without a word frequent enough, gives no row; other columns, of whatever name, are not
read. Only A-Z are lower-cased: É and é are two letters.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.llm.shared import by_bytes, few, materialized, mixed

LETTERS = "A-Za-zÀ-ÿ"
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: A text of more characters is walked through instead of held as a list of words.
LONG_TEXT = 1 << 20
#: Distinct words that a task holds before it hands their counts on.
HELD_WORDS = 200_000
#: A vocabulary of up to so many words is sent to the candidates.
MOST_SENT = 500_000
#: Flags of the filter, 32 for each word and no more than these (32 MB).
MOST_BITS = 1 << 28
#: Hashes of candidates worked out at once.
HELD_HASHES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _slipped(doc_id: int | None, word: str, every: int) -> str:
    """The word, or in one of so many cases the word without the letter that a checksum names."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, least_letters: int = 6, slip_every: int | None = None) -> DataFrame:
    """Words of docs (doc_id, text) of so many letters at least: word, n. Partly added up: a word has a row for each task.

    ``slip_every`` plants errors to be found again: in one of so many pairs of document and word, a letter is lost.
    """
    run = re.compile(f"[{LETTERS}]{{{least_letters},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def handed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in by_bytes(batches):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                text = text.as_py() or ""
                found = run.findall(text) if len(text) < LONG_TEXT else (m.group() for m in run.finditer(text))
                of_text: Counter = Counter()
                for word, n in Counter(found).items():
                    of_text[word.translate(_LOWER)] += n
                for word, n in of_text.items():
                    if slip_every:
                        word = _slipped(doc_id, word, slip_every)
                        if len(word) < least_letters:
                            continue
                    held[word] += n
                if len(held) > HELD_WORDS:
                    yield handed_on()
        yield handed_on()

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long")


def vocabulary(docs: DataFrame, least_letters: int = 6, least_n: int = 5, slip_every: int | None = None) -> DataFrame:
    """Words frequent enough in docs: word, n."""
    return word_counts(docs, least_letters, slip_every).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def alphabet(words: DataFrame) -> list[str]:
    """The letters of words; no more than the class of letters has."""
    rows = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect()
    return sorted(r.c for r in rows if r.c)


class Neighbourhood:
    """All distinct words that one letter less, other or more makes of words, told by 64-bit hashes.

    A word's hash is a polynomial in numbers drawn for its letters, so that of a changed word follows from sums
    up to the changed place and from there on: numpy works out a whole neighbourhood without making its words.
    """

    def __init__(self, letters: list[str]) -> None:
        self.codes = np.frombuffer("".join(letters).encode("latin-1"), np.uint8)
        self.number = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.power = np.cumprod(np.full(256, _BASE, np.uint64), dtype=np.uint64)

    def _powers(self, n: int) -> np.ndarray:
        while len(self.power) < n:
            self.power = np.concatenate([self.power, self.power * self.power[-1]])
        return self.power[:n]

    def _sums(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of letters: sums before each place, and sums from each place on."""
        each = self.number[letters] * self._powers(letters.shape[1])
        before = np.zeros((len(letters), letters.shape[1] + 1), np.uint64)
        np.cumsum(each, axis=1, out=before[:, 1:])
        return before, before[:, -1:] - before

    def hashes(self, letters: np.ndarray) -> np.ndarray:
        """Of rows of words of one length."""
        return mixed(self._sums(letters)[0][:, -1] + np.uint64(letters.shape[1]))

    def of(self, letters: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of rows of words of one length, for each kind of change (letters more): hashes, whether it counts, letters put in.

        Of a run of one letter the first to go stands for all, and a letter goes in only before another one or
        at the end, so no two changes give one word, and none the word itself.
        """
        m, n = letters.shape
        before, rest = self._sums(letters)
        here = np.concatenate([letters, np.zeros((m, 1), np.uint8)], axis=1)  # no letter is 0
        unlike = np.ones((m, n), bool)
        unlike[:, 1:] = letters[:, 1:] != letters[:, :-1]
        put = self.number[self.codes][None, None, :] * self._powers(n + 1)[None, :, None]
        others = here[:, :, None] != self.codes[None, None, :]
        yield -1, mixed(before[:, :-1] + rest[:, 1:] * np.uint64(_INVERSE) + np.uint64(n - 1))[:, :, None], unlike[:, :, None], np.zeros(1, np.uint8)
        yield 0, mixed((before[:, :-1] + rest[:, 1:])[:, :, None] + put[:, :-1] + np.uint64(n)), others[:, :-1], self.codes
        yield 1, mixed((before + rest * np.uint64(_BASE))[:, :, None] + put + np.uint64(n + 1)), others, self.codes

    def words(self, words: list[str], passes: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, str]]:
        """(place of a word, changed word) of those whose hash passes."""
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for n, places in by_length.items():
            step = max(1, HELD_HASHES // max(1, (2 * n + 1) * len(self.codes)))
            for low in range(0, len(places) if n else 0, step):
                at = places[low : low + step]
                for more, h, counts, put in self.of(np.frombuffer("".join(words[i] for i in at).encode("latin-1"), np.uint8).reshape(len(at), n)):
                    for row, i, c in zip(*(x.tolist() for x in np.nonzero(counts & passes(h))), strict=True):
                        w = words[at[row]]
                        yield at[row], w[:i] + (chr(put[c]) if more >= 0 else "") + w[i + (more < 1) :]


def _bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return (h & mask).astype(np.int64), (h >> np.uint64(32) & mask).astype(np.int64)


def vocabulary_bits(words: DataFrame, n: int, letters: list[str]) -> np.ndarray:
    """A Bloom filter of n words, as flags: at most MOST_BITS of them, whatever the vocabulary."""
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(16, (32 * n).bit_length()))
    chunk = min(bits, 1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, flags = Neighbourhood(letters), np.zeros(bits, bool)
        for b in batches:
            by_length: dict[int, list[str]] = {}
            for w in b.column("word").to_pylist():
                by_length.setdefault(len(w), []).append(w)
            for k, ws in by_length.items():
                h = near.hashes(np.frombuffer("".join(ws).encode("latin-1"), np.uint8).reshape(len(ws), k))
                for at in _bits(h, bits):
                    flags[at] = True
        rows = [(i, np.packbits(flags[i * chunk : (i + 1) * chunk]).tobytes()) for i in range(bits // chunk)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["chunk", "flags"])

    def joined(batch: pa.Table) -> pa.Table:
        flags = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in batch["flags"].to_pylist()])
        return pa.table({"chunk": batch["chunk"][:1], "flags": pa.array([flags.tobytes()], pa.binary())})

    found = words.select("word").mapInArrow(run, "chunk int, flags binary").groupBy("chunk").applyInArrow(joined, "chunk int, flags binary").collect()
    flags = np.zeros(bits // 8, np.uint8)
    for r in found:
        flags[r.chunk * chunk // 8 : (r.chunk + 1) * chunk // 8] = np.frombuffer(r.flags, np.uint8)
    return flags


def near_words(words: DataFrame) -> DataFrame:
    """Of a written vocabulary (word, n): word, n, near, near_n for each two near words, in both orders."""
    letters = alphabet(words)
    flags = words.sparkSession.sparkContext.broadcast(vocabulary_bits(words, words.count(), letters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around, held = Neighbourhood(letters), flags.value
        bits = len(held) * 8

        def passes(h: np.ndarray) -> np.ndarray:
            a, b = _bits(h, bits)
            return (held[a >> 3] >> (7 - (a & 7)).astype(np.uint8) & held[b >> 3] >> (7 - (b & 7)).astype(np.uint8) & 1).astype(bool)

        for b in batches:
            found = list(around.words(b.column("word").to_pylist(), passes))
            rows = b.take(pa.array([i for i, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([w for _, w in found], pa.string())], ["word", "n", "near"])

    candidates = words.select("word", "n").mapInArrow(run, "word string, n long, near string")
    return candidates.join(few(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), MOST_SENT), "near").select("word", "n", "near", "near_n")


def forms(words: DataFrame, ratio: int = 5) -> DataFrame:
    """Of a written vocabulary: word, n, n_near, and form and form_n, if a near word is so many times as frequent."""
    alone = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))))
    found = alone.unionByName(near_words(words)).groupBy("word", "n").agg(F.count("near").alias("n_near"), best.alias("best"))
    formed = -F.col("best.less") >= ratio * F.col("n")
    return found.select("word", "n", "n_near", F.when(formed, F.col("best.form")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"))


def roots(formed: DataFrame, ratio: int = 5) -> DataFrame:
    """Written forms with ``root``, the last form that follows from each word, or the word itself."""
    links = formed.where("form is not null")
    bound = links.agg(F.min("n").alias("least"), F.max("form_n").alias("most")).first()
    longest = 0 if bound.least is None else int(math.log(bound.most / max(1, bound.least), ratio) + 1e-9)
    steps = links.select("word", F.col("form").alias("root"))
    for k in range(max(0, (longest - 1).bit_length())):
        further = few(steps.select(F.col("word").alias("root"), F.col("root").alias("next")), MOST_SENT)
        steps = materialized(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"roots-{k}")
    return formed.join(few(steps, MOST_SENT), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, least_letters: int = 6, least_n: int = 5, ratio: int = 5, slip_every: int | None = None) -> DataFrame:
    """The vocabulary of docs (doc_id, text): word, form, root, n, n_near, form_n."""
    words = materialized(vocabulary(docs, least_letters, least_n, slip_every), "vocabulary")
    formed = materialized(forms(words, ratio), "forms")
    return roots(formed, ratio).select("word", "form", "root", "n", "n_near", "form_n")
