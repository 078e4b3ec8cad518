"""Toxicity by a lexicon trie met with Levenshtein automata, and scores of the words around each hit.

The lexicon is learned from labelled documents: words, and beginnings of words, that stand in far more
contexts of toxic documents than of others. A context is a word's two neighbours, so that copies of
one document don't count as many. Entries form a trie. A Levenshtein automaton of distance 1, two letters
that have changed places being one error too, is run against it: its states are sets of (trie node,
errors so far, letter that has to follow), made when first met and kept, so a word costs one look-up a
letter and most words end after a few letters.

Digits and marks inside a word belong to it, and the error may be at any letter. Entries are all words
and beginnings of a likelihood ratio of ``NEED`` in ``LEAST`` contexts at least; words of any length are
learned, and what clean documents quote or report now and then stays in. Their number is bounded by
the sample's words.

Each hit has a kind (whole word, misspelled, beginning of a word) and a context: whether the words
around it quote or report (quotation marks, verbs of saying), address someone, or hold other hits. A
document's score is a logistic regression on sums of these over its whole text, and on the share of
words of under five letters that are an entry but for an error, whose context isn't looked at.

Learning uses at most about ``per_label`` labelled documents of each label, chosen by a hash of
doc_id, and the documents left out of learning play no part in it. A label's sampled documents stand
for all of that label by weight, so that a score is a chance among the labelled documents as they are,
however large the table.

Defined results: null and empty texts have no hits and get the score of such texts; a label that is
null, or a document with both labels, teaches nothing; rows repeated give the same result each;
without labels of both kinds every score is 0; an empty table gives an empty one; columns that clash
with those added are replaced by them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.llm.shared import by_bytes, materialized, rows_of

THRESHOLD = 0.3
#: Letters with the digits and marks that stand for some of them, as in id1ot, st*pid and $cum; its parts; what they may stand for.
WORD = regex.compile(r"[\p{N}@$]*[\p{L}\p{M}]+(?:[\p{N}*@$!#|+]+[\p{L}\p{M}]+)*[\p{N}*@$]*")
PART = regex.compile(r"[\p{L}\p{M}]+")
MEANT = str.maketrans("013457@$!|", "oieastasil")
#: Around a hit so many words, and characters of punctuation with them, are its context.
AROUND = 6
STEMS = (4, 5, 6, 7)
#: Words of saying and of quotation, in the languages of the documents.
SAYING = frozenset(
    "said says say told asked wrote writes quote quoted quotes called reported according term word slur insult phrase example "
    "dit écrit citation mot insulte sagte schrieb zitat wort nannte dijo escribió cita palabra llamó".split()
)
ADDRESS = frozenset("you your youre u du dich dir ihr sie tu te toi vous tú ti usted eres".split())
QUOTES = "\"“”«»„‘"
FEATURES = 11
#: Log-likelihood ratio that an entry of the lexicon needs, and how many times as likely a context of it has to
#: be in a toxic document as in another. Some quotations in others are left to the features of context.
NEED, TIMES, LEAST = 12.0, 8.0, 4
#: In words of fewer letters an error leaves little, so such hits are a kind of their own.
LONG = 5
#: States of the automaton kept.
MOST_STATES = 1 << 15
#: Bytes of text, and words with what they match, that a worker holds at once.
PART_BYTES, MOST_KNOWN = 1 << 20, 1 << 17


class Lexicon:
    """A trie of entries, met with the Levenshtein automaton of distance 1 as a deterministic one."""

    def __init__(self, words: list[str], stems: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]  # 1: a word, 2: a stem
        for entries, mark in ((words, 1), (stems, 2)):
            for entry in entries:
                node = 0
                for c in entry:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        self.ends.append(0)
                    node = self.next[node][c]
                self.ends[node] |= mark
        self.longest = max(map(len, words), default=0)
        self.clear()

    def clear(self) -> None:
        self.states: dict[frozenset[tuple[int, int, str]], int] = {}
        self.members: list[frozenset[tuple[int, int, str]]] = []
        self.step: list[dict[str, int]] = []
        self.kind: list[int] = []
        self.stem: list[bool] = []
        self.start = self._state({(0, 0, "")})

    def _state(self, members: set[tuple[int, int, str]]) -> int:
        # a letter of the entry may be missing from the word
        for node, errors, _ in list(members):
            if not errors:
                members |= {(child, 1, "") for child in self.next[node].values()}
        least: dict[tuple[int, str], int] = {}
        for node, errors, then in members:
            least[node, then] = min(errors, least.get((node, then), 2))
        key = frozenset((node, errors, then) for (node, then), errors in least.items())
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.step.append({})
            ends = [(e, self.ends[n]) for n, e, then in key if not then]
            self.kind.append(1 if any(e == 0 and mark & 1 for e, mark in ends) else 2 if any(mark & 1 for _, mark in ends) else 0)
            self.stem.append(any(e == 0 and mark & 2 for e, mark in ends))
        return self.states[key]

    def _to(self, state: int, c: str) -> int:
        reached: set[tuple[int, int, str]] = set()
        for node, errors, then in self.members[state]:
            if then:
                if c == then:
                    reached.add((node, 1, ""))
                continue
            children = self.next[node]
            if c in children:
                reached.add((children[c], errors, ""))
            if not errors:
                reached.add((node, 1, ""))
                for x, child in children.items():
                    reached.add((child, 1, ""))
                    if x != c and c in self.next[child]:
                        reached.add((self.next[child][c], 1, x))
        to = self._state(reached) if reached else -1
        self.step[state][c] = to
        return to

    def match(self, word: str) -> int:
        """0: no entry; 1: an entry; 2: an entry with one error; 3: begins with a stem; 4: one error in a short word."""
        if len(self.members) > MOST_STATES:
            self.clear()
        if PART.fullmatch(word):
            return self._match(word)
        # what digits and marks hide is one error or a letter each; else each part is a word
        whole = {self._match(word), self._match(word.translate(MEANT))}
        parts = {self._match(p) for p in PART.findall(word)}
        if 1 in parts:
            return 1
        if whole & {1, 2, 4}:
            return 2
        return min((parts | whole) - {0}, default=0)

    def _match(self, word: str) -> int:
        state, stem = self.start, False
        for c in word:
            to = self.step[state].get(c)
            state = self._to(state, c) if to is None else to
            if state < 0:
                return 3 if stem else 0
            stem = stem or self.stem[state]
        kind = self.kind[state]
        if kind == 2 and len(word) < LONG:
            kind = 4
        return kind or (3 if stem else 0)


@dataclass
class Model:
    words: list[str]
    stems: list[str]
    weights: list[float]

    def scorer(self) -> Scorer:
        return Scorer(Lexicon(self.words, self.stems), np.array(self.weights))


class Scorer:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray) -> None:
        self.lexicon, self.weights = lexicon, weights
        self.known: dict[str, int] = {}

    def hits(self, text: str) -> tuple[list[tuple[int, int, int, int]], list[str], int]:
        """(word number, kind, from, to) of each hit, the words, and the number of short words with an error."""
        lower = text.lower()
        if len(lower) != len(text):
            text = lower
        words = WORD.findall(lower)
        known, match = self.known, self.lexicon.match
        if len(known) > MOST_KNOWN:
            known.clear()
        found, short = [], 0
        for i, w in enumerate(words):
            kind = known.get(w)
            if kind is None:
                kind = known[w] = match(w)
            if kind == 4:
                short += 1
            elif kind:
                found.append((i, kind))
        if not found:
            return [], words, short
        wanted, out, k = dict(found), [], 0
        for i, m in enumerate(WORD.finditer(lower)):
            if i in wanted:
                out.append((i, wanted[i], m.start(), m.end()))
                k += 1
                if k == len(found):
                    break
        return out, words, short

    def features(self, text: str | None) -> list[float]:
        """Sums over the hits of a text, by kind and context."""
        x = [0.0] * FEATURES
        if not text:
            return x
        hits, words, short = self.hits(text)
        x[10] = math.log1p(100 * short / max(1, len(words)))
        if not hits:
            return x
        at = {i for i, *_ in hits}
        for i, kind, start, end in hits:
            near = words[max(0, i - AROUND) : i] + words[i + 1 : i + 1 + AROUND]
            before, after = text[max(0, start - 40) : start], text[end : end + 40]
            quoted = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
            x[kind - 1] += 1
            x[3] += quoted
            x[4] += any(w in SAYING for w in near)
            x[5] += any(w in ADDRESS for w in near)
            x[6] += any(j in at for j in range(i - AROUND, i + AROUND + 1) if j != i)
        for k in range(7):
            x[k] = math.log1p(x[k])
        x[7] = float(any(kind == 1 for _, kind, *_ in hits))
        x[8] = float(any(kind == 3 for _, kind, *_ in hits))
        x[9] = math.log1p(100 * len(hits) / len(words))
        return x

    def score(self, features: list[float]) -> float:
        z = float(np.dot(self.weights[:-1], features) + self.weights[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, stem, toxic, context) of each word and beginning of a word, once for each part of a batch."""
    for b in by_bytes(batches, most=PART_BYTES):
        seen: set[tuple[str, bool, int, int]] = set()
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            words = ["", *WORD.findall((text or "").lower()), ""]
            for i in range(1, len(words) - 1):
                w = words[i]
                context = hash_context(words[i - 1], words[i + 1])
                for part in (w,) if PART.fullmatch(w) else (w, *PART.findall(w)):
                    seen.add((part, False, toxic, context))
                    seen.update((part[:n], True, toxic, context) for n in STEMS if n < len(part))
        columns = list(zip(*seen, strict=True)) if seen else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.bool_(), pa.int32(), pa.int64()), strict=True)], ["unit", "stem", "toxic", "context"])


def hash_context(left: str, right: str) -> int:
    """A number for two neighbours, the same in every process."""
    return xxhash.xxh3_64_intdigest(f"{left} {right}") >> 1


def labelled(docs: DataFrame, labels: DataFrame, per_label: int) -> DataFrame:
    """(doc_id, text, toxic, weight) of about ``per_label`` documents of each label at most; weight is
    how many documents of its label each stands for."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    learnable = docs.where("text is not null").select("doc_id").join(known, "doc_id").distinct()
    learnable = materialized(learnable, "toxicity-labels")
    counts = {r.toxic: r["count"] for r in learnable.groupBy("toxic").count().where("toxic in (0, 1)").collect()}
    chance = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.when(F.col("toxic") == 1, min(1.0, per_label / max(1, counts.get(1, 0)))).otherwise(min(1.0, per_label / max(1, counts.get(0, 0))))
    chosen = materialized(learnable.where("toxic in (0, 1)").where(chance < rate), "toxicity-chosen")
    return rows_of(docs.select("doc_id", "text"), chosen).join(chosen.withColumn("weight", 1 / rate), "doc_id")


def learn(docs: DataFrame, labels: DataFrame, per_label: int = 2000) -> Model | None:
    """A model from docs with text and labels with toxic; docs hold only what may be learned from."""
    sample = materialized(labelled(docs, labels, per_label).repartition(24), "toxicity-sample")
    sums = sample.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("weight").alias("all")).collect()
    totals = {r.toxic: r.n for r in sums}
    if not totals.get(0) or not totals.get(1):
        return None
    # of mean 1, so that the evidence is no more than what was sampled
    weight = {r.toxic: r["all"] / r.n * sum(totals.values()) / sum(s["all"] for s in sums) for r in sums}
    kinds = "unit string, stem boolean, toxic int, context long"
    toxic_units = sample.where("toxic = 1").select("text", "toxic").mapInArrow(_units, kinds)
    # contexts of each unit among toxic documents, of those with some, and then among the others
    often = materialized(toxic_units.groupBy("unit", "stem").agg(F.countDistinct("context").alias("bad")).where(F.col("bad") >= LEAST), "toxicity-units")
    other = sample.where("toxic = 0").select("text", "toxic").mapInArrow(_units, kinds).join(often.select("unit", "stem"), ["unit", "stem"], "left_semi")
    counted = often.join(other.groupBy("unit", "stem").agg(F.countDistinct("context").alias("fine")), ["unit", "stem"], "left").fillna(0, ["fine"])
    # how much more the contexts are toxic than a sample of this mixture would have them, as a log-likelihood ratio:
    # that is about the contexts seen, so it is in sampled counts
    base = totals[1] / (totals[0] + totals[1])
    share = F.col("bad") / (F.col("bad") + F.col("fine"))
    times = (F.col("bad") / totals[1]) / ((F.col("fine") + 0.5) / totals[0])
    gain = F.col("bad") * F.log(share / base) + F.when(F.col("fine") > 0, F.col("fine") * F.log((1 - share) / (1 - base))).otherwise(0)
    rows = counted.select("unit", "stem", "bad", "fine", gain.alias("gain"), times.alias("times")).where((F.col("gain") > NEED) & (F.col("times") >= TIMES)).orderBy(F.desc("gain"), "unit", "stem").collect()
    stems: list[str] = []
    for r in sorted((r for r in rows if r.stem), key=lambda r: len(r.unit)):
        if not any(r.unit.startswith(s) for s in stems):
            stems.append(r.unit)
    words = [r.unit for r in rows if not r.stem]
    lexicon = Model(words, stems, [0.0] * (FEATURES + 1))
    sent = sample.sparkSession.sparkContext.broadcast(lexicon)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value.scorer()
        for b in by_bytes(batches, most=PART_BYTES):
            x = [scorer.features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("toxic")], ["x", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(described, "x array<double>, toxic int").groupBy("x", "toxic").count().orderBy("x", "toxic").collect()
    x = np.array([[*r.x, 1.0] for r in rows])
    y = np.array([r.toxic for r in rows], float)
    # the sample has so many times fewer of each label than there are
    n = np.array([r["count"] * weight[r.toxic] for r in rows], float)
    return Model(words, stems, _logistic(x, y, n).tolist())


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + penalty * w
        curvature = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curvature, gradient)
        w -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return w


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with toxicity, from 0 to 1, added."""
    docs = docs.drop("toxicity")
    schema = T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value.scorer() if sent.value else None
        for b in by_bytes(batches, most=PART_BYTES):
            values = [scorer.score(scorer.features(t)) if scorer else 0.0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.float64())], [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)
