"""Language identification by a string kernel with Nyström landmarks and kernel ridge regression.

The kernel of two texts is the number of byte n-grams of lengths 1 to 3 that both have, over the
root of the product of how many each has (a blended spectrum of presences; n-grams are hashed to
``N_GRAMS`` places). It is approximated by kernels with landmarks, a few texts of each language: with
K the kernels among landmarks, a text's features are its kernels with the landmarks times the inverse
root of K. One ridge regression for each language, against the rest, is solved on those features. All
of it is linear in the presences, so a batch of texts is scored by one product of its presence matrix
with the weights of n-grams, whatever the number of landmarks.

Learning uses at most about ``per_language`` documents of each language, chosen by a hash of doc_id.
Their presences are made by the tasks, from whole texts, and a document reaches the driver as 4 KB of
bits, so the sample is bounded by that, ``per_language`` and the number of languages. Every document is
scored by its whole text, in pieces of any length, as presences of pieces are joined by "or".

Defined results: a text that is null or has no letter is ``und`` with score 0; rows repeated give the
same result each; without anything to learn from, all are ``und``; an empty table gives an empty one;
columns that clash with those added are replaced by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.llm.shared import PIECE_BYTES, buffers, by_bytes, materialized, rows_of

N_GRAMS = 1 << 15
_LETTER = regex.compile(r"\p{L}")
#: A-Z as a-z; ASCII that is no letter as a space.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def _mark(presence: np.ndarray, row: int, data: np.ndarray) -> None:
    for low in range(0, len(data), PIECE_BYTES):
        b = _FOLD[data[low : low + PIECE_BYTES + 2]].astype(np.uint32)
        two = b[:-1] * np.uint32(257) + b[1:]
        presence[row, b % N_GRAMS] = 1
        presence[row, (two * np.uint32(2654435761) >> np.uint32(9)) % N_GRAMS] = 1
        presence[row, ((two[:-1] * np.uint32(263) + b[2:]) * np.uint32(2246822519) >> np.uint32(9)) % N_GRAMS] = 1


def presences(texts: pa.Array, rows: int = 128) -> Iterator[np.ndarray]:
    """Matrices of which n-grams each of up to ``rows`` texts has."""
    data, offsets = buffers(texts)
    for first in range(0, len(texts), rows):
        last = min(first + rows, len(texts))
        out = np.zeros((last - first, N_GRAMS), np.float32)
        for i in range(first, last):
            _mark(out, i - first, data[offsets[i] : offsets[i + 1]])
        yield out


def packed(texts: pa.Array) -> list[bytes]:
    """The presences of each text as bits."""
    return [row.tobytes() for x in presences(texts) for row in np.packbits(x.astype(bool), axis=1)]


def _unpacked(bits: list[bytes], rows: int = 256) -> Iterator[np.ndarray]:
    for low in range(0, len(bits), rows):
        some = bits[low : low + rows]
        yield np.unpackbits(np.frombuffer(b"".join(some), np.uint8).reshape(len(some), -1), axis=1).astype(np.float32)


class LanguageModel:
    """Weights of n-grams for each language, from packed presences of texts and their languages."""

    def __init__(self, bits: list[bytes], langs: list[str], landmarks: int = 64, ridge: float = 1e-2) -> None:
        self.langs = sorted(set(langs))
        y = np.where(np.array(langs)[:, None] == np.array(self.langs)[None], 1.0, -1.0)
        chosen = np.concatenate([np.flatnonzero(y[:, k] > 0)[:landmarks] for k in range(len(self.langs))])
        unit = lambda x: x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        marks = np.concatenate([unit(x) for x in _unpacked([bits[i] for i in chosen])])
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        keep = values > 1e-6 * values[-1]
        root = vectors[:, keep] / np.sqrt(values[keep])
        features = np.concatenate([(unit(x) @ marks.T).astype(np.float64) @ root for x in _unpacked(bits)])
        features = np.hstack([features, np.ones((len(features), 1))])
        # languages count alike, however many of the sample they are
        weight = 1 / np.array([langs.count(v) for v in langs], np.float64)
        weight *= len(langs) / weight.sum()
        gram = features.T @ (features * weight[:, None]) + ridge * np.eye(features.shape[1])
        solved = np.linalg.solve(gram, features.T @ (y * weight[:, None]))
        self.weights = (marks.T.astype(np.float64) @ (root @ solved[:-1])).astype(np.float32)
        self.bias = solved[-1].astype(np.float32)

    def scores(self, presence: np.ndarray) -> np.ndarray:
        return presence @ self.weights / np.sqrt(np.maximum(presence.sum(1, keepdims=True), 1)) + self.bias


def training_sample(docs: DataFrame, per_language: int = 500) -> list[tuple[bytes, str]]:
    """Presences and language of up to about ``per_language`` documents of each language, by a hash of doc_id."""
    rows = docs.where("lang is not null and text is not null and doc_id is not null")
    counts = rows.groupBy("lang").count()
    chance = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    narrow = rows.select("doc_id", "lang").join(F.broadcast(counts) if counts.limit(1001).count() <= 1000 else counts, "lang")
    ids = materialized(narrow.where(chance * F.col("count") < per_language).select("doc_id"), "language-sample")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches):
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("lang"), pa.array(packed(b.column("text")), pa.binary())], ["h", "lang", "bits"])

    chosen = rows_of(rows, ids).select(F.xxhash64("doc_id", "text").alias("h"), "lang", "text").mapInArrow(bits, "h long, lang string, bits binary")
    found = chosen.collect()
    return [(bytes(r.bits), r.lang) for r in sorted(found, key=lambda r: (r.h, r.lang, bytes(r.bits)))]


def identify(docs: DataFrame, sample: list[tuple[bytes, str]]) -> DataFrame:
    """docs with lang_pred and score (the share of the best language after a softmax) added."""
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    model = LanguageModel([x for x, _ in sample], [v for _, v in sample]) if sample else None
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in by_bytes(batches):
            texts = b.column("text")
            lettered = np.array([t is not None and _LETTER.search(t) is not None for t in texts.to_pylist()], bool)
            pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if model is not None and len(texts):
                raw = np.concatenate([model.scores(p) for p in presences(texts)])
                e = np.exp(4 * (raw - raw.max(1, keepdims=True)))
                best = raw.argmax(1)
                pred = np.where(lettered, np.array(model.langs, object)[best], "und")
                score = np.where(lettered, (e / e.sum(1, keepdims=True))[np.arange(len(best)), best], 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score.astype(np.float64), pa.float64())], [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)
