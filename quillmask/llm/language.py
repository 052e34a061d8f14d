"""Operator 6: language identification by error-correcting output codes.

Each language has a codeword; a binary classifier per code bit reads the hashed n-grams (1 to 4
bytes) of the whole text and predicts that bit. Decoding adds up, for each language, the exponential
loss of its bits, weighted by how well each classifier does on that language, and takes the nearest
codeword; a text whose two nearest codewords are almost as near is flagged as ambiguous.

Learning reads about ``SAMPLE`` labelled documents, or ``EACH`` a language if that is more (expected
numbers, held by a hash of id and text); every label that has a text with a letter is learned, from
one document at least. Prediction reads every document whole. Null texts and texts without a letter
get ``und``, score 0. Null labels are not learned from. Without any label every text is ``und``.
A row without a doc_id is scored like others; its ``held_out`` is null, and it is never learned from.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.llm.staging import table
from quillmask.llm.words import blocks

#: Labelled documents that a model is fitted on, and the least for each language.
SAMPLE, EACH = 1600, 4
BITS = 13
ORDERS = (1, 2, 3, 4)
#: Up to this many columns, every split of the languages in two is a column.
COLUMNS = 15
#: Columns of a longer code for each doubling of the languages, and its least distance of two rows.
SPREAD, DISTANCE = 6, 5
STEPS, RATE, DECAY = 150, 40.0, 1e-5
AMBIGUOUS = 0.1
#: A text this far from the nearest codeword is in no language: a guess is 1 away. More, if learned
#: texts are farther from their own: FARTHER times what a hundredth of them exceed, at most FARTHEST.
FAR, FARTHER, FARTHEST = 0.3, 1.5, 0.9
FOLDS, HELD = 4, 2
UNKNOWN = "und"
TURN = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
_ASCII = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(texts: list[str]) -> np.ndarray:
    """A row per text: square roots of the shares of its hashed n-grams, so that rows have length 1."""
    clean = [b" " + t.lower().encode().translate(_ASCII) + b" " for t in texts]
    sizes = np.fromiter(map(len, clean), np.int64, len(clean))
    raw, doc = np.frombuffer(b"".join(clean), np.uint8), np.repeat(np.arange(len(clean), dtype=np.int32), sizes)
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32) | (doc[1:] != doc[:-1])
    raw, doc = raw[keep].astype(np.uint32), doc[keep]
    width = 1 << BITS
    counts = np.zeros(len(texts) * width, np.float32)
    value = np.zeros(len(raw), np.uint32)
    for n in ORDERS:
        value = (value[: len(raw) - n + 1] + raw[n - 1 :] + np.uint32(n)) * np.uint32(TURN[n - 1])
        value ^= value >> np.uint32(15)
        inside = doc[n - 1 :] == doc[: len(doc) - n + 1]
        at = doc[n - 1 :][inside].astype(np.int64) * width + (value[inside] * np.uint32(TURN[0]) >> np.uint32(32 - BITS))
        counts += np.bincount(at, minlength=len(counts)).astype(np.float32)
    counts = counts.reshape(len(texts), width)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def distance(code: np.ndarray) -> int:
    """The least number of columns in which two rows differ."""
    wide, least = code.astype(np.float32), code.shape[1]
    for first in range(0, len(wide), 512):
        alike = wide[first : first + 512] @ wide.T
        at = np.arange(len(alike))
        alike[at, first + at] = -code.shape[1]
        least = min(least, int(code.shape[1] - alike.max()) // 2)
    return least


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1 whose columns are all different splits, none the inverse of another.

    Two languages have one split and three have three, so their rows are 1 and 2 apart; four are 4
    and five are 8 apart. From six on the bits are drawn, until all rows are ``DISTANCE`` apart.
    """
    if n < 2:
        return np.ones((n, 1), np.int8)
    if 2 ** (n - 1) - 1 <= COLUMNS:
        return np.array([[1 if row and p >> (row - 1) & 1 else -1 for p in range(1, 2 ** (n - 1))] for row in range(n)], np.int8)
    rng, width = np.random.default_rng(n), max(COLUMNS, math.ceil(SPREAD * math.log2(n)))
    while True:
        columns: dict[bytes, np.ndarray] = {}
        while len(columns) < width:
            column = rng.integers(0, 2, n, dtype=np.int8)
            column ^= column[0]
            if column.any():
                columns[column.tobytes()] = column
        code = 2 * np.stack(list(columns.values()), axis=1) - 1
        if distance(code) >= DISTANCE:
            return code


class Codes:
    """Languages, their codewords, one linear classifier per column and the decoding weights."""

    def __init__(self, langs: list[str], code: np.ndarray, weight: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.langs, self.code, self.weight, self.bias, self.trust = langs, code, weight, bias, trust

    @classmethod
    def fit(cls, texts: list[str], labels: list[str]) -> Codes:
        langs = sorted(set(labels))
        code = codewords(len(langs))
        place = {x: k for k, x in enumerate(langs)}
        which = np.array([place[x] for x in labels], int)
        x = np.concatenate([features(texts[i : i + 256]) for i in range(0, len(texts), 256)]) if texts else np.zeros((0, 1 << BITS), np.float32)
        y = (code[which] > 0).astype(np.float32)
        share = np.bincount(which, minlength=len(langs)) if len(which) else np.ones(1)
        each = (1 / share[which] / len(langs)).astype(np.float32)[:, None] if len(which) else np.ones((0, 1), np.float32)
        weight, bias = np.zeros((1 << BITS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
        pace = np.zeros_like(weight)
        for _ in range(STEPS if len(langs) > 1 else 0):
            off = (1 / (1 + np.exp(-(x @ weight + bias))) - y) * each
            pace = 0.9 * pace + x.T @ off + DECAY * weight
            weight -= RATE * 0.1 * pace
            bias -= off.sum(axis=0)
        right = ((x @ weight + bias > 0) == (y > 0)).astype(np.float32)
        trust = np.array([right[which == k].mean(axis=0) if (which == k).any() else np.ones(code.shape[1]) for k in range(len(langs))], np.float32).reshape(len(langs), code.shape[1])
        model = cls(langs, code, weight, bias, trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-9))
        if len(langs) > 1:
            own = model.losses(x)[np.arange(len(which)), which]
            model.far = min(FARTHEST, max(FAR, FARTHER * float(np.quantile(own, 0.99))))
        return model

    #: With one language or none there is nothing to tell a text by, so none is too far.
    far = math.inf

    def losses(self, x: np.ndarray) -> np.ndarray:
        """How far rows of features are from each codeword: 0 is on it, 1 is a guess."""
        margin = np.clip(x @ self.weight + self.bias, -4, 4)
        # A bit's loss is one of two values, so all languages are two products of matrices.
        return np.exp(-margin) @ (self.trust * (self.code > 0)).T + np.exp(margin) @ (self.trust * (self.code < 0)).T

    def known(self, texts: list[str]) -> np.ndarray:
        """Whether each text is near the codeword of a language."""
        return self.losses(features(texts)).min(axis=1) < self.far

    def decode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, score between 0 and 1, whether it is ambiguous."""
        loss = self.losses(features(texts))
        near = np.exp(-loss)
        chance = near / near.sum(axis=1, keepdims=True)
        best = chance.argmax(axis=1)
        top = np.sort(chance, axis=1)
        return best, top[:, -1], (top[:, -1] - top[:, -2] < AMBIGUOUS) if len(self.langs) > 1 else np.zeros(len(texts), bool)


def fit(documents: DataFrame, held: int | None = HELD, sample: int = SAMPLE) -> Codes:
    """Learn from documents outside the held-out fold (None: from all that have a label)."""
    ids = documents.filter("lang is not null and text is not null")
    if held is not None:
        ids = ids.filter(fold(F.col("doc_id")) != held)
    unit = F.pmod(F.xxhash64(F.lit("lang"), "doc_id", "text"), F.lit(1 << 40)) / (1 << 40)
    ids = ids.filter(F.col("text").rlike(r"\p{L}")).select("text", "lang", unit.alias("unit"))
    counts = ids.groupBy("lang").agg(F.count("*").alias("n"), F.min("unit").alias("least")).collect()
    if not counts:
        return Codes.fit([], [])
    each = max(EACH, sample / len(counts))
    rates = documents.sparkSession.createDataFrame([(r["lang"], each / r["n"], r["least"]) for r in counts], "lang string, rate double, least double")
    # The document of the least hash always stays; copies, which have one hash, are learned once.
    taken = ids.join(F.broadcast(rates), "lang").filter("unit < rate or unit = least").dropDuplicates(["lang", "unit"])
    kept = sorted((r["text"], r["lang"]) for r in taken.select("text", "lang").toLocalIterator() if has_letter(r["text"]))
    return Codes.fit([t for t, _ in kept], [x for _, x in kept])


PREDICTED = "doc_id long, lang_pred string, score double, ambiguous boolean"


def predict(documents: DataFrame, model: Codes) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous for every row; only id and text are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in blocks(batches):
            texts = [t.decode() for t in raw]
            lang, score, unsure = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts), bool)
            known = [i for i, t in enumerate(texts) if model.langs and has_letter(t)]
            for first in range(0, len(known), 256):
                at = known[first : first + 256]
                best, sure, two = model.decode([texts[i] for i in at])
                lang[at], score[at], unsure[at] = np.array(model.langs, object)[best], sure, two
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PREDICTED)


def identified(documents: DataFrame) -> DataFrame:
    """The documents whose language is known: those without a letter, and those that are far from the
    codeword of every language, go. The decision rests on the text alone, so it is made row by row."""
    model = fit(documents, held=None)
    columns = documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in blocks(batches):
            texts = [t.decode() for t in raw]
            keep = np.zeros(len(texts), bool)
            known = [i for i, t in enumerate(texts) if has_letter(t)]
            for first in range(0, len(known), 256):
                at = known[first : first + 256]
                keep[at] = model.known([texts[i] for i in at]) if model.langs else True
            yield part.filter(pa.array(keep))

    return documents.mapInArrow(run, columns)


def op6_language_id(spark, sf_dir) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(documents, fit(documents))
    return found.select("doc_id", (fold(F.col("doc_id")) == HELD).alias("held_out"), "lang_pred", "score", "ambiguous")
