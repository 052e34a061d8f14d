"""Operator 10: toxicity by FTRL-proximal logistic regression over hashed word n-grams.

A text's features are its distinct words, word pairs and pairs with one word between, and, since
whole words miss inflected forms, the runs of 4 and 5 bytes inside each word and its two edges; all
are hashed to ``1 << BITS`` places. The per-coordinate rates and the L1 term of FTRL-proximal leave few weights
that are not 0; these are what the executors get. Learning reads at most ``SAMPLE`` labelled
documents; scoring reads every text whole. Null and empty texts get the score of the bias alone;
null labels are not learned from, and of several labels of a document the highest counts.
A row without a doc_id is scored like others; its ``held_out`` is null, and it is never learned from.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm.language import fold
from quillmask.llm.staging import table
from quillmask.llm.words import Words, blocks, mix

#: Most labelled documents that the model is fitted on.
SAMPLE = 8000
BITS = 20
PASSES = 5
ALPHA, BETA, L1, L2 = 0.5, 1.0, 20.0, 1.0
FOLDS, HELD = 5, 0
SUBWORDS = (4, 5)
#: Words here are runs of letters, digits and bytes beyond ASCII.
BREAK = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Document and place of every word, pair, skip pair and sub-word, repeats included.

    A line feed leads each text so that its first word has an edge; sub-words that reach into a
    neighbouring text are none, since a text also ends with one.
    """
    words = Words([b"\n" + t for t in texts], lower=True, breaks=BREAK)
    h, doc = words.hashes(), words.docs()
    docs, places = [doc], [h]
    for gap, salt in ((1, 0x51), (2, 0x52)):
        same = doc[gap:] == doc[:-gap]
        docs.append(doc[gap:][same])
        places.append(mix(h[:-gap][same] * np.uint64(3) + h[gap:][same] + np.uint64(salt)))
    eight = np.ndarray((len(words.data) - 7,), "<u8", words.data, strides=(1,))
    gap = BREAK[np.frombuffer(words.data, np.uint8)]
    at = np.searchsorted(words.doc_byte, np.arange(len(eight)), "right") - 1 if len(eight) else np.empty(0, np.int64)
    for size in SUBWORDS:
        inner = ~np.logical_or.reduce([gap[k : k + len(eight)] for k in range(1, size - 1)])
        value = eight[inner] & np.uint64((1 << 8 * size) - 1)
        # Whatever stands at a word's edge counts as the same edge.
        value = np.where(gap[: len(eight)][inner], value | np.uint64(0xFF), value)
        value = np.where(gap[size - 1 : size - 1 + len(eight)][inner], value | np.uint64(0xFF << 8 * (size - 1)), value)
        docs.append(at[inner])
        places.append(mix(value + np.uint64(size << 56)))
    return np.concatenate(docs), (np.concatenate(places) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """Weights by place, as two short arrays, and the bias."""

    def __init__(self, place: np.ndarray, weight: np.ndarray, bias: float):
        self.place, self.weight, self.bias = place, weight, bias

    @classmethod
    def fit(cls, examples: Iterable[tuple[np.ndarray, int]]) -> Ftrl:
        """``examples``: distinct places of a document and its label."""
        examples = list(examples)
        # The last place is the bias, which has no L1 term.
        z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
        l1 = np.full(len(z), L1)
        l1[-1] = 0

        def weights(at: np.ndarray) -> np.ndarray:
            over = np.abs(z[at]) - l1[at]
            return np.where(over > 0, -np.sign(z[at]) * over / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

        order = np.random.default_rng(10)
        for _ in range(PASSES):
            for k in order.permutation(len(examples)):
                place, label = examples[k]
                at = np.append(place, len(z) - 1)
                w = weights(at)
                slope = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
                z[at] += slope - (np.sqrt(n[at] + slope * slope) - np.sqrt(n[at])) / ALPHA * w
                n[at] += slope * slope
        every = weights(np.arange(len(z)))
        place = np.flatnonzero(every[:-1])
        return cls(place, every[place], float(every[-1]))

    def score(self, texts: list[bytes], table_of: np.ndarray) -> np.ndarray:
        doc, place = features(texts)
        telling = table_of[place] != 0
        both = np.unique((doc[telling].astype(np.int64) << BITS) | place[telling])
        total = np.bincount(both >> BITS, weights=table_of[both & ((1 << BITS) - 1)], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.place] = self.weight
        return out


def fit(documents: DataFrame, labels: DataFrame, held: int | None = HELD, sample: int = SAMPLE) -> Ftrl:
    """Learn ``labels.toxic`` from documents outside the held-out fold."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if held is not None:
        known = known.filter(fold(F.col("doc_id"), FOLDS) != held)
    chosen = known.orderBy(F.xxhash64(F.lit("toxic"), "doc_id"), "doc_id").limit(sample)
    rows = documents.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            doc, place = features(texts)
            both = np.unique((doc.astype(np.int64) << BITS) | place)
            cut = np.searchsorted(both >> BITS, np.arange(len(texts) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array((both & ((1 << BITS) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists, part.column(2)], ["doc_id", "places", "toxic"])

    found = rows.mapInArrow(digest, "doc_id long, places array<int>, toxic int").toArrow()
    found = found.sort_by("doc_id")
    places, toxic = found.column("places").combine_chunks(), found.column("toxic").to_pylist()
    return Ftrl.fit((places[i].values.to_numpy(), y) for i, y in enumerate(toxic))


def scores(documents: DataFrame, model: Ftrl) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = model.dense()
        for part, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(texts, weight))], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op10_toxicity(spark, sf_dir) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    found = scores(documents, fit(documents, labels))
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
