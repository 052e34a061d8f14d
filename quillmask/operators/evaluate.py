"""Precision, recall and F1 of detections against gold spans, and throughput.

A prediction counts if it covers half of a gold span of its type that no earlier prediction has taken.
Predictions go by start, then end; each takes the free gold span nearest to its end (the last by start,
then end). Spans that overlap, predicted or gold, form clusters; matching runs inside a cluster, or a document
of one block, in order and holds its gold spans, so a document of any length is the work of many tasks.
"""

from __future__ import annotations

import time
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.operators.clusters import free_prefix, grouped
from quillmask.operators.engine import Masker
from quillmask.session import ship_package

#: Share of a gold span that a prediction of its type must cover.
COVER = 0.5


class Gold:
    """Gold spans of a cluster, added in order, each taken once."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.reach: list[int] = []  # the largest end so far
        self.free: list[bool] = []

    def add(self, start: int, end: int) -> None:
        self.starts.append(start)
        self.ends.append(end)
        self.reach.append(max(end, self.reach[-1]) if self.reach else end)
        self.free.append(True)

    def take(self, start: int, end: int) -> tuple[int, int] | None:
        """The free span for this prediction, which is not free any more."""
        j = bisect_right(self.starts, end) - 1
        while j >= 0 and self.reach[j] > start:
            a, b = self.starts[j], self.ends[j]
            shared = min(end, b) - max(start, a)
            if self.free[j] and shared > 0 and shared >= COVER * (b - a):
                self.free[j] = False
                return a, b
            j -= 1
        return None


def matched(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """keys, entity_type, start, end, gold_start, gold_end: pairs of which each row occurs once."""
    ship_package(predicted.sparkSession)
    names = [*keys, "entity_type"]
    lead = free_prefix([*names, "start", "end", "gold_start", "gold_end"])
    first, mine = (lead + n for n in ("first", "mine"))
    spans = lambda frame, is_mine: frame.select(*names, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.lit(is_mine).alias(mine))
    both = spans(predicted, True).unionByName(spans(gold, False))
    ordered = grouped(both, names, [mine, "start", "end"], first)
    width = len(names) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gold()
        for batch in batches:
            starts, ends, own, firsts = (batch.column(width - 2 + i).to_pylist() for i in range(4))
            hits, pairs = [], []
            for i, (start, end, is_mine, new) in enumerate(zip(starts, ends, own, firsts, strict=True)):
                if new:
                    held = Gold()
                if not is_mine:
                    held.add(start, end)
                elif (pair := held.take(start, end)) is not None:
                    hits.append(i)
                    pairs.append(pair)
            rows = batch.take(pa.array(hits, pa.int64()))
            sides = [pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*rows.columns[:width], *sides], [*names, "start", "end", "gold_start", "gold_end"])

    kinds = {f.name: f.dataType.simpleString() for f in both.schema}
    return ordered.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in (*names, "start", "end")) + ", gold_start long, gold_end long")


def scores(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """entity_type, tp, fp, fn, precision, recall, f1; the row ``all`` has the sums."""
    count = lambda rows, name: rows.groupBy("entity_type").agg(F.count("*").alias(name))
    joined = count(predicted, "n_predicted").join(count(gold, "n_gold"), "entity_type", "full").join(count(matched(predicted, gold, keys), "tp"), "entity_type", "left").na.fill(0)
    sums = [F.sum(c).alias(c) for c in ("n_predicted", "n_gold", "tp")]
    every = joined.unionByName(joined.agg(*sums).select(F.lit("all").alias("entity_type"), "n_predicted", "n_gold", "tp").na.fill(0))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = share(F.col("tp"), F.col("n_predicted")), share(F.col("tp"), F.col("n_gold"))
    rated = every.select("entity_type", "tp", (F.col("n_predicted") - F.col("tp")).alias("fp"), (F.col("n_gold") - F.col("tp")).alias("fn"), precision.alias("precision"), recall.alias("recall"))
    return rated.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def throughput(masker: Masker, documents: DataFrame, text: str = "text") -> float:
    """Megabytes (10^6 bytes) of text a second through ``detect``, all cores, nothing written."""
    size = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    began = time.perf_counter()
    masker.detect(documents, text).write.format("noop").mode("overwrite").save()
    return size / 1e6 / (time.perf_counter() - began)
