"""Spans of long documents, one a row: clusters of those that overlap, and what is decided in them.

Two spans overlap if each starts before the other ends; spans that overlap, also through others, form a
cluster. A span begins a cluster if no span before it (by start, then end) reaches past its start. That
running maximum is taken in two levels: inside blocks of ``BLOCK`` characters of a document, and over the
blocks' maxima, so a document of any length is the work of many tasks. What is decided inside a cluster, or
in a document of one block, runs over its sorted rows one after the other, holding only what is kept.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmask.session import ship_package, stage

BLOCK = 1 << 16
#: Spans of a partition, about.
ROWS = 500_000
#: Spans of a staged file. A task of a scan takes at most 32 files, however small (128 MB, 4 MB for opening each),
#: so this bounds what it buffers for the shuffle.
FILE = 100_000


def free_prefix(columns: list[str]) -> str:
    """A prefix that none of the columns has, for helper columns beside them."""
    lead = "_quill_"
    while any(c.lower().startswith(lead) for c in columns):
        lead += "_"
    return lead


def carried(rows: DataFrame, key: str, block: str, value: str, out: str, combine: Callable = F.max, parts: int | None = None) -> DataFrame:
    """Adds ``out``: ``combine`` (max or sum) of the values in the key's earlier blocks; null where there is none.
    The blocks are taken in ``parts`` partitions, if given."""
    tops = rows.groupBy(key, block).agg(combine(value).alias(out))
    tops = tops.repartition(parts, key) if parts else tops
    earlier = Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(tops.select(key, block, combine(out).over(earlier).alias(out)), [key, block])


def clustered(rows: DataFrame, key: str, at: str, cluster: str, parts: int) -> DataFrame:
    """Adds ``cluster``, the start of the first span of each row's cluster; ``at`` is the block of its start, and
    the rows are dealt by key and block."""
    lead = free_prefix([*rows.columns, cluster])
    top, new, last = (lead + n for n in ("top", "new", "last"))
    order = Window.partitionBy(key, at).orderBy("start", "end")
    reach = F.greatest(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col(top))
    rows = carried(rows, key, at, "end", top, parts=parts)
    rows = rows.withColumn(new, F.when(F.coalesce(reach <= F.col("start"), F.lit(True)), F.col("start")))
    rows = carried(rows, key, at, new, last, parts=parts)
    # Spans of one start come in any order here, so all of them count.
    own = F.max(new).over(Window.partitionBy(key, at).orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn(cluster, F.coalesce(own, last)).drop(top, new, last)


def grouped(spans: DataFrame, keys: list[str], by: list[Column | str], first: str, block: int = BLOCK) -> DataFrame:
    """The spans in groups that no overlap leaves, each in one partition and in the order ``by``; ``first`` marks
    a group's first row. Null is a key like others, so where keys are joined they are compared as a struct.

    A document whose spans all start in its first block is a group as it is, which takes one shuffle; in
    the others groups are clusters. The spans are staged, in files of ``FILE``, which counts them: the
    partitions of every shuffle hold about ``ROWS`` of them, however many there are."""
    lead = free_prefix([*spans.columns, first])
    key, at, cluster, far = (lead + n for n in ("key", "at", "cluster", "far"))
    rows, place = stage(spans, "spans", FILE), F.floor(F.col("start") / block)
    n, beyond = rows.agg(F.count("*"), F.max(place != 0)).first()
    parts = max(int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS))

    def marked(some: DataFrame, *group: str) -> DataFrame:
        return some.select(*spans.columns, (F.row_number().over(Window.partitionBy(*group).orderBy(*by)) == 1).alias(first))

    if not beyond:
        return marked(rows.repartition(parts, *keys), *keys)
    dealt = rows.withColumns({key: F.struct(*keys), at: place}).repartition(parts, key, at)
    # A row for each block; whether its document has later ones tells long documents from short ones.
    blocks = dealt.select(key, at).distinct().repartition(parts, key)
    dealt = dealt.join(blocks.select(key, at, F.max(F.col(at) != 0).over(Window.partitionBy(key)).alias(far)), [key, at])
    short = marked(dealt.filter(~F.col(far)), key, at)
    long = clustered(dealt.filter(far).drop(far), key, at, cluster, parts)
    return short.unionByName(marked(long.repartition(parts, key, cluster), key, cluster))


class Disjoint:
    """Disjoint spans in order, in lists of at most ``MOST``, so that adding stays cheap in large sets."""

    MOST = 1024

    def __init__(self) -> None:
        self.lists: list[tuple[list[int], list[int]]] = [([], [])]
        self.tops: list[float] = [float("inf")]

    def add(self, start: int, end: int) -> bool:
        """Takes the span unless it overlaps one that is here."""
        # The first span here that ends after this one starts; only the last list has no upper bound.
        k = bisect_right(self.tops, start)
        starts, ends = self.lists[min(k, len(self.lists) - 1)]
        place = bisect_right(ends, start)
        if place < len(ends) and starts[place] < end:
            return False
        starts.insert(place, start)
        ends.insert(place, end)
        if len(ends) > self.MOST:
            half = len(ends) // 2
            self.lists[k : k + 1] = [(starts[:half], ends[:half]), (starts[half:], ends[half:])]
            self.tops[k : k + 1] = [ends[half - 1], self.tops[k]]
        return True


def resolved_rows(spans: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """From the surest (then longest, first, and of the first tier) on, what overlaps nothing kept. Rows
    are (keys, start, end, confidence, ord and more); they come out as they went in."""
    ship_package(spans.sparkSession)
    first = free_prefix(spans.columns) + "first"
    rank = [F.desc("confidence"), F.col("start") - F.col("end"), F.col("start"), F.col("ord")]
    ranked = grouped(spans, keys, rank, first, block)
    width = len(spans.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Disjoint()
        for batch in batches:
            stays = np.zeros(batch.num_rows, bool)
            starts, ends, firsts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("start", "end", first))
            for i, (start, end, new) in enumerate(zip(starts, ends, firsts, strict=True)):
                if new:
                    kept = Disjoint()
                stays[i] = kept.add(start, end)
            yield batch.select(range(width)).filter(pa.array(stays))

    return ranked.mapInArrow(run, spans.schema)
