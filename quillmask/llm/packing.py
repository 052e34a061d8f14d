"""Operator 2: best-fit packing with bound-certified repacking.

Documents become pieces of at most ``LENGTH`` tokens. Pieces are dealt to partitions of a bounded
number of pieces; each is packed best-fit decreasing, and dual-feasible functions give a lower bound
of its sequences. A partition that meets its bound is proved best. The others give up every sequence
that is not full; what several of them gave up is pooled, packed again and kept if it takes fewer
sequences. Pools grow from round to round up to ``ITEMS * FACTOR ** ROUNDS`` pieces.

Null texts are empty and have the end id alone; repeated rows are packed as documents of their own;
an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm.staging import stage, table
from quillmask.llm.tokens import pieces
from quillmask.llm.words import blocks

LENGTH = 2048
END = 0
ITEMS, FACTOR, ROUNDS = 1024, 8, 2
#: Dual-feasible step functions u(1) to u(STEPS).
STEPS = 40

PIECE = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECE}, pool long, bin int, offset long, slack long, gap long"


def token_pieces(documents: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """One row a piece; ``uid`` tells rows apart and holds once the rows are staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        with pieces(path, True) as tokeniser:
            for rows, texts in blocks(batches):
                out = []
                for doc_id, ids in zip(rows.column(0).to_pylist(), tokeniser.encode([t.decode() for t in texts]), strict=True):
                    ids += END.to_bytes(4, "little")
                    n = len(ids) // 4
                    edges = [0, *range(n % length or length, n + 1, length)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        out.append((uid, doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                        uid += 1
                kinds = [pa.int32() if c.endswith("int") else pa.int64() for c in PIECE.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in PIECE.split(", ")])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE)


def best_fit(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, placed from the largest on into the fullest bin that has room."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(length + 1)]
    open_, count = 0, 0  # bit r of open_: some bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = open_ >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            which = room[left].pop()
            if not room[left]:
                open_ ^= 1 << left
        else:
            left, which = length, count
            count += 1
        bins[i], offsets[i] = which, length - left
        if left > size:
            room[left - size].append(which)
            open_ |= 1 << (left - size)
    return bins, offsets


def lower_bound(sizes: np.ndarray, length: int = LENGTH) -> int:
    """The best of the dual-feasible bounds: no packing takes fewer bins."""
    if not len(sizes):
        return 0
    counts = np.bincount(sizes, minlength=length + 1)
    number, total = np.cumsum(counts), np.cumsum(counts * np.arange(length + 1))
    cut = np.arange(length // 2 + 1)
    # Sizes over length - cut fill a bin each; those under cut count nothing; the rest their size.
    big = number[-1] - number[length - cut]
    middle = total[length - cut] - np.where(cut > 0, total[np.maximum(cut - 1, 0)], 0)
    best = int((big + -(-middle // length)).max())
    for k in range(1, STEPS + 1):
        share, rest = np.divmod((k + 1) * sizes, length)
        best = max(best, -(-int(np.where(rest == 0, sizes * k, share * length).sum()) // (k * length)))
    # Of the pieces over half, no two share a bin; the smaller fill the room beside them first.
    half = length // 2
    over = number[-1] - number[half]
    for least in range(0, half + 1, 32):
        beside = counts[half + 1 : length - least + 1]
        room = int((beside * (length - np.arange(half + 1, length - least + 1))).sum())
        small = int(total[half] - (total[least - 1] if least else 0))
        best = max(best, int(over) + max(0, -(-(small - room) // length)))
    return best


def _repack(group: pd.DataFrame, was: int | None) -> pd.DataFrame:
    """Best-fit decreasing of a pool; ``was``: the sequences its pieces came in, kept if no fewer do."""
    group = group.sort_values(["length", "uid"], ascending=[False, True], kind="stable")
    sizes = group["length"].to_numpy()
    bins, offsets = best_fit(sizes)
    count = int(bins.max()) + 1
    gap = count - lower_bound(sizes)
    if was is not None and count >= was:
        return group.assign(gap=np.int64(min(gap, was - lower_bound(sizes))))
    fill = np.bincount(bins, weights=sizes).astype(np.int64)
    return group.assign(bin=bins.astype(np.int32), offset=offsets, slack=(LENGTH - fill)[bins], gap=np.int64(gap), pool=group["target"])


def packed(rows: DataFrame) -> DataFrame:
    """Sequence and offset of every piece of a staged table of pieces."""
    whole = rows.filter(F.col("length") == LENGTH).select("*", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = rows.filter(F.col("length") < LENGTH)
    pools = max(1, -(-short.count() // ITEMS))
    names = [c.split()[0] for c in PACKED.split(", ")]

    def first(group: pd.DataFrame) -> pd.DataFrame:
        return _repack(group.rename(columns={"pool": "target"}).assign(pool=np.int64(0)), None)[names]

    found = short.withColumn("pool", F.pmod(F.xxhash64("uid"), F.lit(pools))).groupBy("pool").applyInPandas(first, PACKED)
    found = stage(found, "pack-0")
    for round_ in range(1, ROUNDS + 1):
        pools = -(-pools // FACTOR)

        def again(group: pd.DataFrame) -> pd.DataFrame:
            return _repack(group, len(group.drop_duplicates(["pool", "bin"])))[names]

        loose = (F.col("gap") > 0) & (F.col("slack") > 0)
        target = F.lit(round_) * F.lit(1 << 36) + F.pmod(F.xxhash64("pool"), F.lit(pools))
        exchanged = found.filter(loose).withColumn("target", target).groupBy("target").applyInPandas(again, PACKED)
        found = stage(found.filter(~loose).unionByName(exchanged), f"pack-{round_}")
    numbered = found.select(*[c.split()[0] for c in PIECE.split(", ")], (F.col("pool") * (1 << 24) + F.col("bin")).alias("sequence_id"), "offset")
    return numbered.unionByName(whole)


def pack_documents(documents: DataFrame, path: str) -> DataFrame:
    rows = stage(token_pieces(documents, path), "pack-pieces")
    return packed(rows).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_pack_sequences(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
