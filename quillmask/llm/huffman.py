"""Operator 8: token ids in canonical, length-limited Huffman code.

Codes come from the global counts of ids (one number for each entry of the vocabulary, so bounded)
by package-merge, at most 16 bits long. Ids are written in ascending doc_id order as blocks that
stand alone: the ids of whole documents, packed, with the bit offset of every ``SEGMENT``-th id. A
reader needs the code lengths and a block; it looks up 16 bits at a time and decodes all segments of
its blocks in step.

The file: a folder of two Parquet tables, ``code`` (id, size) and ``blocks`` (part, first,
doc_ids, counts, offsets, payload). ``part`` ascends with doc_id, ``first`` is the number of ids of
the part before the block; in the order of both the blocks are the documents in ascending doc_id.

Null texts are empty; an empty text is its end id alone; equal ids of rows keep together, ordered by
their ids; a null doc_id comes first; an empty table gives an empty file. A vocabulary of more than 65,536
ids is an error. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm.bits import canonical, lookup, pack, unpack
from quillmask.llm.ranges import id_bounds, range_count, range_of
from quillmask.llm.staging import partitions, stage, table
from quillmask.llm.tokens import pieces
from quillmask.llm.words import blocks

END = 1
LONGEST = 16
SEGMENT = 256
#: Ids of a block, unless one document has more.
BLOCK = 1 << 16
#: Blocks decoded at once.
GROUP = 16


def code_sizes(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of the best prefix code with no length over ``longest`` (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    sizes = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        sizes[used] = 1
        return sizes
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} symbols do not fit in {longest} bits")
    leaves = used[np.argsort(counts[used], kind="stable")]
    weight = counts[leaves].astype(np.int64)
    levels, packages = [], np.empty(0, np.int64)
    for _ in range(longest):
        both = np.concatenate((weight, packages))
        order = np.argsort(both, kind="stable")
        levels.append(order < len(weight))
        row = both[order]
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(leaves) - 2
    for leaf in reversed(levels):
        n = int(leaf[:take].sum())
        sizes[leaves[:n]] += 1
        take = 2 * (take - n)
    return sizes


TOKENS = "part int, doc_id long, ids binary"
ORDERED = "part int, first long, doc_id long, ids binary"


def _ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), "<u2")


def ordered_ids(documents: DataFrame, path: str) -> DataFrame:
    """(part, first, doc_id, ids): each document's ids, compressed; ``part`` is a range of doc_ids and
    ``first`` counts the ids before the document in its part. Texts are tokenised once."""
    spark = documents.sparkSession
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    count_ = range_count(base, 2)
    bounds = id_bounds(base, count_)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack_ = zstandard.ZstdCompressor(level=1).compress
        with pieces(path, False) as tokeniser:
            for rows, texts in blocks(batches):
                found = tokeniser.encode([t.decode() for t in texts])
                ids = [np.append(np.frombuffer(b, "<u4"), np.uint32(END)) for b in found]
                if any(len(x) and x.max() > 0xFFFF for x in ids):
                    raise ValueError("a vocabulary of more than 65,536 ids")
                yield pa.RecordBatch.from_arrays([pa.array(range_of(rows.column(0), bounds)), rows.column(0), pa.array([pack_(x.astype("<u2").tobytes()) for x in ids], pa.binary())], ["part", "doc_id", "ids"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = None, 0
        for batch in batches:
            firsts = []
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                part, at = p, at if p == part else 0
                firsts.append(at)
                at += zstandard.frame_content_size(raw) // 2
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(firsts, pa.int64()), batch.column(1), batch.column(2)], ["part", "first", "doc_id", "ids"])

    dealt = base.mapInArrow(tokenise, TOKENS).repartition(max(partitions(spark), count_ // 2), "part").sortWithinPartitions("part", "doc_id", "ids")
    return stage(dealt.mapInArrow(count, ORDERED), "huffman-ids")


def id_counts(ordered: DataFrame) -> np.ndarray:
    """How often each id occurs, end ids included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                total += np.bincount(np.concatenate([_ids(b) for b in batch.column(0).slice(at, 512).to_pylist()]), minlength=1 << 16)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    found = ordered.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(max(found["id"].to_pylist(), default=0) + 1, np.int64)
    counts[found["id"].to_numpy()] = found["n"].to_numpy()
    return counts


BLOCKS = "part int, first long, doc_ids array<long>, counts array<long>, offsets array<long>, payload binary"
_BLOCK_TYPES = [pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]


def encode_block(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Payload and the bit offset of every ``SEGMENT``-th id."""
    size = sizes[ids]
    ends = np.cumsum(size)
    at = ends - size
    total = (int(ends[-1]) + 7) // 8 if len(ids) else 0
    return pack(codes[ids], size, at, total).tobytes(), at[::SEGMENT]


def decode_blocks(payloads: list[bytes], offsets: list[np.ndarray], counts: list[int], tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of all blocks, one after the other."""
    base = np.cumsum([0, *map(len, payloads)])[:-1] * 8
    starts = np.concatenate([o + b for o, b in zip(offsets, base, strict=True)])
    lengths = np.concatenate([np.minimum(SEGMENT, n - np.arange(0, n, SEGMENT)) for n in counts])
    return unpack(np.frombuffer(b"".join(payloads), np.uint8), starts, lengths, *tables)


def write(documents: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Writes the file to the shared folder; returns its tables ``code`` and ``blocks`` as read back."""
    ordered = ordered_ids(documents, path)
    sizes = code_sizes(id_counts(ordered))
    codes = canonical(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, waiting = 0, 0, 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            payload, offsets = encode_block(np.concatenate(held), sizes, codes)
            row = (part, first, docs, [len(x) for x in held], offsets, payload)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _BLOCK_TYPES, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for p, f, doc_id, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = _ids(raw)
                if held and (p != part or f != first + waiting or waiting + len(ids) > BLOCK):
                    yield flush()
                    docs, held, waiting = [], [], 0
                if not held:
                    part, first = p, f
                docs.append(doc_id)
                held.append(ids)
                waiting += len(ids)
        if held:
            yield flush()

    spark = documents.sparkSession
    written = stage(ordered.mapInArrow(run, BLOCKS), "huffman-blocks")
    used = np.flatnonzero(sizes)
    code = spark.createDataFrame([(int(i), int(sizes[i])) for i in used], "id int, size int").coalesce(1)
    return stage(code, "huffman-code"), written


def read(code: DataFrame, written: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, all from the file."""
    lengths = code.toArrow()
    sizes = np.zeros(max(lengths["id"].to_pylist(), default=0) + 1, np.int64)
    sizes[lengths["id"].to_numpy()] = lengths["size"].to_numpy()
    totals = {r["part"]: r["n"] for r in written.groupBy("part").agg(F.sum(F.expr("aggregate(counts, 0L, (a, x) -> a + x)")).alias("n")).collect()}
    before, base = 0, {}
    for part in sorted(totals):
        base[part] = before
        before += totals[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = lookup(sizes)
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                rows = batch.slice(at, GROUP).to_pydict()
                counts = [sum(c) for c in rows["counts"]]
                ids = decode_blocks(rows["payload"], [np.array(o, np.int64) for o in rows["offsets"]], counts, tables).astype("<u4")
                each = np.array([n for c in rows["counts"] for n in c], np.int64)
                ends = np.cumsum(each)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), each.tolist(), strict=True)]
                start = [s for p, f, c in zip(rows["part"], rows["first"], rows["counts"], strict=True) for s in (base[p] + f + np.cumsum([0, *c[:-1]])).tolist()]
                doc_ids = [d for ds in rows["doc_ids"] for d in ds]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (doc_ids, start, each, crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return written.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_huffman_tokens(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read(*write(documents, public_tokenizers.path("word_bpe_49k.json")))
