"""Operator 3: substring dedup by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words. Its minimiser is the least hash of the ``MINI``-word runs in
it; consecutive windows that share a minimiser form a super-k-mer. Equal windows have equal
minimisers, so only minimisers met in two documents matter: their super-k-mers travel as one packed
string each to the minimiser's bucket. Equal strings are one row there, with the least document that
has it; among the different strings of a bucket, sorting the windows finds the least document of each
window exactly. A bucket with more than ``BUCKET`` strings or ``BUCKET_BYTES`` bytes is not gathered: its
windows are aggregated by their digests over all tasks. (A text that repeats one word is one such string.)

A word goes if a window that covers it also starts in a document with a smaller doc_id. Null texts
have no words; rows without a doc_id lose nothing; rows with equal ids and texts are one document; rows
with equal ids and different texts are each cut by themselves and take nothing from each other; an empty
table gives an empty result; other columns are not read. A text is worked on whole, with some 30 bytes of
arrays for each of its bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm.staging import partitions, stage, table
from quillmask.llm.words import Words, as_bytes, blocks, runs

WINDOW, MINI = 50, 12
#: Most strings, and bytes of them, of one bucket that a task gathers; sorting holds its windows, 50 times the bytes.
BUCKET, BUCKET_BYTES = 2000, 1 << 20
#: Windows whose digests leave a task together.
DIGESTS = 1 << 15

GAPS = re.compile(rb"[\x20\x09-\x0D]+")

#: A document: its id and 64 bits of its text's hash, for ids that several texts share.
ROW = ["doc_id", "text_key"]
SCANNED = "doc_id long, text_key long, n_words long, kept_sha256 string, keys array<long>, starts array<int>, windows array<int>"


def super_kmers(texts: list[bytes], window: int = WINDOW, mini: int = MINI) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word counts, then by super-k-mer: text, minimiser, first window, number of windows)."""
    words = Words(texts)
    h = runs(words.hashes(), mini)
    span = window - mini + 1
    reach, low = 1, h
    while 2 * reach <= span and len(low) > reach:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if len(h) < span:
        empty = np.empty(0, np.int64)
        return words.count, empty, np.empty(0, np.uint64), empty, empty
    low = np.minimum(low[: len(h) - span + 1], low[span - reach :]) if span > reach else low
    text = words.docs()
    at = np.flatnonzero(text[: len(low)] == text[window - 1 : window - 1 + len(low)])
    low, text = low[at], text[at]
    new = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (text[1:] != text[:-1])))) if len(at) else np.empty(0, np.int64)
    return words.count, text[new], low[new], at[new] - words.doc_first[text[new]], np.diff(np.append(new, len(at)))


def scan(documents: DataFrame) -> DataFrame:
    """Per document: its words, the digest of all of them, and its super-k-mers' minimisers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            count, text, key, start, n = super_kmers(texts)
            cut = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32))
            whole = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts]
            lists = [pa.ListArray.from_arrays(cut, pa.array(v)) for v in (key.view(np.int64), start.astype(np.int32), n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(count.astype(np.int64)), pa.array(whole), *lists], [c.split()[0] for c in SCANNED.split(", ")])

    return _rows(documents).mapInArrow(run, SCANNED)


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))


def _packed(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """(doc_id, text_key, minimiser, first window, windows, packed string) of (doc_id, text_key, text, hits)."""
    for i in range(batch.num_rows):
        (doc_id, text_key, hits), (text,) = (batch.column(c)[i].as_py() for c in (0, 1, 3)), as_bytes(batch.column(2).slice(i, 1))
        words = Words([text])
        for hit in hits:
            first, last = hit["start"], hit["start"] + hit["windows"] + WINDOW - 2
            yield doc_id, text_key, hit["key"], first, hit["windows"], GAPS.sub(b" ", text[words.start[first] : words.end[last]])


def _windows(packed: bytes) -> Iterator[bytes]:
    """The windows of a packed string, as slices of it, one at a time."""
    gap = np.flatnonzero(np.frombuffer(packed, np.uint8) == 32)
    first, last = np.append(0, gap + 1), np.append(gap, len(packed))[WINDOW - 1 :]
    for at in range(0, len(last), DIGESTS):
        for a, b in zip(first[at : at + DIGESTS].tolist(), last[at : at + DIGESTS].tolist(), strict=False):
            yield packed[a:b]


def _digest(packed: bytes) -> bytes:
    return hashlib.blake2b(packed, digest_size=16).digest()


COVERED = "digest binary, least long, covered array<int>"


def _bucket(rows: list[tuple[bytes, int]]) -> list[tuple[bytes, int, list[int]]]:
    """For the different strings of a bucket, each with its least document: the windows that a
    smaller document has."""
    covered: list[list[int]] = [[] for _ in rows]
    if len(rows) > 1:
        every = sorted((w, least, i, j) for i, (packed, least) in enumerate(rows) for j, w in enumerate(_windows(packed)))
        for _, same in groupby(every, key=lambda r: r[0]):
            lowest = None
            for _, least, i, j in same:
                lowest = least if lowest is None else lowest
                if least > lowest:
                    covered[i].append(j)
    return [(_digest(p), least, c) for (p, least), c in zip(rows, covered, strict=True)]


def gathered(strings: DataFrame) -> DataFrame:
    """(key, packed, least), at most ``BUCKET`` rows a key, to ``COVERED``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def emit() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.list_(pa.int32())), strict=True)], ["digest", "least", "covered"])

        for batch in batches:
            for k, packed, least in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if k != key:
                    out += _bucket(held)
                    key, held = k, []
                held.append((packed, least))
            yield emit()
            out = []
        out += _bucket(held)
        yield emit()

    spark = strings.sparkSession
    return strings.select("key", "packed", "least").repartition(partitions(spark), "key").sortWithinPartitions("key").mapInArrow(run, COVERED)


def spread(strings: DataFrame) -> DataFrame:
    """The same for keys with more strings: windows meet by their digests, combined before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["digest", "least", "j", "w"])

        for batch in batches:
            for i in range(batch.num_rows):
                (packed,), least = as_bytes(batch.column(0).slice(i, 1)), batch.column(1)[i].as_py()
                own = _digest(packed)
                for j, window in enumerate(_windows(packed)):
                    rows.append((own, least, j, _digest(window)))
                    if len(rows) == DIGESTS:
                        yield flush()
        yield flush()

    cut = stage(strings.select("packed", "least").mapInArrow(run, "digest binary, least long, j int, w binary"), "windows")
    lowest = cut.groupBy("w").agg(F.min("least").alias("lowest"), F.max("least").alias("top")).filter("lowest < top").select("w", "lowest")
    hit = cut.join(lowest, "w").filter("least > lowest").groupBy("digest").agg(F.collect_list("j").alias("covered"))
    return cut.select("digest", "least").distinct().join(hit, "digest", "left").select("digest", "least", F.coalesce("covered", F.array().cast("array<int>")).alias("covered"))


def repeats(documents: DataFrame, scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts that share a minimiser with another document, and the word ranges that go from them."""
    flat = scanned.filter("doc_id is not null and size(keys) > 0").select(*ROW, F.explode(F.arrays_zip("keys", "starts", "windows")).alias("s"))
    flat = flat.select(*ROW, F.col("s.keys").alias("key"), F.col("s.starts").alias("start"), F.col("s.windows").alias("windows"))
    shared = flat.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("key")
    hits = flat.join(shared, "key").groupBy(*ROW).agg(F.collect_set(F.struct("key", "start", "windows")).alias("hits"))
    base = _rows(documents).filter("text is not null").join(hits, ROW)
    held = stage(base.select(*ROW, "text", "hits"), "shared")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = [(key, packed, doc_id) for doc_id, _, key, _, _, packed in _packed(batch.slice(at, 256))]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()).cast(pa.string()), pa.array(cols[2], pa.int64())], ["key", "packed", "doc_id"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = [(_digest(packed), doc_id, text_key, start, n) for doc_id, text_key, _, start, n, packed in _packed(batch.slice(at, 256))]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["digest", *ROW, "start", "n"])

    strings = stage(held.mapInArrow(pack, "key long, packed string, doc_id long").groupBy("key", "packed").agg(F.min("doc_id").alias("least")), "strings")
    held_in = strings.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("packed")).alias("bytes"))
    crowded = stage(held_in.filter((F.col("n") > BUCKET) | (F.col("bytes") > BUCKET_BYTES)).select("key"), "crowded")
    covered = gathered(strings.join(crowded, "key", "left_anti")).unionByName(spread(strings.join(crowded, "key", "left_semi")))
    met = held.mapInArrow(place, "digest binary, doc_id long, text_key long, start int, n int").join(covered, "digest")
    whole = F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n") + WINDOW - 1).alias("b")))
    some = F.transform("covered", lambda j: F.struct((F.col("start") + j).alias("a"), (F.col("start") + j + WINDOW).alias("b")))
    ranges = met.select(*ROW, F.when(F.col("doc_id") > F.col("least"), whole).otherwise(some).alias("ranges")).filter("size(ranges) > 0")
    return held.select(*ROW, "text"), ranges.groupBy(*ROW).agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


KEPT = "doc_id long, text_key long, n_removed long, kept_sha256 string, kept string"


def kept_words(held: DataFrame, ranges: DataFrame, with_text: bool = False) -> DataFrame:
    """What is left of the texts that lose words; ``kept`` is filled on request."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text_key, text, cut in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                words = text.split()
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, [r["a"] for r in cut], 1)
                np.add.at(edge, [r["b"] for r in cut], -1)
                stays = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                left = b" ".join(map(words.__getitem__, stays.tolist()))
                rows.append((doc_id, text_key, len(words) - len(stays), hashlib.sha256(left).hexdigest(), left.decode() if with_text else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], [*ROW, "n_removed", "kept_sha256", "kept"])

    return held.join(ranges, ROW).select(*ROW, "text", "ranges").mapInArrow(run, KEPT)


def substring_dedup(documents: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and with text the kept words of documents that lost some."""
    scanned = stage(scan(documents), "scanned")
    less = kept_words(*repeats(documents, scanned), with_text).dropDuplicates(ROW).select(*ROW, "n_removed", F.col("kept_sha256").alias("sha"), "kept")
    result = scanned.select(*ROW, "n_words", "kept_sha256").join(less, ROW, "left")
    return result.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("sha", "kept_sha256").alias("kept_sha256"), *["kept"] * with_text)


def op3_substring_dedup(spark, sf_dir) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d),
k AS (SELECT doc_id, pos, md5(array_to_string(w[pos : pos + 49], ' ')) AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS pos FROM d WHERE len(w) >= 50)),
f AS (SELECT key, min(doc_id) AS first_doc FROM k GROUP BY key HAVING min(doc_id) < max(doc_id)),
b AS (SELECT k.doc_id, k.pos FROM k JOIN f ON k.key = f.key AND k.doc_id > f.first_doc),
c AS (SELECT p.doc_id, p.pos, p.word, max(b.pos) OVER (PARTITION BY p.doc_id ORDER BY p.pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
      FROM p LEFT JOIN b ON p.doc_id = b.doc_id AND p.pos = b.pos),
r AS (SELECT doc_id, count(*) AS n_words, count(gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (gone IS NULL) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""
