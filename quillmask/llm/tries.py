"""Operator 12: exact dedup by the owners of Patricia tries.

Equal texts have the same length and content hash, so those two deal the texts to partitions. Each
partition puts its texts, as whole byte strings, in a compressed radix trie; a text ends at a terminal
node, which keeps the smallest key of its rows and their number. Before the shuffle each task counts
its equal texts together, so a text of any number of copies is a few rows a task.

A trie that holds more than ``LIMIT`` bytes spills its largest subtree: the texts in it, and those
that come to it later, go to the next round, dealt by their subtree to partitions of their own. A
round settles all texts of the rest of the trie, so rounds end; a text longer than the limit is a trie
of its own, and texts that are beginnings of a spilled one stay, which is no more than its own length.

The key is the doc_id, or its complement where the largest is to stay. Null texts count as empty;
a row without a doc_id stays only where no row of its text has one. Rows that share id and text are one
document: both are kept or neither. An empty table gives an empty result; other columns pass through
``deduplicated`` and are not read elsewhere.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.llm.staging import free_name, partitions, stage, table
from quillmask.llm.words import as_bytes, blocks

#: Bytes of text in a trie before it spills, in a task's share of the shuffle, and counted together before it.
LIMIT, SHARE, HELD = 96 << 20, 32 << 20, 24 << 20
#: Bytes of an Arrow batch that goes on to Spark.
BATCH = 2 << 20


def smaller(a: int | None, b: int | None) -> int | None:
    """The smaller key; none is larger than any."""
    return b if a is None else a if b is None else min(a, b)


class Node:
    """The bytes on the way from its parent, its children by their first byte, and the owner of the text
    that ends here: [key, rows]. ``spilled`` names the subtree that went to the next round."""

    __slots__ = ("edge", "children", "owner", "spilled")

    def __init__(self, edge: bytes):
        self.edge, self.children, self.owner, self.spilled = edge, {}, None, None


def common(edge: bytes, data: bytes, at: int) -> int:
    """The number of bytes in which ``edge`` and ``data`` from ``at`` on agree."""
    low, high = 0, min(len(edge), len(data) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if edge[low:middle] == data[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """``salt`` tells the subtrees of this trie from those of others."""

    def __init__(self, limit: int = LIMIT, salt: bytes = b""):
        self.root, self.limit, self.salt, self.held, self.texts = Node(b""), limit, salt, 0, 0

    def insert(self, data: bytes, key: int | None, rows: int) -> bytes | None:
        """Adds rows of a text; the name of the spilled subtree if it belongs to one."""
        node, at = self.root, 0
        while node.spilled is None:
            if at == len(data):
                if node.owner is None:
                    node.owner = [key, rows]
                    self.texts += 1
                else:
                    node.owner[0] = smaller(node.owner[0], key)
                    node.owner[1] += rows
                return None
            child = node.children.get(data[at])
            if child is None:
                child = node.children[data[at]] = Node(data[at:])
                self.held += len(child.edge)
            elif not data.startswith(child.edge, at):
                k = common(child.edge, data, at)
                upper = node.children[data[at]] = Node(child.edge[:k])
                child.edge = child.edge[k:]
                upper.children[child.edge[0]] = child
                child = upper
            node, at = child, at + len(child.edge)
        return node.spilled

    def under(self, node: Node, path: bytes) -> Iterator[tuple[bytes, list]]:
        """The texts that end in a node or below it, with their owners."""
        waiting = [(node, path)]
        while waiting:
            node, path = waiting.pop()
            if node.owner is not None:
                yield path, node.owner
            waiting += [(c, path + c.edge) for c in node.children.values()]

    def _largest(self) -> tuple[Node, bytes, int] | None:
        """The largest subtree with nothing spilled below it that leaves a text in the trie; its node, the
        bytes above it and its size. A spilled subtree keeps its name only while nothing above it goes too."""
        order, waiting = [], [(self.root, None)]
        while waiting:
            node, parent = waiting.pop()
            order.append((node, parent))
            waiting += [(c, node) for c in node.children.values()]
        size, texts, whole, above = {}, {}, {}, {}
        for node, parent in reversed(order):
            size[node] = len(node.edge) + sum(size[c] for c in node.children.values())
            texts[node] = (node.owner is not None) + sum(texts[c] for c in node.children.values())
            whole[node] = node.spilled is None and all(whole[c] for c in node.children.values())
            above[node] = parent
        tops = [n for n, parent in order if whole[n] and texts[n] and (parent is None or not whole[parent])]
        if not tops:
            return None
        node = max(tops, key=size.get)
        while texts[node] == self.texts:
            node = max(node.children.values(), key=size.get)
        path, up = b"", above[node]
        while up is not None:
            path, up = up.edge + path, above[up]
        return node, path, size[node]

    def spill(self) -> Iterator[tuple[bytes, bytes, list]]:
        """While the trie is over its limit: (subtree, text, owner) of its largest subtrees."""
        while self.held > self.limit and self.texts > 1:
            found = self._largest()
            if found is None:
                return
            node, path, size = found
            first = node.edge[:1]  # no other text here begins so
            name = hashlib.blake2b(path + first, digest_size=8, key=self.salt).digest()
            self.held -= size - 1
            out = list(self.under(node, path + node.edge))
            self.texts -= len(out)
            node.edge, node.children, node.owner, node.spilled = first, {}, None, name
            for text, owner in out:
                yield name, text, owner


COUNTED = "text binary, key long, n long"
SETTLED = "n_bytes long, digest binary, key long, n long, subtree binary, text binary"


def _counted(documents: DataFrame, key: Column) -> DataFrame:
    """(text, key, n): equal texts of a task are counted together, while they hold ``HELD`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            size = 0
            for text, (key, n) in seen.items():
                rows.append((text, key, n))
                size += len(text)
                if size > BATCH:
                    yield _batch(rows, COUNTED)
                    rows, size = [], 0
            yield _batch(rows, COUNTED)

        for part, texts in blocks(batches):
            for text, key in zip(texts, part.column(0).to_pylist(), strict=True):
                found = seen.get(text)
                if found is None:
                    seen[text] = [key, 1]
                    held += len(text)
                else:
                    found[0] = smaller(found[0], key)
                    found[1] += 1
            if held > HELD:
                yield from flush()
                seen, held = {}, 0
        yield from flush()

    return documents.select(key.alias("key"), "text").mapInArrow(run, COUNTED)


_TYPES = {"binary": pa.binary(), "long": pa.int64()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def _settled(dealt: DataFrame, limit: int) -> DataFrame:
    """A trie a partition: owners (text null), and texts of spilled subtrees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(limit, str(TaskContext.get().partitionId()).encode())
        for batch in batches:
            rows, size = [], 0
            columns = [batch.column(i) for i in range(3)]
            for at in range(0, batch.num_rows, 64):
                texts, keys, counts = as_bytes(columns[0].slice(at, 64)), columns[1].slice(at, 64).to_pylist(), columns[2].slice(at, 64).to_pylist()
                for text, key, n in zip(texts, keys, counts, strict=True):
                    subtree = trie.insert(text, key, n)
                    if subtree is not None:
                        rows.append((len(text), None, key, n, subtree, text))
                        size += len(text)
                    elif trie.held > limit:
                        for name, spilled, (least, m) in trie.spill():
                            rows.append((len(spilled), None, least, m, name, spilled))
                            size += len(spilled)
                            if size > BATCH:
                                yield _batch(rows, SETTLED)
                                rows, size = [], 0
                    if size > BATCH:
                        yield _batch(rows, SETTLED)
                        rows, size = [], 0
            yield _batch(rows, SETTLED)
        rows = []
        for text, (key, n) in trie.under(trie.root, b""):
            rows.append((len(text), hashlib.sha256(text).digest(), key, n, None, None))
            if len(rows) == 10_000:
                yield _batch(rows, SETTLED)
                rows = []
        yield _batch(rows, SETTLED)

    return dealt.mapInArrow(run, SETTLED)


def _tasks(frame: DataFrame) -> int:
    total = frame.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(partitions(frame.sparkSession), math.ceil(total / SHARE))


def owners(documents: DataFrame, largest: bool = False, limit: int = LIMIT) -> DataFrame:
    """(n_bytes, digest, keep_id, group_size) of every different text; ``digest`` is its SHA-256."""
    key = F.col("doc_id").cast("long")
    given = documents.select(F.bitwise_not(key).alias("doc_id") if largest else key.alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    waiting = _counted(given, F.col("doc_id")).repartition(_tasks(given), F.octet_length("text"), F.xxhash64("text"))
    found = []
    while True:
        done = stage(_settled(waiting, limit), "owners")
        found.append(done.filter("text is null").select("n_bytes", "digest", "key", F.col("n").alias("group_size")))
        spilled = done.filter("text is not null").select("subtree", "text", "key", "n")
        if not spilled.limit(1).count():
            break
        waiting = spilled.repartition(_tasks(spilled), "subtree").select("text", "key", "n")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.select("n_bytes", "digest", (F.bitwise_not("key") if largest else F.col("key")).alias("keep_id"), "group_size")


def exact_groups(documents: DataFrame, largest: bool = False, limit: int = LIMIT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row. Documents meet their text's owner by
    length and digest; the rows of a text of many copies are what Spark's skew handling splits."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest"))
    joined = rows.join(owners(documents, largest, limit), ["n_bytes", "digest"])
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(documents: DataFrame, largest: bool = False, limit: int = LIMIT) -> DataFrame:
    """The documents of which the owner stays, with all their columns."""
    lead = free_name(documents.columns, "owner")
    size, digest, keep = (free_name(documents.columns, f"{lead}_{c}") for c in ("n_bytes", "digest", "keep_id"))
    text = F.coalesce("text", F.lit(""))
    held = owners(documents, largest, limit).select(F.col("n_bytes").alias(size), F.col("digest").alias(digest), F.col("keep_id").alias(keep))
    rows = documents.join(held, (F.octet_length(text) == held[size]) & (F.unhex(F.sha2(text, 256)) == held[digest]) & F.col("doc_id").cast("long").eqNullSafe(held[keep]))
    return rows.select(*[documents[c] for c in documents.columns])


def op12_exact_dedup(spark, sf_dir) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), largest=True)


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
