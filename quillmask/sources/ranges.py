"""Text files read and written in byte ranges, so one large file is the work of many tasks.

``quill_text`` is a Spark data source. Reading gives a row a range: ``path``, ``chunk_no`` from 0 on,
``text``, ``is_last``, ``at`` (the range's first byte); so a file is a table of chunks. A range ends after the first line end at or
behind its last byte; where ``LOOK`` bytes have none, between two characters. The edges follow from the file alone,
so ranges join without gap, whoever reads them, and texts are those of the whole file: bytes that are
not UTF-8 become U+FFFD as there, line ends become line feeds unless they are to be kept. Ranges are dealt
to tasks by size, largest first, so small files share a task and none holds much more than its part.

Writing takes ``path`` (the file's name), ``at`` (its byte), ``content`` (its bytes). Tasks write
their rows at their places in a hidden file beside the target, and report what they wrote; the commit
renames the file if all of its bytes were reported, the abort deletes it. A task that runs twice writes
the same bytes at the same places; until the commit there is no target.

Paths are those of a file system that the driver and all executors mount; tables and object stores go
through Spark's own readers.
"""

from __future__ import annotations

import heapq
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quillmask.functions.entities import Settings
from quillmask.operators.clusters import carried
from quillmask.session import ship_package, stage
from quillmask.streaming.chunks import redact_chunk_table

NAME = "quill_text"
SCHEMA = "path string, chunk_no long, text string, is_last boolean, at long"
WRITTEN = "path string, at long, content binary"
RANGE_BYTES = 8 << 20
#: Bytes behind an edge in which a line end is looked for; four at least, the most that a character has.
LOOK = 64 << 10


def local_path(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def edge(file, at: int, size: int) -> int:
    """The place of an edge near byte ``at``: after the first line end from the byte before on, else at the
    beginning of a character."""
    if at <= 0 or at >= size:
        return min(max(at, 0), size)
    file.seek(at - 1)
    seen = file.read(LOOK)
    line = seen.find(b"\n")
    if line >= 0:
        return at + line
    k = 1
    while k < min(len(seen), 4) and seen[k] & 0xC0 == 0x80:
        k += 1
    return at - 1 + k


def files_of(path: str) -> list[tuple[str, int]]:
    """The regular files at or below a path, in order, with their sizes."""
    if os.path.isfile(path):
        return [(path, os.path.getsize(path))]
    if not os.path.isdir(path):
        raise FileNotFoundError(path)
    found = [os.path.join(folder, name) for folder, _, names in os.walk(path) for name in names]
    return [(p, os.path.getsize(p)) for p in sorted(found) if os.path.isfile(p)]


@dataclass
class Share(InputPartition):
    """The ranges of a task: (path, number, first byte, last byte, size of the file)."""

    ranges: list[tuple[str, int, int, int, int]]


def shares(files: list[tuple[str, int]], range_bytes: int) -> list[Share]:
    """Ranges of the files, dealt largest first to the share that has the fewest bytes so far."""
    ranges = [(p, k, a, min(a + range_bytes, size), size) for p, size in files for k, a in enumerate(range(0, max(size, 1), range_bytes))]
    count = min(len(ranges), max(1, -(-sum(size for _, size in files) // range_bytes)))
    heap, dealt = [(0, i) for i in range(count)], [Share([]) for _ in range(count)]
    for r in sorted(ranges, key=lambda r: (r[2] - r[3], r)):
        held, i = heapq.heappop(heap)
        dealt[i].ranges.append(r)
        heapq.heappush(heap, (held + r[3] - r[2], i))
    return dealt


def decoded(raw: bytes, keep_newlines: bool) -> str:
    text = raw.decode("utf-8", "replace")
    return text if keep_newlines else text.replace("\r\n", "\n").replace("\r", "\n")


class TextSource(DataSource):
    """Options: path, rangeBytes, keepNewlines; for writing path, the folder that the files' names are of."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return TextReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TextWriter(self.options)


class TextReader(DataSourceReader):
    def __init__(self, options):
        self.path = local_path(options["path"])
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.keep = options.get("keepNewlines", "false").lower() == "true"

    def partitions(self) -> list[Share]:
        return shares(files_of(self.path), self.range_bytes)

    def read(self, partition: Share) -> Iterator[tuple]:
        for path, number, low, high, size in partition.ranges:
            with open(path, "rb") as file:
                first, last = edge(file, low, size), edge(file, high, size)
                if first < last or high == size:
                    file.seek(first)
                    yield path, number, decoded(file.read(last - first), self.keep), high == size, first


@dataclass
class Wrote(WriterCommitMessage):
    """Bytes written to each file."""

    sizes: dict[str, int]


class TextWriter(DataSourceWriter):
    def __init__(self, options):
        self.folder = local_path(options["path"])
        self.run = options.get("run", uuid.uuid4().hex)

    def _hidden(self, path: str) -> str:
        folder, name = os.path.split(os.path.join(self.folder, path))
        return os.path.join(folder, f".{name}.{self.run}.part")

    def write(self, iterator: Iterator) -> Wrote:
        sizes: dict[str, int] = {}
        path, out = None, None
        try:
            for row in iterator:
                if row.path != path:
                    if out is not None:
                        os.close(out)
                    path, hidden = row.path, self._hidden(row.path)
                    os.makedirs(os.path.dirname(hidden), exist_ok=True)
                    out = os.open(hidden, os.O_WRONLY | os.O_CREAT, 0o644)
                content, done = bytes(row.content), 0
                while done < len(content):
                    done += os.pwrite(out, content[done:], row.at + done)
                sizes[path] = sizes.get(path, 0) + len(content)
        finally:
            if out is not None:
                os.close(out)
        return Wrote(sizes)

    def commit(self, messages: list[Wrote | None]) -> None:
        total: dict[str, int] = {}
        for message in messages:
            for path, size in (message.sizes if message else {}).items():
                total[path] = total.get(path, 0) + size
        short = [p for p, size in total.items() if os.path.getsize(self._hidden(p)) != size]
        if short:
            self._delete()
            raise OSError(f"{short[0]} is not whole")
        for path in total:
            os.replace(self._hidden(path), os.path.join(self.folder, path))

    def abort(self, messages: list[Wrote | None]) -> None:
        self._delete()

    def _delete(self) -> None:
        ending = f".{self.run}.part"
        for folder, _, names in os.walk(self.folder):
            for name in names:
                if name.endswith(ending):
                    os.unlink(os.path.join(folder, name))


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(TextSource)


def read_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, keep_newlines: bool = False) -> DataFrame:
    """The ranges of a file, or of all files below a folder."""
    register(spark)
    return spark.read.format(NAME).option("rangeBytes", range_bytes).option("keepNewlines", str(keep_newlines).lower()).load(path)


def placed(pieces: DataFrame) -> DataFrame:
    """(path, at, content) of (path, seg_no, content): the bytes of a file before each piece, summed in
    blocks of pieces and over the blocks."""
    sized = pieces.select(F.struct("path").alias("key"), "seg_no", "content", F.octet_length("content").cast("long").alias("size"), F.floor(F.col("seg_no") / 1024).alias("block"))
    order = Window.partitionBy("key", "block").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, -1)
    summed = carried(sized.drop("content"), "key", "block", "size", "first", F.sum).withColumn("at", F.coalesce("first", F.lit(0)) + F.coalesce(F.sum("size").over(order), F.lit(0)))
    return sized.select("key", "seg_no", "content").join(summed.select("key", "seg_no", "at"), ["key", "seg_no"]).select("key.path", F.col("at").cast("long").alias("at"), "content")


def write_files(pieces: DataFrame, folder: str) -> None:
    """Writes (path, seg_no, content) as files below ``folder``; the pieces of a file add up to it. Pieces are
    staged, since their places are known only when all are made."""
    register(pieces.sparkSession)
    rows = placed(stage(pieces, "pieces")).sortWithinPartitions("path", "at")
    rows.write.format(NAME).option("run", uuid.uuid4().hex).mode("append").save(folder)


def redact_files(spark: SparkSession, source: str, target: str, settings: Settings, range_bytes: int = RANGE_BYTES, keep_newlines: bool = False) -> DataFrame:
    """Rewrites a file into the folder ``target``, or a folder of files, mirrored; gives input_path,
    output_path and bytes_written of each. Large files are read, searched and written by many tasks.

    Source and target must be apart (ValueError). The result is read from the written files' sizes.
    """
    source, target = local_path(source), local_path(target)
    root = source if os.path.isdir(source) else os.path.dirname(source)
    if os.path.realpath(root) == os.path.realpath(target) or os.path.realpath(target).startswith(os.path.realpath(source) + os.sep):
        raise ValueError(f"{source} cannot be redacted into itself")
    name = F.expr("substring(path, {0})".format(len(root.rstrip("/")) + 2))
    ranges = read_ranges(spark, source, range_bytes, keep_newlines)
    segments = redact_chunk_table(ranges.withColumn("doc_id", name), settings)
    # A file without text has no segments, and still is written.
    empty = ranges.filter("is_last").select(name.alias("path"), F.lit(-1).alias("seg_no"), F.lit("").alias("redacted"))
    pieces = segments.select(F.col("doc_id").alias("path"), "seg_no", "redacted").unionByName(empty)
    write_files(pieces.select("path", "seg_no", F.col("redacted").cast("binary").alias("content")), target)

    def sizes(batches):
        for frame in batches:
            yield frame.assign(bytes_written=[os.path.getsize(p) for p in frame["output_path"]])

    done = ranges.filter("is_last").select(F.col("path").alias("input_path"), F.concat(F.lit(target.rstrip("/") + "/"), name).alias("output_path"))
    return done.mapInPandas(sizes, "input_path string, output_path string, bytes_written long")
