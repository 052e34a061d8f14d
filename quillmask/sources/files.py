"""Text files, directory trees and standard input as sources and sinks.

A file is read as bounded chunks in the task that owns it, so memory does not grow with it. Bytes
that are not UTF-8 become U+FFFD; line ends become line feeds unless they are to be kept. Paths here
are those of a shared file system that every worker mounts; tables and object stores go through
Spark's own readers and ``Masker``.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import replace
from pathlib import Path
from typing import TextIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask.functions.entities import Settings
from quillmask.functions.local import LocalEngine, Span, spliced
from quillmask.functions.netguard import offline
from quillmask.session import ship_package
from quillmask.streaming.windows import segments

#: Memory that a worker process takes besides its text.
WORKER_BYTES = 96 << 20
RESULT = "input_path string, output_path string, bytes_written long"


def read_chunks(path: str | os.PathLike[str], chunk_size: int, encoding: str = "utf-8", keep_newlines: bool = False) -> Iterator[str]:
    with open(path, encoding=encoding, errors="replace", newline="" if keep_newlines else None) as file:
        while chunk := file.read(chunk_size):
            yield chunk


def redact_stream(chunks: Iterable[str], settings: Settings) -> Iterator[str]:
    engine = LocalEngine(settings)
    for _, segment, spans in segments(chunks, engine.detect, settings.overlap):
        yield spliced(segment, spans, settings.policy)


def detect_stream(chunks: Iterable[str], settings: Settings) -> Iterator[tuple[str, list[Span]]]:
    """(segment, detections) of a text that comes in chunks; the segments add up to it, and places count from
    the segment's start."""
    engine = LocalEngine(settings)
    for _, segment, spans in segments(chunks, engine.detect, settings.overlap):
        yield segment, spans


def span_stream(chunks: Iterable[str], settings: Settings) -> Iterator[Span]:
    """Its detections alone; places count from the text's start."""
    at = 0
    for segment, spans in detect_stream(chunks, settings):
        for s in spans:
            yield replace(s, start=at + s.start, end=at + s.end)
        at += len(segment)


def redact_file(source: str | os.PathLike[str], target: str | os.PathLike[str], settings: Settings, encoding: str = "utf-8", keep_newlines: bool = False) -> int:
    """Rewrites one file; returns the bytes written. The source is read while the target is written, so
    they must not be the same file (ValueError)."""
    if os.path.exists(target) and os.path.samefile(source, target):
        raise ValueError(f"{source} cannot be redacted into itself")
    Path(target).parent.mkdir(parents=True, exist_ok=True)
    with open(target, "w", encoding=encoding, newline="" if keep_newlines else None) as out:
        for piece in redact_stream(read_chunks(source, settings.chunk_size, encoding, keep_newlines), settings):
            out.write(piece)
    return os.path.getsize(target)


def read_texts(spark: SparkSession, path: str, keep_newlines: bool = False) -> DataFrame:
    """path and text, one whole file a row (so only for files that fit in one), through Spark's reader."""
    text = F.expr("make_valid_utf8(cast(content as string))")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", (text if keep_newlines else F.regexp_replace(text, "\r\n?", "\n")).alias("text"))


def workers(requested: int | None, cpus: int | None, available: int | None, settings: Settings) -> int:
    """Tasks at once: as asked for, at least 1; else as many as processors and memory allow."""
    if requested is not None:
        return max(1, requested)
    need = WORKER_BYTES + settings.chunk_size + settings.overlap
    fit = cpus or 1 if available is None else min(cpus or 1, available // need)
    return max(1, fit)


def available_memory() -> int | None:
    try:
        lines = Path("/proc/meminfo").read_text().splitlines()
    except OSError:
        return None
    found = [int(line.split()[1]) << 10 for line in lines if line.startswith("MemAvailable:")]
    return found[0] if found else None


def tree_jobs(source: str | os.PathLike[str], target: str | os.PathLike[str]) -> list[tuple[str, str]]:
    """(input, output) of every regular file below ``source``, by path; hidden files count."""
    root = Path(source)
    return [(str(p), str(Path(target) / p.relative_to(root))) for p in sorted(root.rglob("*")) if p.is_file()]


def redact_tree(spark: SparkSession, source: str, target: str, settings: Settings, tasks: int | None = None, encoding: str = "utf-8", guard: bool = True) -> DataFrame:
    """Rewrites a tree of files, mirrored below ``target``; a row a file, in order of path.

    Files are written when this is called, each by one task (``ranges.redact_files`` shares large ones); a
    task run twice writes the same files again.
    """
    ship_package(spark)
    jobs = tree_jobs(source, target)
    paths = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(jobs)], "n int, input_path string, output_path string")
    count = min(len(jobs), workers(tasks, spark.sparkContext.defaultParallelism, None, settings)) or 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with offline(guard):
            for frame in frames:
                done = [redact_file(a, b, settings, encoding) for a, b in zip(frame["input_path"], frame["output_path"], strict=True)]
                yield frame.assign(bytes_written=pd.Series(done, index=frame.index, dtype="int64"))

    done = paths.repartition(count).mapInPandas(run, f"n int, {RESULT}").collect()  # one short row a file
    rows = [(r["input_path"], r["output_path"], r["bytes_written"]) for r in sorted(done, key=lambda r: r["n"])]
    return spark.createDataFrame(rows, RESULT)


def stdin_chunks(stream: TextIO, chunk_size: int) -> Iterator[str]:
    while chunk := stream.read(chunk_size):
        yield chunk


def json_line() -> Column:
    """A detection as JSON: type, start, end, text, confidence to 3 places, source."""
    return F.to_json(F.struct(F.col("entity_type").alias("type"), "start", "end", "text", F.round("confidence", 3).alias("confidence"), "source"))


def text_line() -> Column:
    """A detection as a readable line."""
    return F.format_string("%13s  conf=%.2f  '%s'", "entity_type", "confidence", "text")


def listing_json(spans: DataFrame) -> DataFrame:
    """One JSON text a detection."""
    return spans.select(json_line().alias("value"))


def listing_text(spans: DataFrame) -> DataFrame:
    """One readable line a detection."""
    return spans.select(text_line().alias("value"))
