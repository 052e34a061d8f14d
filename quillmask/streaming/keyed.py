"""Chunk streams through Structured Streaming: keyed state holds each document's window.

Input rows are (doc_id, chunk_no, text, is_last), ids of any atomic type. Chunks of a document may come
in any order within and across batches; a chunk ahead of its turn waits in a map state of its own entry,
so a trigger writes what came in it and not all that waits. A chunk seen before is dropped. The document
ends with ``is_last``; what is left of its state is a mark, by which replayed chunks are known and dropped.

With a timeout (processing time since a document's last input) what is held of a document without
``is_last`` is given out, its state is removed, and marks expire. Chunks wait as long as an earlier
one is missing, so without a timeout a document whose first chunk never comes stays in the state.
State is kept in RocksDB, which this kind of state needs: ``redact_chunks`` sets the session's provider.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillmask.functions.entities import SPAN_DDL, Settings
from quillmask.functions.local import Later, LocalEngine, Span, spliced
from quillmask.functions.netguard import offline
from quillmask.session import ship_package
from quillmask.streaming.windows import Window

SEGMENT = f"seg_no int, base_offset long, segment string, redacted string, detections array<{SPAN_DDL}>"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _row(doc_id, seg_no: int, given: tuple[int, str, list[Span]], engine: LocalEngine) -> Row:
    base, segment, spans = given
    found = [Row(start=s.start, end=s.end, text=s.text, entity_type=s.entity_type, confidence=float(s.confidence), source=s.source, meta=s.meta) for s in spans]
    return Row(doc_id=doc_id, seg_no=seg_no, base_offset=base, segment=segment, redacted=spliced(segment, spans, engine.settings.policy), detections=found)


class ChunkProcessor(StatefulProcessor):
    """A document's window, its waiting chunks by number, and the mark of one that has ended."""

    def __init__(self, settings: Settings, timeout_ms: int | None):
        self.settings, self.timeout_ms, self.engine_of = settings, timeout_ms, Later(settings)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "context string, held string, base long, turn long, seg_no int")
        self.waiting = handle.getMapState("waiting", "chunk_no long", "text string, is_last boolean")
        self.ended = handle.getValueState("ended", "at long", self.timeout_ms)

    def _next(self, came: dict[int, tuple[str, bool]], turn: int) -> tuple[str, bool] | None:
        if turn in came:
            return came.pop(turn)
        if not self.waiting.containsKey((turn,)):
            return None
        found = self.waiting.getValue((turn,))
        self.waiting.removeKey((turn,))
        return found[0], found[1]

    def _forget(self) -> None:
        self.window.clear()
        self.waiting.clear()
        for timer in list(self.handle.listTimers()) if self.timeout_ms else []:
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.ended.exists():
            return
        context, held, base, turn, seg_no = self.window.get() if self.window.exists() else ("", "", 0, 0, 0)
        came: dict[int, tuple[str, bool]] = {}
        for r in rows:
            if r.chunk_no is not None and r.chunk_no >= turn:
                came.setdefault(int(r.chunk_no), (r.text or "", bool(r.is_last)))
        engine, window, done = self.engine_of(), Window(self.settings.overlap, context, held, base), False
        with offline(self.settings.offline):
            while not done and (chunk := self._next(came, turn)) is not None:
                text, done = chunk
                turn += 1
                if given := window.push(text, engine.detect):
                    yield _row(key[0], seg_no, given, engine)
                    seg_no += 1
            if done and (given := window.finish(engine.detect)):
                yield _row(key[0], seg_no, given, engine)
        if done:
            self._forget()
            self.ended.update((turn,))
            return
        for number, chunk in came.items():
            if not self.waiting.containsKey((number,)):
                self.waiting.updateValue((number,), chunk)
        self.window.update((window.context, window.held, window.base, turn, seg_no))
        if self.timeout_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.window.exists():
            context, held, base, _, seg_no = self.window.get()
            engine = self.engine_of()
            with offline(self.settings.offline):
                given = Window(self.settings.overlap, context, held, base).finish(engine.detect)
            if given:
                yield _row(key[0], seg_no, given, engine)
        self.window.clear()
        self.waiting.clear()

    def close(self) -> None:
        pass


def redact_chunks(chunks: DataFrame, settings: Settings, timeout_ms: int | None = None) -> DataFrame:
    """Segments of every document, in order of ``seg_no``. For finished tables ``chunks.redact_chunk_table``
    shares a document among tasks."""
    ship_package(chunks.sparkSession)
    chunks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = chunks.schema["doc_id"].dataType.simpleString()
    processor = ChunkProcessor(settings, timeout_ms)
    return chunks.select("doc_id", "chunk_no", "text", "is_last").groupBy("doc_id").transformWithState(processor, f"doc_id {kind}, {SEGMENT}", "Append", "ProcessingTime" if timeout_ms else "None")
