"""Windows over a stream of chunks with memory bounded by chunk and overlap."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from quillmask.functions.local import Span


@dataclass
class Window:
    """What a document's stream holds between chunks.

    ``context`` is text already given out, kept so that detectors see what stands before; ``held``
    waits for what follows it; ``base`` counts the characters given out.
    """

    overlap: int
    context: str = ""
    held: str = ""
    base: int = 0

    def _found(self, detect: Callable[[str], list[Span]]) -> list[Span]:
        lead, out = len(self.context), []
        for s in detect(self.context + self.held):
            if s.start >= lead:
                s.start, s.end = s.start - lead, s.end - lead
                out.append(s)
        return out

    def _give(self, upto: int, spans: list[Span]) -> tuple[int, str, list[Span]]:
        segment = self.held[:upto]
        given = (self.base, segment, [s for s in spans if s.end <= upto])
        self.context = (self.context + segment)[-self.overlap :] if self.overlap else ""
        self.held, self.base = self.held[upto:], self.base + upto
        return given

    def push(self, chunk: str, detect: Callable[[str], list[Span]]) -> tuple[int, str, list[Span]] | None:
        """Takes a chunk; gives (offset, segment, spans relative to it) once enough follows. An edge
        never cuts a span: it moves back to the span's start."""
        self.held += chunk
        upto = len(self.held) - self.overlap
        if upto <= 0:
            return None
        spans = self._found(detect)
        for s in spans:
            if s.start < upto < s.end:
                upto = s.start
        return self._give(upto, spans) if upto > 0 else None

    def finish(self, detect: Callable[[str], list[Span]]) -> tuple[int, str, list[Span]] | None:
        return self._give(len(self.held), self._found(detect)) if self.held else None


def segments(chunks: Iterable[str], detect: Callable[[str], list[Span]], overlap: int) -> Iterator[tuple[int, str, list[Span]]]:
    """(offset, segment, spans) of a whole stream; the segments add up to it."""
    if overlap < 0:
        raise ValueError("overlap must not be negative")
    return _segments(Window(overlap), chunks, detect)


def _segments(window: Window, chunks: Iterable[str], detect: Callable[[str], list[Span]]) -> Iterator[tuple[int, str, list[Span]]]:
    for chunk in chunks:
        if given := window.push(chunk, detect):
            yield given
    if given := window.finish(detect):
        yield given


