"""Vectorised words and word hashes over batches of whole texts.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D of the UTF-8 text. Hashes are 64 bits,
depend on the word's bytes alone and agree between processes.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LONG_WORD = 256
ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Words:
    """The words of a list of texts: byte offsets, and per document its first word and word count.

    ``lower`` turns A-Z to a-z first; ``breaks`` marks the bytes between words (a line feed among them).
    """

    def __init__(self, texts: list[bytes], lower: bool = False, breaks: np.ndarray = SPACE):
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.data = b"\n".join(texts) + b"\n" + bytes(8)
        raw = np.frombuffer(self.data, np.uint8)
        if lower:
            raw = LOWER[raw]
            self.data = raw.tobytes()
        space = breaks[raw[: len(raw) - 8]]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc_first = np.searchsorted(self.start, np.cumsum(sizes) - sizes)
        self.count = np.diff(np.append(self.doc_first, len(self.start)))
        self.doc_byte = np.cumsum(sizes) - sizes

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        size = self.end - self.start
        eight = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        h = mix(size.astype(U64) * U64(ODD))
        at, left = self.start.copy(), size.copy()
        live = np.flatnonzero(size <= LONG_WORD)
        while len(live):
            n = np.minimum(left[live], 8)
            value = eight[at[live]] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - U64(8) * n.astype(U64)))
            h[live] = mix((h[live] ^ value) * U64(ODD) + value)
            at[live] += 8
            left[live] -= 8
            live = live[left[live] > 0]
        for i in np.flatnonzero(size > LONG_WORD):
            digest = hashlib.blake2b(self.data[self.start[i] : self.end[i]], digest_size=8).digest()
            h[i] = int.from_bytes(digest, "little")
        return h


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = np.full(n + 1, ODD, U64), np.full(n + 1, pow(ODD, -1, 1 << 64), U64)
    base[0] = inverse[0] = 1
    return np.cumprod(base, dtype=U64), np.cumprod(inverse, dtype=U64)


def runs(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of every ``length`` consecutive values of ``h``, by prefix sums; one per starting place."""
    if len(h) < length:
        return np.empty(0, U64)
    up, down = _powers(1 << int(len(h)).bit_length())
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(h * up[: len(h)], dtype=U64, out=total[1:])
    return mix((total[length:] - total[:-length]) * down[: len(h) - length + 1])


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def give_back() -> None:
    """Returns what this process has freed to the system; Arrow and the C library keep it in reserve otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts hold about ``limit`` bytes; a longer text is a slice of its own.
    Only a slice's texts are copied out of Arrow, and between batches freed memory goes back to the
    system, since workers live on from task to task."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        first, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(first, i - first), as_bytes(texts.slice(first, i - first))
                first, held = i, 0
            held += n
        if len(sizes) > first:
            yield batch.slice(first), as_bytes(texts.slice(first))
        del batch, texts
        give_back()
