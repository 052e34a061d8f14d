"""Packing and reading of variable-length codes of at most 16 bits, whole arrays at a time."""

from __future__ import annotations

import numpy as np


def pack(code: np.ndarray, size: np.ndarray, at: np.ndarray, total: int) -> np.ndarray:
    """Bytes in which ``code[i]``, ``size[i]`` bits long, stands at bit ``at[i]`` (most significant
    bit first). ``at`` ascends without overlap or gap; ``total`` is the number of bytes."""
    words = np.zeros(total // 4 + 3, np.uint32)
    if len(code):
        word = at >> 5
        value = code.astype(np.uint64) << (np.uint64(64) - (size + (at & 31)).astype(np.uint64))
        value[size == 0] = 0
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        last = np.append(first[1:], len(word)) - 1
        words[word[first]] = np.add.reduceat(value >> np.uint64(32), first).astype(np.uint32)
        words[word[last] + 1] |= (value[last] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return words.astype(">u4").view(np.uint8)[:total]


def unpack(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, table: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Decodes ``counts[i]`` codes from each bit ``starts[i]``, all places in step.

    ``table`` and ``sizes`` give the symbol and the bits it takes for each value of the next 16 bits.
    Returns the symbols of the first place, then those of the second, and so on.
    """
    padded = np.concatenate((data, np.zeros(4, np.uint8))).astype(np.uint32)
    three = padded[:-2] << np.uint32(16) | padded[1:-1] << np.uint32(8) | padded[2:]
    order = np.argsort(-counts, kind="stable")
    at, most = starts[order].astype(np.int64), int(counts.max()) if len(counts) else 0
    live = np.searchsorted(-counts[order], -np.arange(most), "left")
    out_at = (np.cumsum(counts) - counts)[order]
    out = np.empty(int(counts.sum()), table.dtype)
    for step in range(most):
        n = live[step]
        here = at[:n]
        peek = (three[here >> 3] >> (np.uint32(8) - (here & 7).astype(np.uint32))) & np.uint32(0xFFFF)
        out[out_at[:n] + step] = table[peek]
        at[:n] += sizes[peek]
    return out


def canonical(sizes: np.ndarray) -> np.ndarray:
    """Codes of the canonical prefix code with these lengths (0: no code), by length, then symbol."""
    codes = np.zeros(len(sizes), np.uint32)
    order = np.lexsort((np.arange(len(sizes)), sizes))
    order = order[sizes[order] > 0]
    share = np.uint64(1) << (np.uint64(16) - sizes[order].astype(np.uint64))
    codes[order] = ((np.cumsum(share) - share) >> (np.uint64(16) - sizes[order].astype(np.uint64))).astype(np.uint32)
    return codes


def lookup(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit value, the symbol whose code it begins with and that code's length."""
    order = np.lexsort((np.arange(len(sizes)), sizes))
    order = order[sizes[order] > 0]
    share = 1 << (16 - sizes[order].astype(np.int64))
    symbol, size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)
    used = int(share.sum())
    symbol[:used] = np.repeat(order, share)
    size[:used] = np.repeat(sizes[order].astype(np.int64), share)
    return symbol, size
