"""Operator 9: media columns as AVI motion-JPEG.

A payload becomes frames of 24 by 24 samples of 8 bits. Each frame is a lossless JPEG (process 14:
the left sample, or in the first column the one above, predicts; the differences are Huffman coded),
so what is read back is what was stored, bit for bit. The file is a RIFF form ``AVI `` with one
video stream and an ``idx1`` index. Reading parses the index, then each frame's markers, then decodes
all frames of a batch in step.

Shots end where the difference of two frames' histograms passes a bound that adapts to the differences
before it; a clip is a shot with its times. Null texts count as empty; an empty text is one frame of
padding; repeated rows give equal rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm.bits import canonical, lookup, pack, unpack
from quillmask.llm.staging import table
from quillmask.llm.words import blocks

SIDE = 24
FRAME = SIDE * SIDE
PAD = 255
RATE = 25
BINS = 16
#: A cut: a difference beyond MEAN + SPREAD deviations of the WINDOW differences before it, and FLOOR.
WINDOW, SPREAD, FLOOR = 8, 3.0, 0.15
#: Bits of the code of each size category 0-8 of a difference; size and extra bits fit in 16 bits.
CATEGORY_BITS = np.array([5, 5, 5, 4, 3, 2, 2, 3, 5])

_SIZE = np.array([abs(d).bit_length() for d in range(-255, 256)])
_CODE = canonical(CATEGORY_BITS)[_SIZE].astype(np.int64)
_EXTRA = np.array([d if d >= 0 else d + (1 << abs(d).bit_length()) - 1 for d in range(-255, 256)])
#: Code and length of each difference from -255 on, extra bits included.
DIFF_CODE = (_CODE << _SIZE | _EXTRA).astype(np.uint32)
DIFF_BITS = (CATEGORY_BITS[_SIZE] + _SIZE).astype(np.int64)


def _diff_table() -> tuple[np.ndarray, np.ndarray]:
    """Difference and length for each value of the next 16 bits."""
    diff, bits = np.zeros(1 << 16, np.int16), np.zeros(1 << 16, np.int64)
    category, size = lookup(CATEGORY_BITS)
    value = np.arange(1 << 16)
    extra = value >> np.maximum(16 - size - category, 0) & ((1 << category.astype(np.int64)) - 1)
    low = extra < (1 << np.maximum(category.astype(np.int64) - 1, 0))
    diff[:] = np.where(category == 0, 0, np.where(low, extra - (1 << category.astype(np.int64)) + 1, extra))
    bits[:] = size + category
    bits[size == 0] = 16
    return diff, bits


DIFFS, DIFF_SIZES = _diff_table()


def _marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _head() -> bytes:
    by_size = [int((CATEGORY_BITS == n).sum()) for n in range(1, 17)]
    order = np.lexsort((np.arange(9), CATEGORY_BITS))
    table_ = bytes([0, *by_size, *order.tolist()])
    start = struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0)
    scan = bytes([1, 1, 0, 1, 0, 0])  # one component, table 0, predictor 1 (left), no point transform
    return b"\xff\xd8" + _marker(0xC4, table_) + _marker(0xC3, start) + _marker(0xDA, scan)


HEAD, TAIL = _head(), b"\xff\xd9"


def predicted(samples: np.ndarray) -> np.ndarray:
    """What each sample is predicted as: left, above in the first column, 128 at the start."""
    frames = samples.reshape(-1, SIDE, SIDE)
    out = np.empty(frames.shape, np.int16)
    out[:, :, 1:] = frames[:, :, :-1]
    out[:, 1:, 0] = frames[:, :-1, 0]
    out[:, 0, 0] = 128
    return out.reshape(-1, FRAME)


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """A JPEG for each row of ``FRAME`` samples."""
    step = (samples.astype(np.int16) - predicted(samples)) + 255
    bits = np.zeros((len(step), FRAME + 1), np.int64)
    bits[:, :FRAME] = DIFF_BITS[step]
    used = bits.sum(axis=1)
    fill = -used % 8
    bits[:, FRAME] = fill
    code = np.empty(bits.shape, np.uint32)
    code[:, :FRAME] = DIFF_CODE[step]
    code[:, FRAME] = (1 << fill) - 1
    bits, code = bits.ravel(), code.ravel()
    sizes = (used + fill) >> 3
    raw = pack(code, bits, np.cumsum(bits) - bits, int(sizes.sum()))
    full = raw == 255
    shift = np.cumsum(full)
    stuffed = np.zeros(len(raw) + int(shift[-1]), np.uint8)
    stuffed[np.arange(len(raw)) + shift - full] = raw
    ends = np.cumsum(sizes)
    ends = ends + shift[ends - 1]
    data, starts = stuffed.tobytes(), np.concatenate(([0], ends[:-1]))
    return [HEAD + data[a:b] + TAIL for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def scan_of(frame: bytes) -> bytes:
    """Entropy-coded bytes of a frame of this format; its markers are parsed."""
    if frame.startswith(HEAD) and frame.endswith(TAIL):
        return frame[len(HEAD) : -2]
    at = 2
    if frame[:2] != b"\xff\xd8":
        raise ValueError("a frame does not begin with SOI")
    while frame[at] == 0xFF:
        kind, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body = frame[at + 4 : at + 2 + size]
        if kind == 0xC3 and body[:5] != struct.pack(">BHH", 8, SIDE, SIDE) or kind in (0xC0, 0xC1, 0xC2):
            raise ValueError("not a lossless frame of this size")
        at += 2 + size
        if kind == 0xDA:
            return frame[at : frame.rindex(TAIL)]
    raise ValueError("a frame without a scan")


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Rows of ``FRAME`` samples."""
    scans = [scan_of(f) for f in frames]
    sizes = np.fromiter(map(len, scans), np.int64, len(scans))
    stuffed = np.frombuffer(b"".join(scans), np.uint8)
    keep = np.ones(len(stuffed), bool)
    keep[1:] = (stuffed[1:] != 0) | (stuffed[:-1] != 255)
    before = np.concatenate(([0], np.cumsum(keep)))
    starts = before[np.cumsum(sizes) - sizes] * 8
    diff = unpack(stuffed[keep], starts, np.full(len(frames), FRAME), DIFFS, DIFF_SIZES).reshape(-1, SIDE, SIDE).astype(np.int32)
    diff[:, :, 0] = np.cumsum(diff[:, :, 0], axis=1)
    return ((np.cumsum(diff, axis=2) + 128) & 255).astype(np.uint8).reshape(-1, FRAME)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _list(name: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", name + body)


def write_avi(frames: list[bytes]) -> bytes:
    n, most = len(frames), max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, n, 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vids" + b"MJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, RATE, 0, n, most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    at, index, movi = 4, [], []
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    return _chunk(b"RIFF", b"AVI " + head + _list(b"movi", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def read_avi(media: bytes) -> list[bytes]:
    """Frames in the order of the index; its offsets count from the ``movi`` name."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, end, movi, index = 12, 8 + int.from_bytes(media[4:8], "little"), -1, b""
    while at + 8 <= end:
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if movi < 0 or not index:
        raise ValueError("no frames or no index")
    return [media[movi + o + 8 : movi + o + 8 + n] for name, _, o, n in struct.iter_unpack("<4sIII", index) if name[2:] in (b"dc", b"db")]


def cuts(samples: np.ndarray) -> tuple[list[int], np.ndarray]:
    """First frames of the shots after the first, and the difference of each frame from the one before."""
    n = len(samples)
    place = (np.arange(n)[:, None] * BINS + (samples >> 4)).ravel()
    bars = np.bincount(place, minlength=n * BINS).reshape(n, BINS)
    diff = np.abs(np.diff(bars, axis=0)).sum(axis=1) / (2 * FRAME)
    total, square = np.concatenate(([0], np.cumsum(diff))), np.concatenate(([0], np.cumsum(diff * diff)))
    here = np.arange(len(diff))
    first = np.maximum(here - WINDOW, 0)
    seen = np.maximum(here - first, 1)
    mean = (total[here] - total[first]) / seen
    spread = np.sqrt(np.maximum((square[here] - square[first]) / seen - mean * mean, 0))
    return (np.flatnonzero((diff > mean + SPREAD * spread) & (diff > FLOOR)) + 1).tolist(), diff


def clips(samples: np.ndarray) -> list[tuple[int, int, int]]:
    """(clip, start in ms, end in ms) of each shot."""
    edges = [0, *cuts(samples)[0], len(samples)]
    return [(i, a * 1000 // RATE, b * 1000 // RATE) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def padded(text: bytes) -> bytes:
    return text + bytes([PAD]) * (max(FRAME, -(-len(text) // FRAME) * FRAME) - len(text))


def stored(texts: list[bytes]) -> list[bytes]:
    """The AVI file of each text; the frames of all texts are coded at once."""
    payloads = [padded(t) for t in texts]
    frames = encode_frames(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME))
    out, at = [], 0
    for p in payloads:
        out.append(write_avi(frames[at : at + len(p) // FRAME]))
        at += len(p) // FRAME
    return out


def read_back(media: list[bytes]) -> list[np.ndarray]:
    """Samples of each file, a row a frame."""
    frames = [read_avi(m) for m in media]
    every = decode_frames([f for fs in frames for f in fs])
    return np.split(every, np.cumsum([len(f) for f in frames])[:-1])


def media_column(documents: DataFrame) -> DataFrame:
    """doc_id and media: the AVI file of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, limit=1 << 20):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(stored(texts), pa.binary())], ["doc_id", "media"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, media binary")


def clip_rows(media: DataFrame) -> DataFrame:
    """doc_id, clip, start_ms, end_ms of every shot in (doc_id, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *c) for i, m in zip(*(c.to_pylist() for c in batch.columns), strict=True) if m is not None for c in clips(read_back([m])[0])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], ["doc_id", "clip", "start_ms", "end_ms"])

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(run, "doc_id long, clip long, start_ms long, end_ms long")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(documents: DataFrame) -> DataFrame:
    """Each text stored, read back and described."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, limit=1 << 20):
            rows = []
            media = stored(texts)
            for doc_id, text, m, samples in zip(part.column(0).to_pylist(), texts, media, read_back(media), strict=True):
                payload = samples.tobytes()
                shots, diff = cuts(samples)
                feature = f"frames={len(samples)};shots={len(shots) + 1};mean_diff={diff.mean() if len(diff) else 0:.4f};max_diff={diff.max() if len(diff) else 0:.4f};mean={samples.mean():.3f};cuts={','.join(map(str, shots))}"
                rows.append((doc_id, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            names = [c.split()[0] for c in DIGEST.split(", ")]
            kinds = [pa.string() if c.endswith("string") else pa.int64() for c in DIGEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DIGEST)


def op9_avi_media(spark, sf_dir) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
