"""Operator 1: document fingerprints by randomised edit embedding.

A walk reads a text and writes a longer one: at step j it writes the symbol it stands on and moves
on if a random bit, shared by all documents and chosen by (j, symbol), says so. Two texts some edits
apart fall back into step soon after each edit, so edit distance becomes Hamming distance between
what the walks wrote. A symbol is a character with the three before it.

The fingerprint samples what was written: every 2^k-th place, k the least that leaves at most
``SAMPLES``. The places of a coarser k are among those of a finer one, so texts of different lengths
compare at the coarser of their two scales. Two near prints differ in so few places that one of a
number of bands of places is equal in both, so bands give every candidate for near duplicates;
comparing whole fingerprints verifies them.

A null text counts as empty; equal texts have equal fingerprints; repeated rows are documents that
follow each other; a null id comes before all others; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm.links import components
from quillmask.llm.ranges import id_bounds, keys_of, range_count, range_of
from quillmask.llm.staging import stage, table

SAMPLES = 256
CLASSES, PERIOD = 64, 4096
#: Characters walked at once; bounds the memory of a very long text.
BLOCK = 1 << 16
PHASE = 0x2545F491
CHANCE = 1 / 16
NEAR = 0.8
#: Rounds in which a band's members meet one of them before all that are still apart meet.
ROUNDS = 2
#: Bands of up to so many members are left to a join; larger ones are compared in blocks of chunks.
SMALL, CHUNK = 32, 512


def _gaps() -> list[bytes]:
    """Per class and step: steps until the walk moves on."""
    out = []
    for c in range(CLASSES):
        bits = np.random.default_rng([1, c]).integers(0, 2, PERIOD)
        bits[::64] = 1
        move = np.flatnonzero(np.concatenate((bits, bits)))
        out.append((move[np.searchsorted(move, np.arange(PERIOD))] - np.arange(PERIOD) + 1).astype(np.uint8).tobytes())
    return out


GAPS = _gaps()


def symbols(text: str, before: str = "") -> tuple[bytes, np.ndarray]:
    """Class (for the walk) and hex digit (for the fingerprint) of each character after ``before``."""
    lead = ("\0\0\0" + before)[-3:]
    point = np.frombuffer((lead + text).encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(text)
    value = point[3:] * np.uint32(0x9E3779B1) + point[2 : n + 2] * np.uint32(0x85EBCA77) + point[1 : n + 1] * np.uint32(0xC2B2AE3D) + point[:n] * np.uint32(0x27D4EB2F)
    value = (value ^ (value >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    value ^= value >> np.uint32(13)
    return (value >> np.uint32(26)).astype(np.uint8).tobytes(), (value & np.uint32(15)).astype(np.uint8)


def walk(classes: bytes, j: int = 0) -> np.ndarray:
    """The step after which each character was left, from step ``j`` on."""
    gaps, mask, parts = GAPS, PERIOD - 1, []
    for first in range(0, len(classes), BLOCK):
        ends = [j := j + gaps[c][j & mask] for c in classes[first : first + BLOCK]]
        parts.append(np.array(ends, np.int64))
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def sampled(ends: np.ndarray, digit: np.ndarray) -> str:
    """``scale-steps-digits``."""
    steps = int(ends[-1]) if len(ends) else 0
    scale = max(0, (max(steps - 1, 0) // SAMPLES).bit_length())
    at = np.arange(PHASE & ((1 << scale) - 1), steps, 1 << scale)
    found = digit[np.searchsorted(ends, at, side="right")]
    return f"{scale:x}-{steps:x}-" + found.tobytes().translate(_HEX).decode()


_HEX = b"0123456789abcdef" + bytes(240)


def fingerprint(text: str) -> str:
    classes, digit = symbols(text)
    return sampled(walk(classes), digit)


def _at_scale(print_: str, scale: int) -> tuple[int, bytes]:
    own, _, digits = print_.split("-")
    own = int(own, 16)
    first = (PHASE & ((1 << scale) - 1)) - (PHASE & ((1 << own) - 1)) >> own
    return own, digits.encode()[first :: 1 << (scale - own)]


def likeness(a: str, b: str) -> float:
    """Share of equal places at the coarser scale, less what chance gives; 1 for equal prints."""
    if a == b:
        return 1.0
    scale = max(int(a.partition("-")[0], 16), int(b.partition("-")[0], 16))
    x, y = (np.frombuffer(_at_scale(p, scale)[1], np.uint8) for p in (a, b))
    n = min(len(x), len(y))
    same = np.count_nonzero(x[:n] == y[:n]) / max(len(x), len(y), 1)
    return float(max(0.0, (same - CHANCE) / (1 - CHANCE)))


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


class Walked:
    """A text, its walk and its fingerprint."""

    def __init__(self, text: str):
        self.text = text
        self.classes, self.digit = symbols(text)
        self.ends = walk(self.classes)
        self.print = sampled(self.ends, self.digit)

    def edit(self, following: str) -> tuple[str, str]:
        """The edited text and its fingerprint; the walk goes on from where the texts part."""
        keep = len(self.text) - len(self.text) // 4
        tail = following[: len(self.text) // 4]
        classes, digit = symbols(tail, self.text[max(0, keep - 3) : keep])
        ends = walk(classes, int(self.ends[keep - 1]) if keep else 0)
        whole = self.text[:keep] + tail
        return whole, sampled(np.concatenate((self.ends[:keep], ends)), np.concatenate((self.digit[:keep], digit)))


def beside_next(documents: DataFrame, share: int = 4) -> DataFrame:
    """(bucket, halo, doc_id, text), each bucket a range of ids whose rows stand in order, ended by
    the row that follows it (``halo``); the row after the last is the first.

    Bounds come from approximate quantiles of the ids, one bucket a bound; only bounds and each
    bucket's least id, some for each partition, reach the driver.
    """
    spark = documents.sparkSession
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    count = range_count(base, share)
    bounds = id_bounds(base, count)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            for r, k in zip(range_of(batch.column(0), bounds).tolist(), keys_of(batch.column(0)).tolist(), strict=True):
                found[r] = min(k, found.get(r, k))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], ["b", "k"])

    heads = {r["b"]: r["k"] for r in base.select("doc_id").mapInArrow(least, "b int, k long").groupBy("b").agg(F.min("k").alias("k")).collect()}
    order = sorted(heads)
    before = {heads[b]: order[i - 1] for i, b in enumerate(order)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row in its range, and once more, as halo, in the range before if it can be the first of its own."""
        firsts = np.array(list(before), np.int64)
        for batch in batches:
            own, keys = range_of(batch.column(0), bounds), keys_of(batch.column(0))
            again = np.flatnonzero(np.isin(keys, firsts))
            behind = np.array([before[k] for k in keys[again].tolist()], np.int32)
            for rows, bucket, halo in ((batch, own, 0), (batch.take(pa.array(again)), behind, 1)):
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(bucket), halo, np.int32)), *rows.columns], ["bucket", "halo", "doc_id", "text"])

    dealt = base.mapInArrow(place, "bucket int, halo int, doc_id long, text string")
    return dealt.repartition(-(-count // share), "bucket").sortWithinPartitions("bucket", "halo", "doc_id", "text")


PRINTED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_prints(documents: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and the next one are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int | None, Walked] | None = None
        closed = -1
        names = [c.split()[0] for c in PRINTED.split(", ")]
        for batch in batches:
            rows = []
            for bucket, halo, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket == closed:
                    continue  # further rows with the id that begins the next bucket
                mine = Walked(text)
                if held and held[0] == bucket:
                    rows.append(_row(held, mine))
                held = None if halo else (bucket, doc_id, mine)
                closed = bucket if halo else -1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, _TYPES, strict=True)], names)

    return beside_next(documents).mapInArrow(run, PRINTED)


_TYPES = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]


def _row(held: tuple[int, int | None, Walked], following: Walked) -> tuple:
    _, doc_id, mine = held
    whole, print_ = mine.edit(following.text)
    digest = hashlib.sha256(whole.encode()).hexdigest()
    return doc_id, len(mine.text), digest, mine.print, print_, likeness(mine.print, print_), likeness(mine.print, following.print)


@functools.lru_cache(maxsize=None)
def widths(length: int, near: float) -> dict[int, int]:
    """Places in a band, and the bands of that width, for a print of ``length`` places.

    Prints that have at least n places differ in at most d of the n if they are near, so one of d + 1
    bands is equal in both. A print shares the widths of all lengths n that a near one may have.
    """
    equal = near * (1 - CHANCE) + CHANCE
    out: dict[int, int] = {}
    for n in range(max(1, math.ceil(equal * length - 1e-9)), length + 1):
        count = math.floor(n * (1 - equal) + 1e-9) + 1
        out[n // count] = max(out.get(n // count, 0), count)
    return out


def bands(print_: str, near: float = NEAR) -> list[tuple[int, int, int, str]]:
    """(scale, width, band, digits at the band's places), at the print's scale and at each coarser one
    at which a print of that scale, which has SAMPLES / 2 places at least, can be near."""
    scale, out = int(print_.partition("-")[0], 16), []
    fewest = (near * (1 - CHANCE) + CHANCE) * SAMPLES / 2 - 1e-9
    digits = _at_scale(print_, scale)[1].decode()
    while True:
        for width, count in widths(len(digits), near).items():
            out += [(scale, width, k, digits[k * width : (k + 1) * width]) for k in range(min(count, len(digits) // width))]
        scale += 1
        digits = _at_scale(print_, scale)[1].decode()
        if len(digits) < fewest:
            return out


def _grid(prints: list[str], scale: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
    rows = [_at_scale(p, scale)[1] for p in prints]
    data = b"".join(r.ljust(SAMPLES, bytes([fill])) for r in rows)
    return np.frombuffer(data, np.uint8).reshape(-1, SAMPLES), np.array([len(r) for r in rows])


def near_pairs(node: np.ndarray, comp: np.ndarray, prints: list[str], near: float) -> list[tuple[int, int]]:
    """The pairs (a, b), a < b, of near prints in different components, all against all."""
    own, out = np.array([int(p.partition("-")[0], 16) for p in prints]), []
    for scale in np.unique(own):
        here, other = np.flatnonzero(own == scale), np.flatnonzero(own <= scale)
        mine, size = _grid([prints[i] for i in here], int(scale), 0)
        theirs, sizes = _grid([prints[i] for i in other], int(scale), 1)
        for i, row, n in zip(here, mine, size, strict=True):
            same = np.count_nonzero(theirs == row, axis=1) / np.maximum(np.maximum(sizes, n), 1)
            hit = other[((same - CHANCE) / (1 - CHANCE) >= near) & (comp[other] != comp[i])]
            out += [(min(node[i], x), max(node[i], x)) for x in node[hit].tolist()]
    return out


def _apart(shared: DataFrame, comps: DataFrame | None) -> DataFrame:
    """The bands (key, node, m) whose members are in more than one component, with ``comp``."""
    if comps is None:
        return shared.withColumn("comp", F.col("node"))
    held = shared.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    split = held.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    return held.join(split, "key", "left_semi")


def near_links(classes: DataFrame, near: float) -> DataFrame | None:
    """(node, comp) of the prints (node, print) that are near another one, None if there are none.

    In each band the members first meet one of them, by rounds. Then members that are still in
    different components meet each other, so the links left out join what is joined already. Where
    many texts that are not near share a band, this last step grows with the square of their number.
    """

    @F.pandas_udf("array<string>")
    def keys(prints: pd.Series) -> pd.Series:
        return prints.map(lambda p: [":".join(map(str, b)) for b in bands(p, near)])

    @F.pandas_udf("double")
    def like(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y) for x, y in zip(a, b, strict=True)])

    def alike(pairs: DataFrame) -> DataFrame:
        both = pairs.join(classes.toDF("a", "pa"), "a").join(classes.toDF("b", "pb"), "b")
        return both.filter(like("pa", "pb") >= near).select("a", "b")

    banded = stage(classes.select("node", F.explode(keys("print")).alias("key")).select(F.xxhash64("key").alias("key"), "node").distinct(), "bands")
    shared = stage(banded.join(banded.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "key"), "bands")
    links, comps, tried = None, None, None

    def joined(more: DataFrame) -> None:
        nonlocal links, comps
        more = stage(more, "near")
        if more.limit(1).count():
            links = more if links is None else links.unionByName(more)
            comps = components(links)

    def fresh(pairs: DataFrame) -> DataFrame:
        nonlocal tried
        pairs = pairs.distinct()
        pairs = stage(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        return pairs

    for round_ in range(ROUNDS):
        open_ = stage(_apart(shared, comps), "open")
        order = F.xxhash64(F.lit(round_), "key", "node") if round_ else F.lit(0).cast("long")
        leaders = open_.groupBy("key").agg(F.min(F.struct(order.alias("o"), "node", "comp")).alias("l"))
        met = open_.join(leaders, "key").filter(F.col("comp") != F.col("l.comp"))
        joined(alike(fresh(met.select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b")))))

    open_ = stage(_apart(shared, comps), "open")
    few = open_.filter(F.col("m") <= SMALL)
    x, y = few.alias("x"), few.alias("y")
    across = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp"))
    joined(alike(fresh(x.join(y, across).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))))

    many = stage(_apart(shared.filter(F.col("m") > SMALL), comps), "open").join(classes, "node")
    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    dealt = many.withColumn("own", F.pmod(F.xxhash64("node"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "comp", "print")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        found = near_pairs(group["node"].to_numpy(), group["comp"].to_numpy(), group["print"].tolist(), near)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    joined(dealt.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long").distinct())
    return comps


def near_duplicates(documents: DataFrame, near: float = NEAR) -> DataFrame:
    """doc_id, class_id, likeness: each document with the least document of its class, and how alike
    the two are. A class is joined by prints that are at least ``near`` alike, above 0, so two of a
    class can be less alike than that."""

    @F.pandas_udf("string")
    def printed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t or ""))

    @F.pandas_udf("double")
    def like(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y) for x, y in zip(a, b, strict=True)])

    prints = stage(documents.select("doc_id", printed(F.coalesce("text", F.lit(""))).alias("print")), "prints")
    equal = prints.groupBy("print").agg(F.min("doc_id").alias("rep"))
    equal = stage(equal.withColumn("node", F.monotonically_increasing_id()), "prints")
    comps = near_links(equal.select("node", "print"), near)
    whole = equal.withColumn("comp", F.col("node")) if comps is None else equal.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # A null id comes before all others.
    least = whole.groupBy("comp").agg(F.min(F.struct("rep", "print")).alias("least"))
    classed = whole.join(least, "comp").select("print", F.col("least.rep").alias("class_id"), like("print", "least.print").alias("likeness"))
    return prints.join(classed, "print").select("doc_id", "class_id", "likeness")


def op1_edit_prints(spark, sf_dir) -> DataFrame:
    return edit_prints(table(spark, sf_dir, "documents").select("doc_id", "text"))
