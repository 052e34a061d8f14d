"""Finished tables of chunks, each document the work of many tasks.

Rows are (doc_id, chunk_no, text, is_last). Where a chunk stands in its document is the sum of the
lengths before it: sums inside blocks of chunks, and over the blocks' sums. The places cut documents in
ranges of equal size, whatever the size of the chunks. A range reads a margin on either side, resolves
the spans that it sees there, and rewrites those that start in it.

As in a stream, a chunk that comes again is dropped (of different texts with one number the one of the
least hash counts), and so is what comes after ``is_last`` and what has no number or one below 0. A null text is empty. Numbers that are
missing are passed over: a finished table has nothing to wait for. A document without text has no
segments. The result is that of the whole text if no run of overlapping spans and none without white space
is longer than the margin (the settings' overlap, 128 characters at least).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmask.functions.entities import Settings
from quillmask.operators.clusters import carried
from quillmask.operators.engine import Masker, public
from quillmask.operators.policy import applied
from quillmask.operators.scoring import exploded
from quillmask.operators.tiers import CANDIDATE
from quillmask.session import stage

#: Numbers of chunks of a block.
BLOCK = 1024
LEAST_MARGIN = 128
LINE, GAP = r"(?s)^[^\n]*\n", r"(?s)^[^\s\p{Z}]*[\s\p{Z}]"


def in_order(chunks: DataFrame) -> DataFrame:
    """(key, text, base, total): each chunk up to the end of its document, with the number of characters
    before it and in all; one that came twice is here twice. Only lengths and hashes go through the sums."""
    ended = F.coalesce("is_last", F.lit(False)) if "is_last" in chunks.columns else F.lit(False)
    rows = chunks.select(F.struct("doc_id").alias("key"), F.col("chunk_no").cast("long").alias("chunk_no"), F.coalesce("text", F.lit("")).alias("text"), ended.cast("int").alias("ended")).filter("chunk_no >= 0")
    hashes = F.struct(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("chunk"), "text").alias("h2"), F.length("text").cast("long").alias("size"))
    # Dealt out before they are grouped: what groups by the least hash sorts its rows, here without texts.
    hashed = rows.select("key", "chunk_no", "ended", hashes.alias("h")).repartition("key", "chunk_no")
    once = hashed.groupBy("key", "chunk_no").agg(F.min("h").alias("h"), F.max("ended").alias("ended"))
    sizes = stage(once.select("key", "chunk_no", "h.h1", "h.h2", "h.size", "ended", F.floor(F.col("chunk_no") / BLOCK).alias("block")), "sizes")
    order = Window.partitionBy("key", "block").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    known = carried(sizes, "key", "block", "ended", "before").withColumn("over", F.greatest(F.max("ended").over(order), "before"))
    known = known.filter(F.coalesce("over", F.lit(0)) == 0).drop("over", "before")
    blocks = known.groupBy("key", "block").agg(F.sum("size").alias("size"))
    whole = Window.partitionBy("key")
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.select("key", "block", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("first"), F.sum("size").over(whole).alias("total"))
    placed = known.join(sums, ["key", "block"]).withColumn("base", F.col("first") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    texts = rows.select("key", "chunk_no", "text", hashes.alias("h")).select("key", "chunk_no", "text", "h.h1", "h.h2")
    return texts.join(placed.select("key", "chunk_no", "h1", "h2", "base", "total"), ["key", "chunk_no", "h1", "h2"]).select("key", "text", "base", "total")


def chunk_ranges(chunks: DataFrame, size: int, margin: int) -> DataFrame:
    """(key, r, lo, hi, read, text): the ranges [lo, hi) of each document, with the text from ``read`` on that
    they look at. It begins ``margin`` to twice that before ``lo``, at a line, else after white space."""
    placed = in_order(chunks)
    part = F.when(F.length("text").between(1, size), F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))
    parts = placed.select("key", "base", "total", F.posexplode(part).alias("k", "part")).withColumn("at", F.col("base") + F.col("k") * size)
    end = F.col("at") + F.length("part")
    low = F.greatest(F.floor((F.col("at") - margin) / size), F.lit(0))
    high = F.least(F.ceil((end + 2 * margin) / size) - 1, F.floor((F.col("total") - 1) / size))
    dealt = parts.select("*", F.explode(F.sequence(low, high)).alias("r"))
    skip = F.greatest(F.col("r") * size - 2 * margin - F.col("at"), F.lit(0))
    keep = F.least(F.length("part").cast("long"), (F.col("r") + 1) * size + margin - F.col("at")) - skip
    dealt = dealt.select("key", "r", "total", F.struct((F.col("at") + skip).alias("at"), F.substring(F.col("part"), (skip + 1).cast("int"), keep.cast("int")).alias("part")).alias("p"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_set("p")), lambda p: p["part"]), "")
    ranges = dealt.groupBy("key", "r").agg(joined.alias("text"), F.max("total").alias("total"))
    read = F.greatest(F.col("r") * size - 2 * margin, F.lit(0))
    head = F.substring("text", 1, margin)
    line, gap = (F.length(F.regexp_extract(head, rx, 0)) for rx in (LINE, GAP))
    lost = F.when(read == 0, 0).when(line > 0, line).otherwise(gap)
    return ranges.select("key", "r", (F.col("r") * size).alias("lo"), F.least((F.col("r") + 1) * size, "total").alias("hi"), (read + lost).alias("read"), F.expr("text").substr(lost + 1, F.length("text")).alias("text"))


SPAN = ["text", "entity_type", "confidence", "source", "context", "entropy", "ord"]


def redact_chunk_table(chunks: DataFrame, settings: Settings, size: int | None = None) -> DataFrame:
    """doc_id, seg_no, base_offset, segment, redacted, detections (from the segment's beginning): the
    segments of a document add up to its text. A segment is a range of ``size`` characters (the settings'
    chunk size), whose edges move to the end of a span that they would cut; where one span takes a whole
    range, its number is missing. A range and the next find a span at their edge alike, each in its own
    margins, so nothing passes between them."""
    size, margin = size or settings.chunk_size, max(settings.overlap, LEAST_MARGIN)
    found, copy = Masker(settings)._kept(chunk_ranges(chunks, size, margin), "text", "spans")
    place = lambda s, side: s[side] + F.col("read")
    here = F.filter("spans", lambda s: (place(s, "start") < F.col("hi")) & (place(s, "end") > F.col("lo")))
    met = found.drop(copy).withColumn("spans", here)
    edge = lambda of, least: F.greatest(F.array_max(F.transform(F.filter("spans", of), lambda s: place(s, "end"))), least)
    first, last = edge(lambda s: place(s, "start") < F.col("lo"), F.col("lo")), edge(lambda s: place(s, "start") >= F.col("lo"), F.col("hi"))
    edged = met.withColumn("first", first).withColumn("last", last)
    lead = (F.col("first") - F.col("read")).cast("int")
    own = F.transform(F.filter("spans", lambda s: place(s, "start") >= F.col("lo")), lambda s: F.struct((s["start"] - lead).alias("start"), (s["end"] - lead).alias("end"), *[s[c].alias(c) for c in SPAN]))
    segment = F.col("text").substr(lead + 1, (F.col("last") - F.col("first")).cast("int"))
    given = F.struct(F.col("first").alias("base_offset"), segment.alias("segment"), own.cast(f"array<{CANDIDATE}>").alias("own"))
    # A filter would be pushed below detection, and repeat it.
    rows = exploded(edged.select("key", "r", F.when(F.col("first") < F.col("last"), F.array(given)).alias("given")), ["key", "r"], "given", "g")
    return rows.select(
        F.col("key.doc_id").alias("doc_id"), F.col("r").cast("int").alias("seg_no"), "g.base_offset", "g.segment",
        applied(F.col("g.segment"), F.col("g.own"), settings.policy).alias("redacted"), public(F.col("g.own")).alias("detections"),
    )
