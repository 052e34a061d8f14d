"""Long documents in parallel ranges with margins.

A range owns its characters and reads ``overlap`` more on either side; it keeps the spans that start
in it. Edges stand at line ends, else at white space, and margins reach out to the next one, since a
token cut in two would be matched from another place. A document with a run of more than ``overlap``
characters without white space is detected whole. Ranges are cut in Arrow batches; detection in them is
Column expressions. Spans are shuffled, and once each text, to meet them.

Spans belong to a text, not to an id alone: they are kept by the id and 128 bits of the text's hash, so
rows without an id and rows that share one are rewritten from their own spans.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.operators.engine import Masker, public
from quillmask.operators.policy import applied
from quillmask.operators.clusters import resolved_rows
from quillmask.operators.scoring import exploded

RANGE = "array<struct<range_no:int,own_lo:long,own_hi:long,read_lo:long,text:string>>"


def cut_ranges(text: str, size: int, overlap: int) -> list[dict]:
    """Ranges of about ``size`` characters, the text they read, and where both begin."""
    n = len(text)

    def edge(at: int) -> int:
        """The place after the last line end, else white space, in the ``overlap`` before ``at``."""
        if at >= n:
            return n
        back = text[max(0, at - overlap) : at]
        line = back.rfind("\n")
        if line >= 0:
            return at - len(back) + line + 1
        for k in range(len(back) - 1, -1, -1):
            if back[k].isspace():
                return at - len(back) + k + 1
        return -1

    def out(at: int, step: int) -> int:
        """From ``at`` on outwards to white space."""
        while 0 < at < n and not text[at - 1 if step < 0 else at].isspace():
            at += step
        return at

    edges = [0]
    while edges[-1] < n:
        following = edge(edges[-1] + max(size, 1))
        if following < 0:
            return [{"range_no": 0, "own_lo": 0, "own_hi": n, "read_lo": 0, "text": text}]
        edges.append(following if following > edges[-1] else min(n, out(edges[-1] + max(size, 1), 1)))
    rows = []
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        low, high = out(max(0, a - overlap), -1), out(min(n, b + overlap), 1)
        rows.append({"range_no": k, "own_lo": a, "own_hi": b, "read_lo": low, "text": text[low:high]})
    return rows or [{"range_no": 0, "own_lo": 0, "own_hi": 0, "read_lo": 0, "text": text}]


KEY = ["doc_id", "_text1", "_text2"]


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text and what tells the text from others."""
    return documents.select("doc_id", "text", F.xxhash64("text").alias("_text1"), F.xxhash64(F.lit("text"), "text").alias("_text2"))


def ranges(documents: DataFrame, size: int, overlap: int) -> DataFrame:
    """The key and one row a range of each text of ``keyed`` documents."""

    @F.pandas_udf(RANGE)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else cut_ranges(t, size, overlap))

    return documents.select(*KEY, F.explode(cut("text")).alias("r")).select(*KEY, "r.*")


def _spans(texts: DataFrame, masker: Masker, size: int | None, overlap: int | None) -> DataFrame:
    size, overlap = size or masker.settings.chunk_size, masker.settings.overlap if overlap is None else overlap
    found = masker.scored(ranges(texts, size, overlap), "text", "c")
    rows = exploded(found, [*KEY, "own_lo", "own_hi", "read_lo"], "c", "s")
    start = (F.col("s.start") + F.col("read_lo")).cast("int")
    owned = rows.withColumn("s", F.col("s").withField("start", start).withField("end", (F.col("s.end") + F.col("read_lo")).cast("int")))
    owned = owned.filter((F.col("s.start") >= F.col("own_lo")) & (F.col("s.start") < F.col("own_hi"))).select(*KEY, "s.*")
    # Repeated rows give the same spans again.
    return resolved_rows(owned.distinct(), KEY)


def halo_spans(documents: DataFrame, masker: Masker, size: int | None = None, overlap: int | None = None) -> DataFrame:
    """doc_id, start, end, text, entity_type, confidence, source, context, entropy, ord of every
    detection, as if each text had been searched whole; those of repeated rows once."""
    return _spans(keyed(documents), masker, size, overlap).drop("_text1", "_text2")


def halo_redact(documents: DataFrame, masker: Masker, size: int | None = None, overlap: int | None = None) -> DataFrame:
    """doc_id, detections and redacted of every row, rewritten from the spans of all ranges."""
    texts = keyed(documents)
    spans = _spans(texts, masker, size, overlap)
    fields = ["start", "end", "text", "entity_type", "confidence", "source", "context", "entropy", "ord"]
    lists = spans.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("found"))
    d, f = texts.alias("d"), lists.alias("f")
    own = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d._text1") == F.col("f._text1")) & (F.col("d._text2") == F.col("f._text2"))
    joined = d.join(f, own, "left").select("d.doc_id", "d.text", "f.found")
    whole = F.when(F.col("found").isNull(), F.col("text")).otherwise(applied(F.col("text"), F.col("found"), masker.settings.policy))
    return joined.select("doc_id", F.coalesce(public(F.col("found")), F.array().cast(joined.select(public(F.col("found")).alias("x")).schema["x"].dataType)).alias("detections"), whole.alias("redacted"))
