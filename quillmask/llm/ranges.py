"""Ranges of document ids, for work in ascending order without a sample of the rows themselves.

Ids stay 64-bit integers throughout: a null among them never turns the others into floats.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm.staging import partitions

NULL_KEY = -(1 << 63)
#: Bytes of text of a range, about.
SHARE = 8 << 20


def range_count(texts: DataFrame, least: int) -> int:
    """How many ranges a table needs: as many as its bytes of text ask for, and at least so many a
    shuffle partition."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least * partitions(texts.sparkSession), math.ceil(total / SHARE))


def id_bounds(rows: DataFrame, count: int) -> np.ndarray:
    """At most ``count - 1`` ascending bounds that part the ids in ranges of about equal size. Quantiles are
    floats, so a bound is near its place; ids are compared with it as integers."""
    cuts = rows.select("doc_id").approxQuantile("doc_id", [k / count for k in range(1, count)], 1 / (4 * count))
    return np.array(sorted({min(max(int(c), NULL_KEY), -NULL_KEY - 1) for c in cuts}), np.int64)


def range_of(ids: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """The range of each id; null ids belong to the first."""
    return np.searchsorted(bounds, keys_of(ids), "right").astype(np.int32)


def keys_of(ids: pa.Array) -> np.ndarray:
    return ids.cast(pa.int64()).fill_null(NULL_KEY).to_numpy(zero_copy_only=False)
