"""Rewriting text around its detections, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmask.functions.entities import Policy
from quillmask.operators.tiers import cut, paged


def _hmac_sha256(key: bytes, text: Column) -> Column:
    """HMAC in built-in functions. The padded keys are literals of the plan, which shows in explain
    and the UI: where plans are not private, pseudonymise through ``local.LocalEngine``."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(text, "UTF-8")), 256))), 256)


def rendered(span: Column, policy: Policy) -> Column:
    """What stands in place of the span."""
    if policy.mode == "mask":
        keep = max(0, policy.mask_keep_last)
        size = F.length(span["text"])
        hidden = F.greatest(size - keep, F.lit(0))
        shown = F.concat(F.repeat(F.lit(policy.mask_char), hidden), F.substring(span["text"], hidden + 1, F.lit(keep)))
    elif policy.mode == "pseudonymize":
        shown = F.concat(F.lit("<"), F.upper(span["entity_type"]), F.lit("_"), F.substring(_hmac_sha256(policy.hmac_key or b"", span["text"]), 1, 10), F.lit(">"))
    else:
        shown = F.lit(policy.replacement)
    for kind, text in policy.replacements.items():
        shown = F.when(span["entity_type"] == kind, F.lit(text)).otherwise(shown)
    return shown


def applied(text: Column, spans: Column, policy: Policy) -> Column:
    """``text`` with every span (ordered, disjoint) rewritten; each gap belongs to the span after it."""

    def by_pages(pages: Column) -> Column:
        def piece(span: Column, i: Column) -> Column:
            last = F.when(i == 0, 0).otherwise(F.try_element_at(spans, i)["end"])
            return F.concat(cut(pages, last, span["start"] - last), rendered(span, policy))

        end = F.element_at(spans, -1)["end"]
        return F.concat(F.array_join(F.transform(spans, piece), ""), cut(pages, end, F.length(text) - end))

    return F.when(F.size(spans) == 0, text).otherwise(paged(text, by_pages))
