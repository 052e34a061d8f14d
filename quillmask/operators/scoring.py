"""From candidates to detections: context, threshold, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.functions import patterns as P
from quillmask.operators.tiers import NONE, before, blocks_sql, has_word, paged


def exploded(frame: DataFrame, keys: list[str], spans: str, one: str, place: str | None = None) -> DataFrame:
    """The keys and a row for each span of an array column, as ``one``; ``place`` names its index.

    An inner explode lets the optimiser infer a filter on the array and push it below the projections
    that make the array: all of detection would then stand in the filter once more, with every tier
    repeated wherever a later step reads it. Empty arrays give a null row instead, dropped at once.
    """
    made = F.explode_outer(spans).alias(one) if place is None else F.posexplode_outer(spans).alias(place, one)
    return frame.select(*keys, made).filter(F.col(one).isNotNull())


def boosted(pages: Column, span: Column) -> Column:
    """Whether a word of the span's kind stands shortly before it; ``pages`` of the text (``tiers.paged``)."""
    near, found = before(pages, span["start"], P.BOOST_WINDOW), F.lit(False)
    kinds: dict[tuple[str, ...], list[str]] = {}
    for kind, words in P.BOOST_WORDS.items():
        kinds.setdefault(words, []).append(kind)
    for words, of in kinds.items():
        found = found | (span["entity_type"].isin(*of) & has_word(near, words))
    return found


def suppressed(pages: Column, span: Column) -> Column:
    """Whether a placeholder word stands just before the span or in it."""
    return has_word(before(pages, span["start"], P.SUPPRESS_WINDOW), P.SUPPRESS_WORDS) | has_word(F.lower(span["text"]), P.SUPPRESS_WORDS)


def adjusted(text: Column, spans: Column) -> Column:
    def changed(s: Column, when: Column, confidence: Column, word: str) -> Column:
        return s.withField("confidence", F.when(when, confidence).otherwise(s["confidence"])).withField("context", F.when(when, F.lit(word)).otherwise(s["context"]))

    def by_pages(pages: Column) -> Column:
        raised = F.transform(spans, lambda s: changed(s, boosted(pages, s), F.least(F.lit(1.0), s["confidence"] + P.BOOST), "boosted"))
        return F.transform(raised, lambda s: changed(s, suppressed(pages, s), F.greatest(F.lit(0.0), s["confidence"] - P.SUPPRESS), "suppressed"))

    return paged(text, by_pages)


def confident(spans: Column, least: float) -> Column:
    return F.filter(spans, lambda s: s["confidence"] >= least)


#: Arrays of more spans are first cut into clusters.
FEW = 16


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with a name for ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _greedy(ranked: str) -> str:
    hit = "exists(kept, k -> k.start < r.s.end AND r.s.start < k.end)"
    return f"aggregate(array_sort({ranked}), cast(array() as {NONE}), (kept, r) -> CASE WHEN {hit} THEN kept ELSE concat(kept, array(r.s)) END)"


def _running_max(name: str) -> str:
    """SQL of the running maximum of an array of numbers, by blocks, so no fold copies much."""
    fold = "aggregate({}, array({}), (t, x) -> concat(t, array(greatest(element_at(t, -1), x))))"
    tops = fold.format("transform(b, y -> array_max(y))", "-1")
    # Each block begins with the maximum of those before it, which is not its own.
    return _let("b", blocks_sql(name), f"flatten(zip_with(b, slice({tops}, 1, size(b)), (y, q) -> slice({fold.format('y', 'q')}, 2, size(y))))")


def _by_cluster(ranked: str) -> str:
    ordered = f"array_sort(transform({ranked}, r -> named_struct('start', r.c, 'end', r.s.end, 'r', r)))"
    firsts = "filter(sequence(1, size(o)), i -> coalesce(get(m, i - 2) <= o[i - 1].start, true))"
    size = "coalesce(get(f, j + 1), size(o) + 1) - f[j]"
    kept = f"CASE WHEN {size} = 1 THEN array(o[f[j] - 1].r.s) ELSE {_greedy(f'transform(slice(o, f[j], {size}), x -> x.r)')} END"
    each = f"flatten(transform(sequence(0, size(f) - 1), j -> {kept}))"
    return _let("o", ordered, _let("m", _let("e", "transform(o, x -> x.end)", _running_max("e")), _let("f", firsts, each)))


def resolved(spans: str) -> Column:
    """From the surest (then longest, first, and of the first tier) on, what overlaps nothing kept, in an
    array column of this name.

    The fold copies what it keeps, so long arrays are cut into clusters first: sorted by start, one
    begins where no span before reaches past the start. Only the size of the largest cluster is squared;
    ``clusters.resolved_rows`` has no such limit.
    """
    given = f"`{spans}`"
    ranked = f"transform({given}, s -> named_struct('a', -s.confidence, 'b', s.start - s.end, 'c', s.start, 'd', s.ord, 's', s))"
    some = f"CASE WHEN size({given}) <= {FEW} THEN {_greedy(ranked)} ELSE {_by_cluster(ranked)} END"
    return F.expr(f"CASE WHEN size({given}) <= 1 THEN {given} ELSE array_sort({some}) END")
