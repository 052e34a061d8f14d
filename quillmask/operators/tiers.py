"""Candidate spans of each tier as Column expressions over a text column, which is given by name.

Within a plan a candidate is struct<start, end, text, entity_type, confidence, source, context,
entropy, ord>; ``ord`` is the place of its tier and shape, the last tie-break.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmask.functions import patterns as P
from quillmask.functions.entities import Settings
from quillmask.functions.validators import CHECKS, shannon_entropy
from quillmask.functions.wordlist import FEW

CANDIDATE = "struct<start:int,end:int,text:string,entity_type:string,confidence:double,source:string,context:string,entropy:string,ord:int>"
NONE = f"array<{CANDIDATE}>"

# Places of the tiers: deterministic, custom words, custom patterns, NER, entropy, extra, plugins, contextual.
ORD_WORDS, ORD_PYTHON, ORD_ENTROPY, ORD_EXTRA, ORD_CONTEXT = 100, 200, 400, 500, 900


def none() -> Column:
    return F.array().cast(NONE)


def possible(text: Column, needs: tuple[str, ...], digits: Column | None = None) -> Column:
    """A cheap condition that every match of a shape fulfils; ``digits``: whether the text has any."""
    if needs == P.DIGIT:
        return text.rlike(P.HAS_DIGIT) if digits is None else digits
    # Where all literals have an underscore, texts without one are read once and not once a literal.
    shared = len(needs) > 1 and all("_" in w for w in needs)
    found = contains_any(text, needs) if needs else F.lit(True)
    return text.contains("_") & found if shared else found


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def blocks_sql(name: str) -> str:
    """SQL of an array cut into arrays of about the square root of its length."""
    width = f"cast(ceil(sqrt(size({name}))) as int)"
    return f"transform(sequence(0, cast((size({name}) - 1) div {width} as int)), i -> slice({name}, i * {width} + 1, {width}))"


def matches_sql(text: str, regex: str) -> str:
    """SQL of array<struct<start, end, text>> of all matches, left to right; null where there is none.

    ``text`` is SQL too. The text between matches and the matches themselves add up to the text, so
    running lengths give code-point offsets whatever the text holds. They run over blocks of matches and
    then inside each, since a fold copies the list that it has made so far. SQL text, and not one call a
    function, since a plan of all shapes would take thousands of calls to the JVM.
    """
    rx = literal(regex)
    parts = f"zip_with(split({text}, {rx}, -1), regexp_extract_all({text}, {rx}, 0), (g, h) -> named_struct('gap', length(g), 'hit', h))"
    sizes = "transform(b, y -> aggregate(y, 0, (t, x) -> t + x.gap + coalesce(length(x.hit), 0)))"
    offsets = f"aggregate({sizes}, array(0), (t, x) -> concat(t, array(element_at(t, -1) + x)))"
    span = "named_struct('start', a.at + p.gap, 'end', a.at + p.gap + length(p.hit), 'text', p.hit)"
    start = "named_struct('at', o, 'out', cast(array() as array<struct<start:int,end:int,text:string>>))"
    fold = f"(a, p) -> CASE WHEN p.hit IS NULL THEN a ELSE named_struct('at', a.at + p.gap + length(p.hit), 'out', concat(a.out, array({span}))) END"
    inside = f"flatten(zip_with(b, slice({offsets}, 1, size(b)), (y, o) -> aggregate(y, {start}, {fold}, a -> a.out)))"
    return f"CASE WHEN {text} RLIKE {rx} THEN transform(transform(array({parts}), z -> {blocks_sql('z')}), b -> {inside})[0] END"


def matches(text: str, regex: str, maybe: Column | None = None) -> Column:
    """The matches in a column of this name; texts that fail ``maybe`` are not searched at all."""
    found = F.expr(matches_sql(f"`{text}`", regex))
    return found if maybe is None else F.when(maybe, found)


def plain_candidates(text: str, regex: str, kind: str, confidence: float, source: str, ord_: int) -> Column:
    """Every match as a candidate."""
    fields = f"'start', h.start, 'end', h.end, 'text', h.text, 'entity_type', {literal(kind)}, 'confidence', {confidence}D, 'source', {literal(source)}"
    one = f"named_struct({fields}, 'context', cast(null as string), 'entropy', cast(null as string), 'ord', {ord_})"
    return F.expr(f"transform({matches_sql(f'`{text}`', regex)}, h -> {one})")


def candidate(hit: Column, kind: str, confidence: float, source: str, ord_: int, entropy: Column | None = None) -> Column:
    return F.struct(
        hit["start"].alias("start"), hit["end"].alias("end"), hit["text"].alias("text"), F.lit(kind).alias("entity_type"),
        F.lit(confidence).cast("double").alias("confidence"), F.lit(source).alias("source"), F.lit(None).cast("string").alias("context"),
        (F.lit(None).cast("string") if entropy is None else entropy).alias("entropy"), F.lit(ord_).alias("ord"),
    )


def _group(hit: Column, regex: str) -> Column:
    """The value of an assignment: it ends with the match, but for a closing quote."""
    value = F.regexp_extract(hit["text"], regex, 1)
    last = hit["end"] - F.when(F.substring(hit["text"], -1, 1).isin('"', "'"), 1).otherwise(0)
    return F.struct((last - F.length(value)).alias("start"), last.alias("end"), value.alias("text"))


def shape_spans(text: str, shape: P.Shape, ord_: int, digits: Column | None = None) -> Column:
    regex, maybe = P.java(shape.lead + shape.regex), possible(F.col(text), shape.needs, digits)
    if not shape.group and not shape.check:
        found = plain_candidates(text, regex, shape.kind, shape.confidence, "deterministic", ord_)
        return F.coalesce(F.when(maybe, found), none())
    hits = matches(text, regex, maybe)
    if shape.group:
        hits = F.transform(hits, lambda h: _group(h, regex))
    if shape.check:
        hits = F.filter(hits, lambda h: CHECKS[shape.check](h["text"]))
    return F.coalesce(F.transform(hits, lambda h: candidate(h, shape.kind, shape.confidence, "deterministic", ord_)), none())


def entropy_spans(text: str, min_length: int = P.SECRET_LENGTH, base64_entropy: float = P.BASE64_FLOOR, hex_entropy: float = P.HEX_FLOOR, confidence: float = P.SECRET_CONFIDENCE) -> Column:
    def random(h: Column) -> Column:
        bits = F.round(shannon_entropy(h["text"]), 9)
        hexes = h["text"].rlike("^[0-9a-fA-F]+$")
        enough = F.when(hexes, (F.length(h["text"]) >= P.HEX_LENGTH) & (bits >= hex_entropy)).otherwise(bits >= base64_entropy)
        return (F.length(h["text"]) >= min_length) & ~h["text"].rlike("^[A-Za-z]+$") & enough

    def shown(h: Column) -> Column:
        return candidate(h, "secret", confidence, "entropy", ORD_ENTROPY, F.format_string("%.2f", F.bround(shannon_entropy(h["text"]), 2)))

    hits = matches(text, P.SECRET_LEAD + P.SECRET_RUN, F.col(text).rlike(P.SECRET_HINT))
    return F.coalesce(F.transform(F.filter(hits, random), shown), none())


#: Characters of a page.
PAGE = 1024


def paged(text: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the text's pages, computed once. A place in a string is found by counting from its
    start; in pages it is found at once, so many places in a long text cost no more than few in many."""
    return F.transform(F.array(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))), body)[0]


def cut(pages: Column, start: Column, size: Column) -> Column:
    """``size`` characters from ``start`` (from 0) on."""
    first = F.floor(start / PAGE).cast("int")
    some = F.slice(pages, first + 1, F.floor((start + size) / PAGE).cast("int") - first + 1)
    return F.substring(F.array_join(some, ""), start - first * PAGE + 1, size)


def before(pages: Column, start: Column, width: int) -> Column:
    """The lower-cased ``width`` characters that end at ``start``."""
    return F.lower(cut(pages, F.greatest(start - width, F.lit(0)), F.least(start, F.lit(width))))


def has_word(text: Column, words: Iterable[str]) -> Column:
    """The same for short texts and many words, in one expression."""
    return text.rlike("|".join(f"\\Q{w}\\E" for w in words))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether any of the words is a substring."""
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def bare_ssn_spans(text: str, digits: Column | None = None) -> Column:
    found = matches(text, P.java(P.DIGIT_LEAD + P.BARE_SSN), possible(F.col(text), P.DIGIT, digits))
    hits = F.when(F.size(found) > 0, paged(F.col(text), lambda pages: F.filter(found, lambda h: has_word(before(pages, h["start"], P.BOOST_WINDOW), P.BOOST_WORDS["ssn"]))))
    return F.coalesce(F.transform(hits, lambda h: candidate(h, "ssn", P.BARE_SSN_CONFIDENCE, "contextual", ORD_CONTEXT)), none())


def word_spans(text: str, words: Iterable[str], case_sensitive: bool = False) -> Column:
    """The user's literal words, tried in their order at each place."""
    quoted = "|".join("\\Q" + w.replace("\\E", "\\E\\\\E\\Q") + "\\E" for w in words if w)
    if not quoted:
        return none()
    return F.coalesce(plain_candidates(text, quoted if case_sensitive else f"(?iu){quoted}", "custom", 1.0, "custom", ORD_WORDS), none())


def native_tiers(text: str, settings: Settings, digits: Column | None = None) -> dict[str, Column]:
    """Column name to candidates of every tier that needs no Python."""
    tiers = {f"_shape{i}": shape_spans(text, s, i, digits) for i, s in enumerate(P.SHAPES) if settings.wants(s.kind)}
    if 0 < len(settings.custom_words) <= FEW:  # more go through an automaton, in Python
        tiers["_words"] = word_spans(text, settings.custom_words)
    if settings.entropy_on:
        tiers["_entropy"] = entropy_spans(text, *settings.entropy_knobs)
    if settings.wants("ssn"):
        tiers["_bare"] = bare_ssn_spans(text, digits)
    return tiers
