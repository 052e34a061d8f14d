"""The detectors on one Python string, for places that hold text in Python already: keyed stream
state, file ranges and tests against the Column form."""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from quillmask.functions import patterns as P
from quillmask.functions.entities import Policy, Settings
from quillmask.functions.validators import TEXT_CHECKS, entropy_text


@dataclass
class Span:
    """A detection; ``start`` and ``end`` count code points, half open."""

    start: int
    end: int
    text: str
    entity_type: str
    confidence: float
    source: str = "deterministic"
    meta: dict[str, str] = field(default_factory=dict)

    def overlaps(self, other: Span) -> bool:
        return self.start < other.end and other.start < self.end


class ShapeDetector:
    name = "deterministic"

    def __init__(self, settings: Settings):
        self.shapes = [(s, re.compile(s.regex)) for s in P.SHAPES if settings.wants(s.kind)]

    def detect(self, text: str) -> list[Span]:
        return [
            Span(m.start(s.group), m.end(s.group), m[s.group], s.kind, s.confidence, self.name)
            for s, regex in self.shapes
            for m in regex.finditer(text)
            if s.check is None or TEXT_CHECKS[s.check](m[s.group])
        ]


class EntropyDetector:
    """Runs that look random. The floors are knobs."""

    name = "entropy"

    def __init__(self, min_length: int = P.SECRET_LENGTH, base64_entropy: float = P.BASE64_FLOOR, hex_entropy: float = P.HEX_FLOOR, confidence: float = P.SECRET_CONFIDENCE):
        self.min_length, self.base64_entropy, self.hex_entropy, self.confidence = min_length, base64_entropy, hex_entropy, confidence

    def detect(self, text: str) -> list[Span]:
        out = []
        for m in re.finditer(P.SECRET_RUN, text):
            run, bits = m[0], round(entropy_text(m[0]), 9)
            hexes = re.fullmatch("[0-9a-fA-F]+", run)
            enough = bits >= self.hex_entropy and len(run) >= P.HEX_LENGTH if hexes else bits >= self.base64_entropy
            if len(run) >= self.min_length and not re.fullmatch("[A-Za-z]+", run) and enough:
                out.append(Span(m.start(), m.end(), run, "secret", self.confidence, self.name, {"entropy": f"{entropy_text(run):.2f}"}))
        return out


class CustomDetector:
    """The user's words, as one alternation in their order (``wordlist``), and expressions; no match is empty."""

    name = "custom"

    def __init__(self, words: Iterable[str] = (), patterns: Iterable[str] = (), case_sensitive: bool = False):
        from quillmask.functions.wordlist import WordList

        self.words = WordList(tuple(words), case_sensitive)
        self.regexes = [re.compile(p, 0 if case_sensitive else re.IGNORECASE) for p in patterns]

    def detect(self, text: str) -> list[Span]:
        return self.words.detect(text) + [Span(m.start(), m.end(), m[0], "custom", 1.0, self.name) for r in self.regexes for m in r.finditer(text) if m[0]]


class ContextDetector:
    """Nine bare digits after a word that speaks of social security."""

    name = "contextual"

    def detect(self, text: str) -> list[Span]:
        return [
            Span(m.start(), m.end(), m[0], "ssn", P.BARE_SSN_CONFIDENCE, self.name)
            for m in re.finditer(P.BARE_SSN, text)
            if _any(P.BOOST_WORDS["ssn"], text[max(0, m.start() - P.BOOST_WINDOW) : m.start()])
        ]


def _any(words: Iterable[str], text: str) -> bool:
    low = text.lower()
    return any(w in low for w in words)


def adjust(text: str, spans: list[Span]) -> list[Span]:
    """Raises confidence after a word of the span's kind, then lowers it near a placeholder word."""
    for s in spans:
        if _any(P.BOOST_WORDS.get(s.entity_type, ()), text[max(0, s.start - P.BOOST_WINDOW) : s.start]):
            s.confidence = min(1.0, s.confidence + P.BOOST)
            s.meta["context"] = "boosted"
        if _any(P.SUPPRESS_WORDS, text[max(0, s.start - P.SUPPRESS_WINDOW) : s.start]) or _any(P.SUPPRESS_WORDS, s.text):
            s.confidence = max(0.0, s.confidence - P.SUPPRESS)
            s.meta["context"] = "suppressed"
    return spans


def resolve(spans: list[Span]) -> list[Span]:
    """From the surest (then longest, then first) on, what overlaps nothing kept; by start."""
    ends: list[int] = []  # of what is kept, ascending; kept spans are disjoint
    kept: list[Span] = []
    for s in sorted(spans, key=lambda s: (-s.confidence, s.start - s.end, s.start)):
        place = bisect_right(ends, s.start)  # the first kept span that ends after this one starts
        if place == len(ends) or kept[place].start >= s.end:
            ends.insert(place, s.end)
            kept.insert(place, s)
    return kept


def rendered(span: Span, policy: Policy) -> str:
    if span.entity_type in policy.replacements:
        return policy.replacements[span.entity_type]
    if policy.mode == "mask":
        keep = min(max(0, policy.mask_keep_last), len(span.text))
        return policy.mask_char * (len(span.text) - keep) + span.text[len(span.text) - keep :]
    if policy.mode == "pseudonymize":
        code = hmac.new(policy.hmac_key or b"", span.text.encode(), hashlib.sha256).hexdigest()
        return f"<{span.entity_type.upper()}_{code[:10]}>"
    return policy.replacement


def spliced(text: str, spans: list[Span], policy: Policy) -> str:
    edges = [0, *(s.end for s in spans)]
    starts = [*(s.start for s in spans), len(text)]
    parts = [text[a:b] for a, b in zip(edges, starts, strict=True)]
    return parts[0] + "".join(rendered(s, policy) + gap for s, gap in zip(spans, parts[1:], strict=True))


class LocalEngine:
    """All tiers of these settings, in the order that breaks ties."""

    def __init__(self, settings: Settings):
        self.settings = settings
        tiers: list = [ShapeDetector(settings)]
        if settings.custom_words or settings.custom_patterns:
            tiers.append(CustomDetector(settings.custom_words, settings.custom_patterns))
        if settings.use_ner:
            from quillmask.operators.arrow_tiers import NerDetector

            tiers.append(NerDetector(settings.ner_model))
        if settings.entropy_on:
            tiers.append(EntropyDetector(*settings.entropy_knobs))
        tiers += settings.extra_detectors
        if settings.load_plugins:
            from quillmask.operators.arrow_tiers import plugins

            tiers += plugins()
        if settings.wants("ssn"):
            tiers.append(ContextDetector())
        self.tiers = tiers

    def detect(self, text: str) -> list[Span]:
        found = [replace(s, meta=dict(s.meta)) for t in self.tiers for s in t.detect(text)]
        return resolve([s for s in adjust(text, found) if s.confidence >= self.settings.min_confidence])

    def redact(self, text: str) -> str:
        return spliced(text, self.detect(text), self.settings.policy)


class Later:
    """Makes its engine at the first call, so a task makes one, whatever its number of batches or keys."""

    def __init__(self, settings: Settings):
        self.settings, self.engine = settings, None

    def __call__(self) -> LocalEngine:
        if self.engine is None:
            self.engine = LocalEngine(self.settings)
        return self.engine
