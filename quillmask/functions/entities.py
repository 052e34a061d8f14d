"""Kinds of sensitive text, and the settings of a run."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from quillmask.functions import patterns as P

# The closed list of entity types, in natural order.
ENTITY_TYPES = (
    "email", "phone", "credit_card", "ssn", "ipv4", "ipv6",
    "aws_key", "github_token", "api_key", "jwt", "private_key", "slack_token", "slack_webhook",
    "stripe_key", "google_api_key", "sendgrid_key", "twilio_key", "npm_token",
    "secret", "person", "org", "loc", "custom",
)

#: Spark type of one detection; offsets count code points, half open.
SPAN_DDL = "struct<start:int,end:int,text:string,entity_type:string,confidence:double,source:string,meta:map<string,string>>"
SPAN_FIELDS = ("start", "end", "text", "entity_type", "confidence", "source", "meta")

CHUNK_CHARS = 64 * 1024
OVERLAP_CHARS = 4 * 1024
MODES = ("replace", "mask", "pseudonymize")


def entity_type(name: str) -> str:
    """The type of this name, trimmed and in lower case; raises for any other."""
    found = str(name).strip().lower()
    if found not in ENTITY_TYPES:
        raise ValueError(f"no entity type {name!r}; there are: {', '.join(ENTITY_TYPES)}")
    return found


@dataclass(frozen=True)
class Policy:
    """What stands in place of a detection. A type's own replacement beats the mode."""

    mode: str = "replace"
    replacement: str = "[REDACTED]"
    replacements: dict[str, str] = field(default_factory=dict)
    mask_keep_last: int = 4
    mask_char: str = "*"
    hmac_key: bytes | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"no mode {self.mode!r}; there are: {', '.join(MODES)}")
        if self.mode == "pseudonymize" and not self.hmac_key:
            raise ValueError("pseudonymize needs an hmac_key")
        object.__setattr__(self, "replacements", {entity_type(k): v for k, v in self.replacements.items()})


@dataclass(frozen=True)
class Settings:
    """Which detectors run and how sure they must be. ``types`` None: all."""

    types: tuple[str, ...] | None = None
    policy: Policy = field(default_factory=Policy)
    min_confidence: float = 0.5
    custom_words: tuple[str, ...] = ()
    custom_patterns: tuple[str, ...] = ()
    use_ner: bool = False
    ner_model: str = "en_core_web_sm"
    use_entropy: bool = True
    entropy_min_length: int = P.SECRET_LENGTH
    entropy_base64: float = P.BASE64_FLOOR
    entropy_hex: float = P.HEX_FLOOR
    entropy_confidence: float = P.SECRET_CONFIDENCE
    extra_detectors: tuple = ()
    load_plugins: bool = True
    chunk_size: int = CHUNK_CHARS
    overlap: int = OVERLAP_CHARS
    #: Detectors in Python cannot connect to other machines while they run.
    offline: bool = True

    def __post_init__(self) -> None:
        if self.types is not None:
            object.__setattr__(self, "types", tuple(entity_type(t) for t in self.types))
        for name in ("custom_words", "custom_patterns", "extra_detectors"):
            value = getattr(self, name)
            object.__setattr__(self, name, (value,) if isinstance(value, str) else tuple(value))
        if self.overlap < 0:
            raise ValueError("overlap must not be negative")
        if self.chunk_size <= 0:
            raise ValueError("chunk_size must be positive")

    def wants(self, kind: str) -> bool:
        return self.types is None or kind in self.types

    @property
    def entropy_knobs(self) -> tuple[int, float, float, float]:
        """Least length, least bits a character of base64 and of hex runs, confidence."""
        return self.entropy_min_length, self.entropy_base64, self.entropy_hex, self.entropy_confidence

    @property
    def entropy_on(self) -> bool:
        return self.use_entropy and self.wants("secret")


def settings(types: Iterable[str] | None = None, **rest) -> Settings:
    return Settings(types=None if types is None else tuple(types), **rest)
