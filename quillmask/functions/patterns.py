"""Shapes of known credentials and identifiers, and their translation to Java's dialect.

The expressions are Python's, whose classes know Unicode; ``java`` spells those classes out, since
Java's plain ones are ASCII and its Unicode ones differ.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Shape:
    kind: str
    regex: str
    confidence: float
    check: str | None = None
    group: int = 0
    #: Literals of which every match has one; DIGIT: every match has a decimal digit.
    needs: tuple[str, ...] = ()
    #: What stands before the expression in a plan: a look at the first character, which fails sooner.
    lead: str = ""


DIGIT = ("<digit>",)
HAS_DIGIT = r"\p{Nd}"
DIGIT_LEAD = r"(?=\d)"


# Patterns, confidences and their order, which breaks ties.
SHAPES = (
    Shape("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0.95, needs=("@",), lead=r"(?=[A-Za-z0-9._%+-])"),
    Shape("private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+?-----END [A-Z0-9 ]*PRIVATE KEY-----", 0.99, needs=("PRIVATE KEY-----",)),
    Shape("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b", 0.95, needs=("eyJ",)),
    Shape("aws_key", r"\b(?:AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16}\b", 0.98, needs=("AKIA", "ASIA", "ABIA", "ACCA")),
    Shape("github_token", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{22,255})\b", 0.98, needs=("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_")),
    Shape("slack_token", r"\bxox[baprs]-[0-9A-Za-z]{10,48}(?:-[0-9A-Za-z]{10,48}){0,3}\b", 0.98, needs=("xox",)),
    Shape("slack_webhook", r"https://hooks\.slack\.com/services/T[A-Z0-9]{8,}/B[A-Z0-9]{8,}/[A-Za-z0-9]{16,}", 0.98, needs=("https://hooks.slack.com/services/T",)),
    Shape("stripe_key", r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,99}\b", 0.97, needs=("k_live_", "k_test_")),
    Shape("google_api_key", r"\bAIza[0-9A-Za-z_-]{35}\b", 0.95, needs=("AIza",)),
    Shape("sendgrid_key", r"\bSG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}\b", 0.98, needs=("SG.",)),
    Shape("twilio_key", r"\bSK[0-9a-f]{32}\b", 0.9, needs=("SK",)),
    Shape("npm_token", r"\bnpm_[A-Za-z0-9]{36}\b", 0.98, needs=("npm_",)),
    Shape(
        "api_key",
        r"(?i)\b(?:api[_-]?key|apikey|secret[_-]?key|secret|access[_-]?token|auth[_-]?token|token|password|passwd|pwd)\b"
        r"\s*[:=]\s*[\"']?([A-Za-z0-9_\-./+]{12,128})[\"']?",
        0.75,
        group=1,
        needs=(":", "="),
        lead=r"(?i)(?=[aspt])",
    ),
    Shape("credit_card", r"(?<![\d-])(?:\d[ -]?){12,18}\d(?![\d-])", 0.9, "luhn", needs=DIGIT, lead=DIGIT_LEAD),
    Shape("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", 0.85, "ssn", needs=DIGIT, lead=DIGIT_LEAD),
    Shape("ipv4", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d)(?!\.\d)", 0.9, needs=DIGIT, lead=DIGIT_LEAD),
    Shape("ipv6", r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])", 0.9, "ipv6", needs=(":",), lead=r"(?=[0-9A-Fa-f:])"),
    Shape("phone", r"(?<![\w.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?|\(\d{1,4}\)[ .-]?)\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?![\w-])(?!\.\d)", 0.6, "phone", needs=DIGIT, lead=r"(?=[+(])"),
    Shape("phone", r"(?<![\w.+(-])\d{2,4}(?:[ .-]\d{2,4}){2,4}(?![\w-])(?!\.\d)", 0.45, "phone", needs=DIGIT, lead=DIGIT_LEAD),
)

# The entropy tier.
SECRET_RUN = r"[A-Za-z0-9+/=_-]{20,}"
# A run is found at its start or not at all.
SECRET_LEAD = r"(?<![A-Za-z0-9+/=_-])"
# A run of letters alone is no secret. The first other character of a run of 20 has 10 letters before it or 10
# characters of the run behind it: rare in prose, and found by a look at one character at most places.
SECRET_HINT = r"[0-9+/=_-](?:[A-Za-z0-9+/=_-]{10}|(?<=[A-Za-z]{10}[0-9+/=_-]))"
SECRET_LENGTH, SECRET_CONFIDENCE = 24, 0.6
BASE64_FLOOR, HEX_FLOOR, HEX_LENGTH = 4.0, 3.0, 32

# The contextual tier.
BARE_SSN = r"(?<![\d-])\d{9}(?![\d-])"
BARE_SSN_CONFIDENCE = 0.8
BOOST_WINDOW, SUPPRESS_WINDOW = 48, 16
BOOST, SUPPRESS = 0.2, 0.4
BOOST_WORDS = {
    "ssn": ("ssn", "social security", "social-security"),
    "phone": ("phone", "tel", "mobile", "cell", "fax", "call"),
    "credit_card": ("card", "visa", "mastercard", "amex", "cc", "payment"),
    "email": ("email", "e-mail", "mail", "contact"),
    "api_key": ("key", "secret", "token", "password", "credential", "auth"),
    "ipv4": ("ip", "host", "server", "addr"),
    "ipv6": ("ip", "host", "server", "addr"),
}
SUPPRESS_WORDS = ("example", "sample", "dummy", "test", "fake", "placeholder", "lorem", "xxx-xx")

_WORD = r"\p{L}\p{N}_"
_IN_CLASS = {"w": _WORD, "d": r"\p{Nd}", "s": r"\s\p{Z}\x1c-\x1f\x85"}
_EDGE = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"


def java(regex: str) -> str:
    """A Python expression of the kinds used here, in Java's dialect."""
    out, inside, at = [], False, 0
    while at < len(regex):
        c = regex[at]
        if c == "\\":
            kind = regex[at + 1]
            if kind == "b" and not inside:
                out.append(_EDGE)
            elif kind in _IN_CLASS:
                out.append(_IN_CLASS[kind] if inside else f"[{_IN_CLASS[kind]}]")
            else:
                out.append(c + kind)
            at += 2
            continue
        inside = c == "[" or inside and c != "]"
        out.append(c)
        at += 1
    return "".join(out).replace("(?i)", "(?iu)")
