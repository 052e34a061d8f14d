"""Checks of matched text as Column expressions, each beside its twin on Python strings."""

from __future__ import annotations

import ipaddress
import math
import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE, _TAX = r"^(?:19|20)\d{2}-\d{2}-\d{2}$", r"^\d{3}-\d{2}-\d{4}$"


_ZEROS = [z for z in range(0x0660, 0x10000) if chr(z).isdecimal() and int(chr(z)) == 0]
#: Decimal digits of other scripts (those that fit the basic plane and come in tens), and theirs in 0-9.
ODD_DIGITS, PLAIN_DIGITS = "".join(chr(z + k) for z in _ZEROS for k in range(10)), "0123456789" * len(_ZEROS)


def _ascii_digits(text: Column) -> Column:
    """Decimal digits of any script as 0-9, the rest dropped."""
    plain = F.translate(text, ODD_DIGITS, PLAIN_DIGITS)
    return F.regexp_replace(F.when(text.rlike(r"[^\x00-\x7F]"), plain).otherwise(text), "[^0-9]", "")


def luhn_ok(text: Column) -> Column:
    """13 to 19 digits, every second from the right doubled, sum divisible by 10."""
    digits = _ascii_digits(text)
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def ssn_ok(text: Column) -> Column:
    area = F.substring(text, 1, 3)
    return ~area.isin("000", "666") & ~area.startswith("9") & (F.substring(text, 5, 2) != "00") & (F.substring(text, 8, 4) != "0000")


def phone_ok(text: Column) -> Column:
    """Not shaped like a date or a tax number, 7 to 15 digits."""
    date, tax = (rx.replace(r"\d", r"\p{Nd}") for rx in (_DATE, _TAX))
    return ~text.rlike(date) & ~text.rlike(tax) & F.length(F.regexp_replace(text, r"\P{Nd}", "")).between(7, 15)


def ipv6_ok(text: Column) -> Column:
    """For text of groups and colons: 8 groups, or fewer around one double colon."""
    groups, double = F.split(text, ":"), (F.length(text) - F.length(F.regexp_replace(text, "::", ""))) / 2
    full = (F.size(groups) == 8) & ~F.exists(groups, lambda g: g == "")
    edges = ~text.rlike("^:[^:]") & ~text.rlike("[^:]:$")
    filled = F.size(F.filter(groups, lambda g: g != "")) <= 7
    return full | ((double == 1) & ~text.contains(":::") & edges & filled)


def shannon_entropy(text: Column) -> Column:
    """Bits a character; 0 for empty text."""
    n = F.length(text).cast("double")
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.when(n > 0, F.aggregate(chars, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))).otherwise(F.lit(0.0))


CHECKS = {"luhn": luhn_ok, "ssn": ssn_ok, "phone": phone_ok, "ipv6": ipv6_ok}


def luhn_text(text: str) -> bool:
    digits = [int(c) for c in text if c.isdecimal()]
    doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
    return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0


def ssn_text(text: str) -> bool:
    area, group, serial = re.split(r"[-\s]", text)
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


def phone_text(text: str) -> bool:
    shaped = re.search(_DATE, text.strip()) or re.search(_TAX, text.strip())
    return not shaped and 7 <= sum(map(str.isdecimal, text)) <= 15


def ipv6_text(text: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(text.partition("%")[0]))
    except ValueError:
        return False


def entropy_text(text: str) -> float:
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in Counter(text).values()) if n else 0.0


TEXT_CHECKS = {"luhn": luhn_text, "ssn": ssn_text, "phone": phone_text, "ipv6": ipv6_text}
