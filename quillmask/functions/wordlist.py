"""Many literal words at once: an Aho-Corasick automaton with the choice of an alternation.

At each place the first word, in the user's order, that begins there is taken, and the search goes on
behind it, as in ``re`` with all words in one alternation. The automaton reports every occurrence; a word
that has an earlier word as its beginning can never be taken and is left out. Letter case is folded
character by character, so places stay; characters that ``re.IGNORECASE`` takes for equal are equal.
"""

from __future__ import annotations

import pickle
import re
import sys
from collections.abc import Iterable
from functools import lru_cache

from quillmask.functions.local import Span

try:
    import ahocorasick
except ImportError:  # the words then go through one alternation, as few words do
    ahocorasick = None

#: Lists up to this length are as fast in an alternation.
FEW = 24
#: Most bytes of an automaton that goes to every worker.
MOST_BYTES = 256 << 20


@lru_cache(maxsize=1)
def folds() -> dict[int, str]:
    """Each character that has cases to the one that stands for all it equals.

    Characters are equal if simple lower or upper case joins them, or a full case folding of several
    characters that they share.
    """
    above: dict[str, str] = {}

    def root(c: str) -> str:
        while above.get(c, c) != c:
            c = above[c]
        return c

    def join(a: str, b: str) -> None:
        a, b = sorted((root(a), root(b)))
        above.setdefault(a, a)
        above[b] = a

    long: dict[str, str] = {}
    for c in map(chr, range(sys.maxunicode + 1)):
        low, up, full = c.lower(), c.upper(), c.casefold()
        if low == up == full == c:
            continue
        for other in (low[:1] if c == "İ" else low, up):  # its simple lower case is i
            if len(other) == 1:
                join(c, other)
        if len(full) > 1:
            join(c, long.setdefault(full, c))
    return {ord(c): low if len(low := root(c).lower()) == 1 else root(c) for c in above}


def folded(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(folds())


class WordList:
    """A detector of literal words."""

    name = "custom"

    def __init__(self, words: Iterable[str], case_sensitive: bool = False):
        self.fold = (lambda t: t) if case_sensitive else folded
        self.case_sensitive = case_sensitive
        self.words = [self.fold(w) for w in words if w]
        self.automaton, self.regex = None, None
        if ahocorasick is None or len(self.words) <= FEW:
            flags = 0 if case_sensitive else re.IGNORECASE
            self.regex = re.compile("|".join(re.escape(w) for w in words if w), flags) if self.words else None
            return
        order: dict[str, int] = {}
        for rank, word in enumerate(self.words):
            order.setdefault(word, rank)
        found = ahocorasick.Automaton()
        for word, rank in order.items():
            if not any(order.get(word[:k], rank) < rank for k in range(1, len(word))):
                found.add_word(word, (rank, len(word)))
        found.make_automaton()
        self.automaton = found

    def __getstate__(self) -> dict:
        return {"case_sensitive": self.case_sensitive, "automaton": self.automaton, "regex": self.regex}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.fold = (lambda t: t) if self.case_sensitive else folded

    def places(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the words taken, from left to right."""
        if self.automaton is None:
            return [m.span() for m in self.regex.finditer(text)] if self.regex else []
        first: dict[int, tuple[int, int]] = {}
        for last, (rank, size) in self.automaton.iter(self.fold(text)):
            start = last - size + 1
            if start not in first or rank < first[start][0]:
                first[start] = (rank, size)
        out, at = [], 0
        for start in sorted(first):
            if start >= at:
                at = start + first[start][1]
                out.append((start, at))
        return out

    def detect(self, text: str) -> list[Span]:
        return [Span(a, b, text[a:b], "custom", 1.0, self.name) for a, b in self.places(text)]


class SharedWords:
    """The word list of a broadcast, loaded once in each worker process."""

    name = "custom"
    _loaded: dict[int, WordList] = {}

    def __init__(self, context, words: Iterable[str]):
        packed = pickle.dumps(WordList(words))
        if len(packed) > MOST_BYTES:
            raise ValueError(f"the automaton of the custom words takes {len(packed)} bytes, more than {MOST_BYTES} for each worker: use fewer words at a time")
        self.packed = context.broadcast(packed)
        self.key = hash(packed)

    def detect(self, text: str) -> list[Span]:
        found = self._loaded.get(self.key)
        if found is None:
            self._loaded.clear()  # the list of another run is not kept beside it
            found = self._loaded[self.key] = pickle.loads(self.packed.value)
        return found.detect(text)
