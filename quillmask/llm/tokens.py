"""Token ids of whole texts by the tokenizers library, with one encoding per distinct piece.

A text is cut only where its pre-tokeniser always cuts, so the ids of the pieces in a row are the
ids of the text. The pieces' ids are cached as little-endian unsigned 32-bit bytes per task.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillmask.llm.words import give_back

#: Pieces held in a task; when it is full only those of the batch stay, which changes no result.
CACHE_PIECES = 400_000
LONG_PIECE = 200
#: Pieces encoded as one text.
JOINED = 1000
#: Where a vocabulary keeps spaces, one is a sure cut only between two characters that are not white space.


#: Letters that every version of Unicode knows, composed already, and signs that may follow them: they
#: begin a pre-token of their own, no contraction (') and no special token (<).
_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=>?@\\[-`{-~]*)")


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: visible Latin-1 characters
    for themselves, the others from code point 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in own]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


_CHARACTERS = _byte_characters()


class Pieces:
    """``spaced``: the vocabulary keeps a space at the head of the following word (byte-level
    pre-tokeniser without added prefix); otherwise white space is dropped by the tokeniser."""

    def __init__(self, path: str, spaced: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = spaced
        self.mark_id, added = max(self.tokenizer.get_added_tokens_decoder().items())
        self.mark = added.content
        self.tokens_of = self.tokenizer.model.tokenize
        self.four = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size() + 1)]
        self.tails: dict[str, bytes] = {"": b""}
        self.cache: dict[str, bytes | None] = {}
        self.heads: dict[str, bytes | None] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined_ids(self, texts: list[str]) -> list[bytes]:
        """The ids of many short texts, encoded as few long ones: a special token between two texts
        cuts them apart before any other rule, and its id marks the places."""
        joins = [texts[i : i + JOINED] for i in range(0, len(texts), JOINED)]
        out: list[bytes] = []
        for part, encoding in zip(joins, self.tokenizer.encode_batch_fast([self.mark.join(p) for p in joins], add_special_tokens=False), strict=True):
            ids = np.asarray(encoding.ids, "<u4")
            cut = 4 * np.flatnonzero(ids == self.mark_id)
            if len(cut) != len(part) - 1:
                raise ValueError("the special token did not part the texts")
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *(cut + 4).tolist()], [*cut.tolist(), len(raw)], strict=True)]
        return out

    def _word_ids(self, word: str, lead: str) -> bytes:
        """The ids of one pre-token of letters, straight from the vocabulary's model."""
        if not word.isascii():
            word = (word if self.spaced else word.lower()).encode().decode("latin-1").translate(_CHARACTERS)
        elif not self.spaced:
            word = word.lower()
        four = self.four
        return b"".join([four[t.id] for t in self.tokens_of(lead + word)])

    def _each(self, texts: list[str], lead: str) -> list[bytes]:
        """Letters are one pre-token whatever the pre-tokeniser, and signs after them another, so both
        skip it; texts that hold a special token are encoded alone."""
        found: dict[str, bytes] = {}
        marked, odd = [], []
        first = " ".translate(_CHARACTERS) if lead else ""
        for t in texts:
            if cut := _WORD.fullmatch(t):
                word, tail = cut.groups()
                if tail not in self.tails:
                    self.tails[tail] = self._ids([tail])[0]
                found[t] = (tail and self.cache.get(word) if lead or not self.spaced else None) or self._word_ids(word, first)
                found[t] += self.tails[tail]
            else:
                (odd if "<|" in t else marked).append(t)
        found.update(zip(marked, self._joined_ids([lead + t for t in marked]), strict=True))
        found.update(zip(odd, self._ids([lead + t for t in odd]), strict=True))
        return [found[t] for t in texts]

    def _fill(self, cache: dict[str, bytes | None], wanted: list[str], lead: str) -> list[str]:
        """Encodes what ``cache`` lacks; returns the long pieces, which go again after the batch."""
        missing = [p for p in wanted if p not in cache]
        if len(cache) + len(missing) > CACHE_PIECES:
            held = {p: cache[p] for p in wanted if p in cache}
            cache.clear()
            cache.update(held)
        sure = [p for p in missing if not self.spaced or p and p == p.strip()]
        cache.update(dict.fromkeys(missing))
        cache.update(zip(sure, self._each(sure, lead), strict=True))
        return [p for p in missing if len(p) > LONG_PIECE]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. A batch's pieces are told apart by Arrow, each different one is looked
        up once, and the ids of all are laid out in one step."""
        if not texts:
            return []
        text = pa.array(texts, pa.large_string())
        parts = pc.split_pattern(text if self.spaced else pc.replace_substring(text, "\n", " "), " ")
        told = parts.flatten().dictionary_encode()
        different, which = told.dictionary.to_numpy(zero_copy_only=False).tolist(), told.indices.to_numpy()
        edges = parts.offsets.to_numpy()
        long = self._fill(self.cache, different, " " if self.spaced else "")
        ids = [*map(self.cache.__getitem__, different), b""]
        if self.spaced:
            which = which.copy()
            heads_of = which[edges[:-1]]
            which[edges[:-1]] = len(different)  # the heads have no space before them and are put in below
        laid = pa.array(ids, pa.large_binary()).take(pa.array(which))
        raw = memoryview(laid.buffers()[2] or b"")
        cut = np.frombuffer(laid.buffers()[1], np.int64)[edges].tolist()
        out = [bytes(raw[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        if self.spaced:
            lead = [different[k] for k in heads_of]
            heads = self._fill(self.heads, list(dict.fromkeys(lead)), "")
            # A piece without ids stands beside more than one space: such a text is encoded whole.
            blank = np.fromiter((i is None for i in ids), bool, len(ids))[which]
            whole = np.add.reduceat(blank, edges[:-1]) > 0
            out = [self._ids([texts[k]])[0] if whole[k] or self.heads[h] is None else self.heads[h] + out[k] for k, h in enumerate(lead)]
            for p in heads:
                self.heads.pop(p, None)
        for p in long:
            self.cache.pop(p, None)
        return out


@contextmanager
def pieces(path: str, spaced: bool) -> Iterator[Pieces]:
    """The tokeniser of one task. Its worker lives on for other stages, so the vocabulary and the cache,
    some 150 MB, go back to the system when the task ends."""
    held = Pieces(path, spaced)
    try:
        yield held
    finally:
        held.__dict__.clear()
        give_back()
