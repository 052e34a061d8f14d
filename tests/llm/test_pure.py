"""Operators' parts that need no Spark, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from quillmask.llm import avi, bits, editprint, huffman, language, packing, toxicity  # noqa: E402
from quillmask.llm.tokens import Pieces  # noqa: E402
from quillmask.llm.words import Words, runs  # noqa: E402


def test_words_and_hashes():
    texts = [b"  a bb\tccc\n", b"", b"bb a\x0b" + b"x" * 1000, "é z".encode()]
    words = Words(texts)
    found = [words.data[a:b] for a, b in zip(words.start, words.end, strict=True)]
    assert found == [w for t in texts for w in re.findall(rb"[^\x20\x09-\x0D]+", t)] and words.count.tolist() == [3, 0, 3, 1]
    h = dict(zip(found, words.hashes().tolist(), strict=True))
    assert len(set(h.values())) == len(h) and Words([b"bb"]).hashes()[0] == h[b"bb"]
    assert Words([b"AB Cd"], lower=True).hashes().tolist() == Words([b"ab cd"]).hashes().tolist()
    x = Words([b"p q r s p q"]).hashes()
    assert runs(x, 2)[0] == runs(x, 2)[4] != runs(x, 2)[1]


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_equal_whole_texts(name, spaced):
    p, rng = Pieces(public_tokenizers.path(name), spaced), random.Random(1)
    letters = " \n\tab's'éÉ1٣  .,$<|endoftext|>́ \x1c\x85 Iİſσς"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += ["", " ", "a <|endoftext|>b<|startoftext|> c  d", "w" * 5000, "one two\nthree, four. " * 50]
    for _ in range(2):
        assert p.encode(texts) == [np.asarray(e.ids, "<u4").tobytes() for e in p.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_prints():
    rng, inserted = random.Random(2), []
    for _ in range(15):
        text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
        like = lambda other, own=editprint.fingerprint(text): editprint.likeness(own, editprint.fingerprint(other))
        # A walk falls back into step after most edits, not after every one.
        inserted.append(like(text[:1500] + "X" + text[1500:]))
        assert like(str(text)) == 1 and like(text[::-1]) < 0.15 and 0.65 <= like(text[:2250] + text[:750]) <= 0.85
    assert min(inserted) > 0.4 and np.median(inserted) > 0.9
    for t, n in (("", ""), ("", "abc"), ("abc", "x"), ("abcdefgh" * 9, "zz"), (text, "é😀" * 999)):
        assert editprint.Walked(t).edit(n) == (editprint.edited(t, n), editprint.fingerprint(editprint.edited(t, n)))
    assert editprint.likeness(editprint.fingerprint(""), editprint.fingerprint("")) == 1
    assert editprint.likeness(editprint.fingerprint(""), editprint.fingerprint(text)) == 0


@pytest.mark.parametrize("near", [0.5, 0.8, 1.0])
def test_near_prints_share_a_band(near):
    """Prints of any two lengths that differ in as many places as near prints may."""
    rng, equal = random.Random(9), near * (1 - editprint.CHANCE) + editprint.CHANCE
    for n in range(1, 257):
        for m in {n, min(256, n + 1), min(256, int(n / equal + 1e-9))}:
            x = [rng.choice("0123456789abcdef") for _ in range(m)]
            y = x[:n]
            for at in rng.sample(range(n), int(n - equal * m + 1e-9)):
                y[at] = "0" if y[at] == "f" else "f"
            a, b = (f"0-{len(d):x}-" + "".join(d) for d in (x, y))
            if editprint.likeness(a, b) >= near:
                assert set(editprint.bands(a, near)) & set(editprint.bands(b, near))


def test_packing_bounds():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sizes = rng.integers(1, 41, rng.integers(1, 10))
        bins, offsets = packing.best_fit(sizes, 40)
        for b in set(bins.tolist()):
            held = sorted(zip(offsets[bins == b].tolist(), sizes[bins == b].tolist(), strict=True))
            assert [o for o, _ in held] == np.cumsum([0, *[n for _, n in held]])[:-1].tolist() and sum(n for _, n in held) <= 40
        assert packing.lower_bound(sizes, 40) <= _fewest(sizes.tolist(), 40) <= bins.max() + 1


def _fewest(sizes, length):
    best = len(sizes)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k, room in enumerate(rooms):
            if room >= sizes[i]:
                put(i + 1, rooms[:k] + [room - sizes[i]] + rooms[k + 1 :])
        put(i + 1, [*rooms, length - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    put(0, [])
    return best


@pytest.mark.parametrize("counts", [[5], [3, 0, 1], list(range(1, 40)), [2**i for i in range(30)], [1] * 1000])
def test_code_lengths(counts):
    import heapq

    sizes = huffman.code_sizes(np.array(counts))
    assert sizes.max() <= 16 and (sizes > 0).tolist() == [c > 0 for c in counts]
    assert sum(2.0**-s for s in sizes if s) <= 1
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    cost = heap[0] if len(heap) == 1 else 0
    while len(heap) > 1:
        heapq.heappush(heap, s := heapq.heappop(heap) + heapq.heappop(heap))
        cost += s
    if len(counts) < 17 or max(counts) < 50:  # no length reaches the limit: as short as plain Huffman
        assert int((sizes * np.array(counts)).sum()) == cost


def test_blocks_round_trip():
    rng = np.random.default_rng(4)
    ids = [rng.zipf(1.3, n) % 3000 for n in (1, 255, 256, 257, 5000)]
    sizes = huffman.code_sizes(np.bincount(np.concatenate(ids), minlength=3000))
    coded = [huffman.encode_block(x, sizes, bits.canonical(sizes)) for x in ids]
    back = huffman.decode_blocks([p for p, _ in coded], [o for _, o in coded], [len(x) for x in ids], bits.lookup(sizes))
    assert back.tolist() == np.concatenate(ids).tolist()


def test_avi_round_trip_and_shots():
    rng = np.random.default_rng(5)
    texts = [b"", b"\xff" * 576, rng.integers(0, 256, 5000).astype(np.uint8).tobytes(), bytes(range(256)) * 3, b"abc" * 700]
    media = avi.stored(texts)
    assert [s.tobytes() for s in avi.read_back(media)] == [avi.padded(t) for t in texts]
    assert all(m[:4] == b"RIFF" and int.from_bytes(m[4:8], "little") == len(m) - 8 and m[8:12] == b"AVI " for m in media)
    assert avi.stored([texts[2]])[0] == media[2] == avi.write_avi(avi.read_avi(media[2]))
    still = np.concatenate([np.full((10, 576), 65, np.uint8), np.full((7, 576), 200, np.uint8)])
    assert avi.cuts(still)[0] == [10] and avi.clips(still) == [(0, 0, 400), (1, 400, 680)]
    with pytest.raises(ValueError):
        avi.read_avi(b"RIFF1234WAVE")


def test_diff_codes_are_a_prefix_code():
    for d in range(-255, 256):
        code, size = int(avi.DIFF_CODE[d + 255]), int(avi.DIFF_BITS[d + 255])
        for fill in (0, (1 << (16 - size)) - 1):
            at = code << (16 - size) | fill
            assert (avi.DIFFS[at], avi.DIFF_SIZES[at]) == (d, size)


def test_codewords_and_languages():
    for n in (2, 3, 4, 6, 9):
        code = language.codewords(n)
        assert len({tuple(r) for r in code}) == n and len({tuple(c) for c in code.T} | {tuple(-c) for c in code.T}) == 2 * code.shape[1]
    rng = random.Random(6)
    bags = {"x": "the of and to in".split(), "y": "der die und zu ein".split(), "z": "le la et les un".split()}
    make = lambda k: " ".join(rng.choice(bags[k]) for _ in range(30))
    model = language.Codes.fit([make(k) for k in bags for _ in range(40)], [k for k in bags for _ in range(40)])
    best, score, unsure = model.decode([make(k) for k in bags])
    assert [model.langs[b] for b in best] == list(bags) and (score > 0.5).all() and not unsure.any()
    one = language.Codes.fit(["a b"], ["x"])
    assert one.decode(["c"])[1][0] == 1 and language.Codes.fit([], []).langs == []
    assert not language.has_letter("12 $$ ") and language.has_letter("1é")


@pytest.mark.parametrize("n", [6, 7, 9, 20, 30, 40, 50, 60, 62, 63, 70, 100, 300])
def test_codewords_are_apart(n):
    code = language.codewords(n)
    apart = (code[:, None] != code[None]).sum(axis=2)[~np.eye(n, dtype=bool)]
    assert code.shape[0] == n and apart.min() >= 3 and apart.min() == language.distance(code)
    assert len({tuple(c) for c in code.T} | {tuple(-c) for c in code.T}) == 2 * code.shape[1]


def test_more_languages_than_a_word_has_bits():
    rng = random.Random(8)
    bags = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(6)] for k in range(66)}
    make = lambda k: " ".join(rng.choice(bags[k]) for _ in range(30))
    model = language.Codes.fit([make(k) for k in bags for _ in range(6)], [k for k in bags for _ in range(6)])
    best, _, _ = model.decode([make(k) for k in bags])
    assert [model.langs[b] for b in best] == list(bags)


@pytest.mark.parametrize("n", [2, 3, 4, 30])
def test_letter_noise_has_no_language(n):
    rng = random.Random(10)
    bags = [["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(8)] for _ in range(n)]
    make = lambda bag: " ".join(rng.choice(bag) for _ in range(30))
    model = language.Codes.fit([make(b) for b in bags for _ in range(40)], [f"l{k:02}" for k in range(n) for _ in range(40)])
    assert model.known([make(b) for b in bags for _ in range(20)]).mean() > 0.98
    noise = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(400)) for _ in range(20)]
    noise += ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(400)) for _ in range(20)]
    assert not model.known(noise).any()
    assert language.Codes.fit(["a b"], ["x"]).known(noise).all()


def test_toxicity_learns_words_and_forms():
    rng = random.Random(7)
    plain = "one two three four five six seven eight".split()
    make = lambda bad: " ".join([rng.choice(plain) for _ in range(40)] + ([rng.choice(["grubzing", "grubzer", "Zlorb!"])] if bad else []))
    places = lambda t: np.unique(toxicity.features([t.encode()])[1])
    examples = [(places(make(k % 3 == 0)), int(k % 3 == 0)) for k in range(400)]
    model = toxicity.Ftrl.fit(examples)
    score = model.score([make(True).encode(), make(False).encode(), b""], model.dense())
    assert score[0] > 0.5 > score[1] and 0 < score[2] < 0.5 and len(model.place) < 2000


def test_sub_words_do_not_cross_texts():
    both = toxicity.features([b"abcdef", b"ghijkl mn"])
    alone = [toxicity.features([t])[1] for t in (b"abcdef", b"ghijkl mn")]
    for i in (0, 1):
        assert sorted(both[1][both[0] == i].tolist()) == sorted(alone[i].tolist())


def test_edited_text_digest():
    whole, _ = editprint.Walked("abcdefgh").edit("XYZ")
    assert hashlib.sha256(whole.encode()).hexdigest() == hashlib.sha256(b"abcdefXY").hexdigest()
