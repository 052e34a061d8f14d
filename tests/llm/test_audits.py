"""Operators 11 to 13 on small tables with nulls, ties, repeated rows, odd ids and clashing columns,
against brute force; tries also by themselves."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmask.llm import audit, divergence, tries

SCHEMA = "doc_id long, text string, lang string, source string, n long, key long, mask int, digest string, owner string"
TOP = 2**63 - 1
PICK = random.Random(5)
WORDS = ["alpha", "Beta", "GAMMA", "delta", "eps", "zeta", "été", "ÉTÉ", "naïve", "x1y", "日本", "o'clock"]


def _rows():
    texts = [None, "", " \t\n", "Hi THERE", "a # b", "one two " * 150, " ".join(f"w{i}" for i in range(400)), "ALL CAPS " * 120, "price $5 " + " ".join(f"v{i}" for i in range(250)), " wide ", "long " + "y" * 200_000]
    texts += [" ".join(PICK.choice(WORDS) for _ in range(PICK.randrange(1, 60))) for _ in range(60)]
    out = []
    for i in range(240):
        text = "the text of very many copies" if i % 3 == 0 else texts[PICK.randrange(len(texts))]
        doc_id = None if i % 17 == 5 else (TOP - i if i % 11 == 0 else -TOP + i if i % 13 == 0 else 2**53 + i)
        out.append((doc_id, text, ("en", "fr", None, "")[i % 4], ("hot", "hot", None, "", "b", "c")[PICK.randrange(6)], 1, 2, 3, "d", "o"))
    return [*out, *out[:9]]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


LABELS = "doc_id long, quality int, toxic int, good int, part string"


def _audit_by_hand(rows, labels):
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    masks = []
    for doc_id, text, _, source, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": doc_id is not None and doc_id > first[text],
        }
        mine = [(q, t) for i, q, t, *_ in labels if i is not None and i == doc_id]
        masks.append((source or "", {k for k, v in fails.items() if v}, any(q == 1 for q, _ in mine), any(t == 1 for _, t in mine)))
    out, shapley = {}, Counter()
    for part in {m[0] for m in masks}:
        here = [m for m in masks if m[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = list(here)
            for step, f in enumerate(order, 1):
                removed = [m for m in left if f in m[1]]
                failing = [m for m in here if f in m[1]]
                left = [m for m in left if f not in m[1]]
                out[part, order, step] = [len(left), len(removed), len(failing) - len(removed), sum(m[1] == {f} for m in here), sum(m[2] for m in removed), sum(m[3] for m in removed)]
                shapley[part, f] += len(removed)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark, documents, empty, rows):
    ids = [r[0] for r in rows]
    labels = [(i, PICK.choice([0, 1, None]), PICK.choice([0, 1, None]), 9, "p") for i in ids[:120]] + [(ids[0], 1, 1, 9, "p"), (None, 1, 1, 9, "p"), (12345, 1, 1, 9, "p")]
    table = spark.createDataFrame(labels, LABELS)
    got = audit.filter_audit(documents, table)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = set(map(tuple, got.collect()))
    assert found == _audit_by_hand(rows, labels) and len(found) == 600 * len({r[3] or "" for r in rows})
    assert audit.filter_audit(empty, table).collect() == []
    assert audit.filter_audit(documents, table.limit(0)).agg({"good_lost": "max"}).first()[0] == 0


@pytest.mark.parametrize(("largest", "limit"), [(True, tries.LIMIT), (False, tries.LIMIT), (True, 3000)])
def test_exact_groups(documents, rows, largest, limit):
    """With small limits tries spill again and again, and the result stays the same."""
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    want = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        want.update((i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids)
    got = tries.exact_groups(documents, largest, limit)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == want


def test_exact_groups_of_nothing_and_documents_kept(documents, empty, rows):
    assert tries.exact_groups(empty).collect() == []
    got = tries.deduplicated(documents)
    assert got.columns == documents.columns
    texts = [r["text"] or "" for r in got.collect()]
    assert set(texts) == {r[1] or "" for r in rows}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"ab", b"b", b"\x00", b"abc" * 9]), max_size=6).map(b"".join), st.none() | st.integers(-5, 5), st.integers(1, 3))), st.integers(0, 60))
def test_trie(given_, limit):
    """Each text is settled by the trie or handed on with all that was known of it."""
    trie, on = tries.Trie(limit), defaultdict(list)
    for text, key, n in given_:
        name = trie.insert(text, key, n)
        if name is not None:
            on[name].append((text, key, n))
        for name, spilled, (least, m) in trie.spill():
            on[name].append((spilled, least, m))
    assert trie.held <= limit or trie.texts <= 1 or trie._largest() is None  # beginnings of a spilled text stay
    settled = {t: (k, n) for t, (k, n) in trie.under(trie.root, b"")}
    handed = defaultdict(set)
    for name, rows in on.items():
        for text, _, _ in rows:
            handed[text].add(name)
    assert not settled.keys() & handed.keys() and all(len(v) == 1 for v in handed.values())
    found = {t: [v] for t, v in settled.items()}
    for rows in on.values():
        for text, key, n in rows:
            found.setdefault(text, []).append((key, n))
    want = defaultdict(list)
    for text, key, n in given_:
        want[text].append((key, n))
    least = lambda vs: min((k for k, _ in vs if k is not None), default=None)
    assert {t: (least(v), sum(n for _, n in v)) for t, v in found.items()} == {t: (least(v), sum(n for _, n in v)) for t, v in want.items()}
    assert not given_ or settled


def _divergence_by_hand(rows):
    docs = [(lang or "", source or "", [w.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source, *_ in rows]
    price = lambda c, n, v: 1 + 10**9 * (c + 2) // (n + 2 * v)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        spread = Counter(w for d in mine for w in set(d[2]))
        kept = sorted(w for w, n in spread.items() if n >= 10)
        v = len(kept)
        counts = {s: Counter(w for d in mine if d[1] == s for w in d[2] if spread[w] >= 10) for s in {d[1] for d in mine}}
        total = Counter(w for d in mine for w in d[2] if spread[w] >= 10)
        for s, c in counts.items():
            n = sum(c.values())
            pairs = [(-sum(f(price(c[w], n, v), price(o[w], sum(o.values()), v)) for w in kept), t.encode(), t) for t, o in counts.items() if t != s]
            terms = [(w, price(c[w], n, v), price(total[w], sum(total.values()), v)) for w in kept if c[w]]
            tops = sorted((-f(p, q), w.encode(), w) for w, p, q in terms if p > q)[:10]
            for part, listed in (("pair", sorted(pairs)), ("term", tops)):
                out |= {(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(listed, 1)}
    return out


def test_source_divergence(documents, empty, rows, monkeypatch):
    want = _divergence_by_hand(rows)
    got = divergence.source_divergence(documents)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = got.collect()
    assert set(map(tuple, found)) == want and len(found) == len(want)
    assert {r["part"] for r in found} == {"pair", "term"}
    assert divergence.source_divergence(empty).collect() == []
    # Many blocks of groups, small pieces and sums that leave early.
    for name, value in (("BLOCK", 2), ("SUMS", 1), ("PIECE", 7), ("TERMS", 3)):
        monkeypatch.setattr(divergence, name, value)
    assert set(map(tuple, divergence.source_divergence(documents).collect())) == want


def test_divergence_without_kept_terms(spark):
    frame = spark.createDataFrame([("a b", "en", "s"), (None, "en", "t"), ("c", "fr", None)], "text string, lang string, source string")
    assert sorted(map(tuple, divergence.source_divergence(frame).collect())) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_divergence_of_many_sources(spark):
    """More sources than a block holds."""
    pick = random.Random(3)
    rows = [(None, " ".join(pick.choice(WORDS[:6]) for _ in range(4)), "en", f"s{i % 300}") for i in range(600)]
    frame = spark.createDataFrame([r[1:] for r in rows], "text string, lang string, source string")
    assert set(map(tuple, divergence.source_divergence(frame).collect())) == _divergence_by_hand(rows)
