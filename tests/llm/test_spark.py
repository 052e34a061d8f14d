"""Operators over small tables with nulls, empty and long texts, ties, repeated rows, clashing columns
and no rows at all, against brute force."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from quillmask.llm import avi, editprint, huffman, language, lines, minhash, mixing, packing, substrings, toxicity  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, a int, rep long, comp long"


def _texts():
    rng = random.Random(11)
    words = ["w" + str(i) for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(8)]
    near = []
    for b in base[:4]:
        w = b.split()
        for k in range(6):
            v = list(w)
            for _ in range(k):
                v[rng.randrange(len(v))] = rng.choice(words)
            near.append(" ".join(v))
    mixed = [" ".join(base[4].split()[:60] + [rng.choice(words) for _ in range(30)]) for _ in range(5)]
    odd = [None, "", " \n\t ", "Hi", "hi", "12 34", "é" * 300, "The shared line.\nown " + base[5], "The shared line.\nother", "same " * 300, "x" * 3000, base[6] * 20]
    spread = [f"A footer of all sites\nbody {i} {rng.random()}" for i in range(12)]
    return base + near + mixed + odd + spread + [base[0], "A footer of all sites"]


@pytest.fixture(scope="module")
def rows():
    out = [(i * 3, t, ("en", "fr", None)[i % 3], None if i % 13 == 0 else f"s{i % 12}", 1, 2, "k", 3, 4, 5) for i, t in enumerate(_texts())]
    return [*out, out[5], out[5]]


@pytest.fixture(scope="module")
def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_edit_prints(documents, empty, rows):
    got = sorted(map(tuple, editprint.edit_prints(documents).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint").collect()))
    order = sorted(((i, t or "") for i, t, *_ in rows))
    want = []
    for k, (i, t) in enumerate(order):
        e = editprint.edited(t, order[(k + 1) % len(order)][1])
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), editprint.fingerprint(t), editprint.fingerprint(e)))
    assert got == sorted(want)
    assert editprint.edit_prints(empty).collect() == []


def test_edit_prints_of_one_row_and_no_id(spark):
    frame = spark.createDataFrame([(None, "abcdefgh", 1)], "doc_id long, text string, extra int")
    (row,) = editprint.edit_prints(frame).collect()
    assert row["doc_id"] is None and row["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def test_windows_are_cut_one_at_a_time():
    """A text of one word, 3 MB: its windows are 50 times as much, and never held together."""
    import tracemalloc

    packed = b" ".join([b"word"] * 600_000)
    tracemalloc.start()
    n = sum(1 for _ in substrings._windows(packed))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 600_000 - substrings.WINDOW + 1 and peak < 40 << 20


def test_substring_dedup_of_crowded_bytes(spark, monkeypatch):
    """Buckets over their bytes go the other way, also texts that repeat one word; the result is the same."""
    rows = [(1, "same " * 3000), (2, "same " * 2000 + "end"), (3, " ".join(f"w{i}" for i in range(90))), (4, "lead " + " ".join(f"w{i}" for i in range(80))), (None, "same " * 60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(str, substrings.substring_dedup(frame).collect()))
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 1)
    assert sorted(map(str, substrings.substring_dedup(frame).collect())) == whole
    got = {r["doc_id"]: r["n_removed"] for r in substrings.substring_dedup(frame).collect()}
    assert got == {1: 0, 2: 2000, 3: 0, 4: 80, None: 0}


TOP = 2**63 - 1


@pytest.fixture(scope="module")
def far_ids():
    """Ids beyond 2^53, at both ends of 64 bits, repeated, and none, in every part of the table."""
    rng = random.Random(23)
    ids = [None, None, -TOP - 1, -TOP, TOP, TOP - 1, TOP - 1, *[s * (2**53 + k) for k in range(40) for s in (1, -1)], *[TOP // 3 + k for k in range(40)]]
    rng.shuffle(ids)
    return [(i, " ".join(rng.choice(["alpha", "beta", "γάμμα", "delta"]) for _ in range(rng.randrange(30))) or None) for i in ids]


def _first_null(rows):
    return sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def _alike(a, b):
    """Share of equal digits at the places that both prints have, as the docstring says it."""
    if a == b:
        return 1.0
    scale = max(int(p.split("-")[0], 16) for p in (a, b))

    def at(p):
        own, steps, digits = p.split("-")
        places = range(editprint.PHASE % (1 << int(own, 16)), int(steps, 16), 1 << int(own, 16))
        return {p: d for p, d in zip(places, digits, strict=True) if p % (1 << scale) == editprint.PHASE % (1 << scale)}

    x, y = at(a), at(b)
    same = sum(y.get(p) == d for p, d in x.items()) / max(len(x), len(y), 1)
    return max(0.0, (same - 1 / 16) / (15 / 16))


def test_edit_prints_of_far_ids(spark, far_ids):
    got = editprint.edit_prints(spark.createDataFrame(far_ids, "doc_id long, text string").repartition(5)).collect()
    order, want = _first_null(far_ids), []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        e = editprint.edited(t, following)
        mine, theirs, others = map(editprint.fingerprint, (t, e, following))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), mine, theirs, _alike(mine, theirs), _alike(mine, others)))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    found = sorted(map(tuple, got), key=key)
    assert [r[:5] for r in found] == [r[:5] for r in sorted(want, key=key)]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in sorted(want, key=key)])


def test_huffman_tokens_of_far_ids(spark, far_ids):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    frame = spark.createDataFrame(far_ids, "doc_id long, text string").repartition(5)
    got = {(r["doc_id"], r["start"]): (r["n_tokens"], r["ids_crc32"]) for r in huffman.read(*huffman.write(frame, path)).collect()}
    encoded = [(i, np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in _first_null(far_ids)]
    assert sorted((str(i), n, c) for (i, _), (n, c) in got.items()) == sorted((str(i), len(b) // 4, zlib.crc32(b)) for i, b in encoded)
    by_start = sorted((s, i, n) for (i, s), (n, _) in got.items())
    assert [i for _, i, _ in by_start] == [i for i, _ in encoded]
    assert all(a[0] + a[2] == b[0] for a, b in zip(by_start, by_start[1:], strict=False)) and by_start[0][0] == 0


def test_near_prints(documents, rows):
    got = {r["doc_id"]: r["class_id"] for r in editprint.near_duplicates(documents.dropDuplicates(["doc_id"])).collect()}
    texts = {i: t for i, t, *_ in rows}
    assert all(got[i] <= i for i in texts)
    assert got[max(i for i, t in texts.items() if t == texts[0])] == 0 and got[8 * 3 + 3] == 0


def _print_classes(texts):
    prints = {i: editprint.fingerprint(t or "") for i, t in texts.items()}
    least = {i: i for i in prints}
    for i in sorted(prints):
        for j in sorted(prints):
            if i < j and least[i] != least[j] and editprint.likeness(prints[i], prints[j]) >= editprint.NEAR:
                low, high = sorted((least[i], least[j]))
                least = {k: low if c == high else c for k, c in least.items()}
    return {i: (c, editprint.likeness(prints[i], prints[c])) for i, c in least.items()}


@pytest.fixture(scope="module")
def prone():
    """Short texts, heads shared by texts that are not near, and chains of edits."""
    rng = random.Random(21)
    draw = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    texts = [draw(n) for n in (1, 2, 3, 5, 8, 10, 13, 17, 24, 40, 60, 90) for _ in range(5)]
    texts += [t[:-1] + "X" for t in texts] + [t + "Y" for t in texts]
    head = draw(250)
    own = [draw(750) for _ in range(30)]
    texts += [head + t for t in own] + [head + t[:-60] + draw(60) for t in own] + [head[:100] + draw(40) for _ in range(10)]
    for size in (12, 40, 400, 1500):
        text = draw(size)
        for k in range(8):
            at = size - (k + 1) * size // 8
            texts.append(text := text[:at] + draw(size // 8) + text[at + size // 8 :])
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("small, rounds", [(32, 2), (1, 0)])
def test_near_prints_against_all_pairs(spark, prone, small, rounds, monkeypatch):
    monkeypatch.setattr(editprint, "SMALL", small)
    monkeypatch.setattr(editprint, "CHUNK", 50)
    monkeypatch.setattr(editprint, "ROUNDS", rounds)
    frame = spark.createDataFrame(list(prone.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["class_id"], r["likeness"]) for r in editprint.near_duplicates(frame).collect()}
    want = _print_classes(prone)
    assert got == want and sum(i != c for i, (c, _) in want.items()) > 50 and any(like < editprint.NEAR for _, like in want.values())


def test_near_prints_of_no_rows(empty):
    assert editprint.near_duplicates(empty).collect() == []


def test_packing(documents, empty, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack_documents(documents, path).toPandas()
    tokenizer, places = Tokenizer.from_file(path), {}
    for i, group in got.groupby("doc_id"):
        ids = np.array([*tokenizer.encode({r[0]: r[1] for r in rows}[i] or "", add_special_tokens=False).ids, 0], "<u4")
        times = sum(r[0] == i for r in rows)
        pieces = sorted(set(zip(group["piece"], group["start"], group["length"], group["ids_crc32"], strict=True)))
        assert len(group) == times * len(pieces) and sum(p[2] for p in pieces) == len(ids)
        for k, start, length, crc in pieces:
            assert crc == zlib.crc32(ids[start : start + length].tobytes()) and (k == 0 or length == 2048)
    for _, group in got.groupby("sequence_id"):
        places = sorted(zip(group["offset"], group["length"], strict=True))
        assert [o for o, _ in places] == np.cumsum([0, *[n for _, n in places]])[:-1].tolist() and sum(n for _, n in places) <= 2048
    assert got["sequence_id"].nunique() <= packing.best_fit(got["length"].to_numpy())[0].max() + 2
    assert packing.pack_documents(empty, path).collect() == []


def _windows(rows):
    words = {i: WORD.findall(t or "") for i, t, *_ in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    out = []
    for i, *_ in rows:
        gone = [False] * len(words[i])
        for k in range(len(words[i]) - 49):
            if first[tuple(words[i][k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        left = " ".join(w for w, g in zip(words[i], gone, strict=True) if not g)
        out.append((i, len(words[i]), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("bucket", [2000, 1])
def test_substrings(documents, empty, rows, bucket, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET", bucket)
    got = sorted(map(tuple, substrings.substring_dedup(documents).collect()))
    assert got == _windows(rows) and sum(r[2] for r in got) > 1000
    if bucket == 1:
        assert substrings.substring_dedup(empty).collect() == []


def test_substrings_of_texts_that_share_an_id(spark):
    a, b = [f"a{i}" for i in range(73)], [f"b{i}" for i in range(71)]
    frame = spark.createDataFrame([(1, " ".join(a)), (5, " ".join(b)), (5, " ".join(a[:60])), (5, " ".join(a[:60])), (None, " ".join(a)), (7, " ".join(b))], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substrings.substring_dedup(frame).collect())
    assert got == [(0, 73, 0), (1, 73, 0), (5, 60, 60), (5, 60, 60), (5, 71, 0), (7, 71, 71)]


def _targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    left, free, target = float(sum(sizes.values())), set(order), {}
    while free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * share > 3 * sizes[s]]
        for s in over or list(free):
            target[s] = 3.0 * sizes[s] if over else weight[s] * share
        free -= set(over or free)
        left -= sum(target[s] for s in over)
    return target


def test_mixing(documents, empty, rows):
    got = mixing.mix(documents).collect()
    sizes = {}
    for _, t, _, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    target = _targets(sizes)
    assert len(got) == len(rows)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == sizes[s] and 0 <= r["copies"] <= 3 for r in own)
        assert abs(sum(r["copies"] * r["size"] for r in own) - target[s]) <= max(3 * r["size"] for r in own)
    repeated = mixing.mixed_documents(documents)
    assert repeated.columns == documents.columns and repeated.count() == sum(r["copies"] for r in got)
    assert mixing.mix(empty).collect() == [] and mixing.mixed_documents(empty).collect() == []


def test_lines(documents, empty, rows):
    got = {(r["doc_id"], r["n_lines"], r["n_removed"], r["kept_text"]) for r in lines.deduped(documents).collect()}
    sites = {}
    for i, t, _, s, *_ in rows:
        for line in (t or "").split("\n"):
            if WORD.search(line):
                sites.setdefault(line, set()).add((s, i))
    bad = {line: min(i for _, i in where) for line, where in sites.items() if len({s for s, _ in where}) >= lines.SITES}
    assert bad
    want = set()
    for i, t, *_ in rows:
        kept = None if t is None else "\n".join(x for x in t.split("\n") if bad.get(x, i) >= i)
        ink = [x for x in (t or "").split("\n") if WORD.search(x)]
        want.add((i, len(ink), sum(bad.get(x, i) < i for x in ink), kept))
    assert got == want
    assert lines.without_boilerplate(documents).count() == len(rows) - 1 and lines.without_boilerplate(documents).columns == documents.columns
    assert lines.deduped(empty).collect() == []


def _components(rows, size, near=80):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= near * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(documents, empty, rows, size):
    got = [(r["doc_id"], (r["n"], r["comp"])) for r in minhash.near_components(documents, size).collect()]
    want = _components(rows, size)
    assert len(got) == len(rows) and all(want[i] == v for i, v in got) and sum(i != c for i, (_, c) in want.items()) > 10
    if size == 5:
        assert minhash.one_of_each(documents, size).columns == documents.columns
        assert minhash.near_components(empty, size).collect() == []


def test_lower_likeness(documents, rows):
    got = {r["doc_id"]: r["comp"] for r in minhash.near_components(documents, 2, 45).collect()}
    assert got == {i: c for i, (_, c) in _components(rows, 2, 45).items()}
    assert (minhash.shared(80), minhash.whole(80)) == (35, 51)


def test_lower_likeness_of_lone_pairs(spark):
    """Nothing else shares these texts' shingles: about half of a sketch's values are common."""
    pairs = [(2 * k + e, " ".join(f"p{k}w{i}" for i in range(e * 60, e * 60 + 180))) for k in range(8) for e in (0, 1)]
    got = minhash.near_components(spark.createDataFrame(pairs, "doc_id long, text string"), 2, 45).collect()
    assert {r["doc_id"]: r["comp"] for r in got} == {i: i - i % 2 for i, _ in pairs}


@pytest.mark.parametrize("crowd", [64, 2])
def test_left_over_pairs(documents, rows, crowd, monkeypatch):
    """Without any round of leaders, the members of the lists meet each other and no link is lost."""
    monkeypatch.setattr(minhash, "ROUNDS", 1 if crowd == 2 else 0)
    monkeypatch.setattr(minhash, "LIKELIEST", 0)
    monkeypatch.setattr(minhash, "CROWD", crowd)
    got = {r["doc_id"]: r["comp"] for r in minhash.near_components(documents, 2).collect()}
    assert got == {i: c for i, (_, c) in _components(rows, 2).items()}


def test_near_copies_around_the_threshold(spark):
    """Edits that leave about 0.8: recall and precision are 1 against all pairs."""
    rng = random.Random(31)
    words = [f"v{k}" for k in range(3000)]
    texts = []
    for size in (12, 40, 60, 150, 400, 1000):
        base = [rng.choice(words) for _ in range(size)]
        texts.append(" ".join(base))
        for share in (0.02, 0.04, 0.05, 0.055, 0.06, 0.08):
            for _ in range(4):
                v = list(base)
                for at in rng.sample(range(size), max(1, int(size * share))):
                    v[at] = rng.choice(words)
                texts.append(" ".join(v))
    texts += [" ".join(rng.choice(words) for _ in range(200)) for _ in range(100)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["comp"] for r in minhash.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    want = {i: c for i, (_, c) in _components(rows, 2).items()}
    assert got == want and 50 < sum(i != c for i, c in want.items()) < len(rows) - 150


def test_texts_that_share_an_id(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    frame = spark.createDataFrame([(1, a, 1), (5, b, 2), (5, a, 3), (7, b, 4), (None, a, 5), (7, None, 6)], "doc_id long, text string, set int")
    assert sorted((r["doc_id"] or 0, r["n"], r["comp"] or 0) for r in minhash.near_components(frame, 5).collect()) == [(0, 26, 1), (1, 26, 1), (5, 26, 1), (5, 26, 5), (7, 0, 7), (7, 26, 5)]
    kept = minhash.one_of_each(frame)
    assert kept.columns == frame.columns and sorted(r["set"] for r in kept.collect()) == [1, 2, 5, 6]


def test_languages(spark, documents, empty):
    model = language.fit(documents)
    got = language.predict(documents, model).collect()
    assert {r["lang_pred"] for r in got} <= {"en", "fr", "und"} and all(0 <= r["score"] <= 1 for r in got)
    assert all((r["lang_pred"] == "und") == (r["score"] == 0) for r in got)
    assert language.predict(empty, language.fit(empty)).collect() == [] and language.identified(empty).collect() == []
    kept = language.identified(documents)
    assert kept.columns == documents.columns and kept.count() <= documents.count() - 4


def test_every_label_is_learned(spark, monkeypatch):
    """More labels than the old limit of 4,096, some of them in the text of one document only."""
    seen = []
    monkeypatch.setattr(language.Codes, "fit", classmethod(lambda cls, texts, labels: seen.append(labels)))
    rows = spark.range(10000).selectExpr("id as doc_id", "concat('text ', id) as text", "concat('l', id % 4200) as lang")
    odd = spark.createDataFrame([(-1, "12", "none"), (-2, "12", "some"), (-3, "a", "some"), *[(-4, "copy", "copies")] * 50], "doc_id long, text string, lang string")
    language.fit(rows.unionByName(odd), held=None)
    assert set(seen[0]) == {f"l{k}" for k in range(4200)} | {"some", "copies"} and seen[0].count("copies") == 1


def test_toxicity(spark, documents, empty):
    labels = documents.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic", "1 as text")
    got = toxicity.scores(documents, toxicity.fit(documents, labels)).collect()
    assert len(got) == documents.count() and all(0 <= r["score"] <= 1 for r in got)
    bare = toxicity.scores(documents, toxicity.fit(empty, labels.limit(0))).collect()
    assert {r["score"] for r in bare} == {0.5}


def test_huffman(documents, empty, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = sorted(map(tuple, huffman.read(*huffman.write(documents, path)).collect()))
    tokenizer, at, want = Tokenizer.from_file(path), 0, []
    for i, t in sorted((i, t or "") for i, t, *_ in rows):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted(want)
    assert huffman.read(*huffman.write(empty, path)).collect() == []


def test_media(documents, empty, rows):
    got = {(r["doc_id"], r["n_bytes"], r["payload_sha256"]) for r in avi.digests(documents).collect()}
    assert got == {(i, len((t or "").encode()), hashlib.sha256(avi.padded((t or "").encode())).hexdigest()) for i, t, *_ in rows}
    clips = avi.clip_rows(avi.media_column(documents.filter("doc_id = 0"))).collect()
    assert clips[0]["start_ms"] == 0 and clips[-1]["end_ms"] == len(avi.padded(rows[0][1].encode())) // 576 * 40
    assert avi.digests(empty).collect() == []


@pytest.mark.parametrize("name", ["op3_substring_dedup", "op4_mix_sources", "op5_line_dedup", "op7_near_duplicates"])
def test_queries_equal_sql(spark, name):
    from quillmask.llm.queries import ORACLE, QUERIES

    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no tables here")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    found = con.sql(ORACLE[name])
    got = QUERIES[name](spark, str(folder)).select(*found.columns).collect()
    clean = lambda r: tuple(round(float(v), 6) if not isinstance(v, (str, int)) else v for v in r)
    assert sorted(map(clean, got)) == sorted(map(clean, found.fetchall()))
