"""Detectors, scoring, overlaps and policies: Column form against the Python form and known cases."""

import hashlib
import hmac
import pickle
import random
import re
import time
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import settings as hypothesis_settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmask.functions import local, patterns, validators, wordlist
from quillmask.functions.entities import ENTITY_TYPES, Policy, entity_type, settings
from quillmask.functions.local import Span
from quillmask.operators import clusters, evaluate
from quillmask.operators.clusters import resolved_rows
from quillmask.operators.engine import Masker, register_sql
from quillmask.session import stage

AZ = "Ab3dEf6hIj9lMn2pQr5tUv8xYz1BcD4FgH7JkL0"
# Values that look like credentials are put together here, never written whole.
KNOWN = {
    "email": "jo.doe+x@corp-mail.io",
    "private_key": "-----BEGIN RSA " + "PRIVATE KEY-----\nMIIabc+/=\n-----END RSA " + "PRIVATE KEY-----",
    "jwt": "ey" + "JhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK",
    "aws_key": "AKIA" + "ABCDEFGHIJKLMNOP",
    "github_token": "gh" + "p_" + AZ[:36],
    "slack_token": "xo" + "xb-1234567890ab-1234567890ab",
    "slack_webhook": "https://hooks.slack" + ".com/services/T12345678/B12345678/" + AZ[:20],
    "stripe_key": "sk" + "_live_" + AZ[:20],
    "google_api_key": "AI" + "za" + AZ[:35],
    "sendgrid_key": "SG" + "." + AZ[:22] + "." + (AZ + AZ)[:43],
    "twilio_key": "SK" + "0123456789abcdef" * 2,
    "npm_token": "np" + "m_" + AZ[:36],
    "credit_card": "4111 1111 1111 1111",
    "ssn": "219-09-9999",
    "ipv4": "10.1.2.3",
    "ipv6": "2001:db8::1",
    "phone": "+1 (415) 555-2671",
}


@pytest.mark.parametrize("kind", KNOWN)
def test_each_type_is_found(kind):
    found = Masker().detect_text(f"see {KNOWN[kind]} now")
    assert [(s.entity_type, s.text) for s in found] == [(kind, KNOWN[kind])]


def test_api_key_is_the_value_alone():
    (found,) = Masker(use_entropy=False).detect_text("API_KEY = 'abcdEFGH12345678'")
    assert (found.entity_type, found.text, found.confidence) == ("api_key", "abcdEFGH12345678", 0.95)


@pytest.mark.parametrize("text", ["card 4111 1111 1111 1112", "id 666-12-3456", "at 1.2.3.4.5", "at 1:2:3", "on 2020-01-02", "call 2020-01-02", "AKIA" + "SHORT"])
def test_lookalikes_are_left(text):
    assert Masker(use_entropy=False).redact_text(text) == text


def test_context_and_threshold():
    find = lambda text, **o: [(s.entity_type, round(s.confidence, 2), s.meta.get("context")) for s in Masker(**o).detect_text(text)]
    assert find("415-555-2671") == []
    assert find("call 415-555-2671") == [("phone", 0.65, "boosted")]
    assert find("123456789") == [] and find("ssn 123456789") == [("ssn", 1.0, "boosted")]
    assert find("to joe@example.com") == [("email", 0.55, "suppressed")]
    assert find("to joe@example.com", min_confidence=0.6) == []
    assert find("test 10.1.2.3") == [("ipv4", 0.5, "suppressed")]
    assert find("test 219-09-9999") == []
    assert find("sample codeword", custom_words=("codeword",)) == [("custom", 0.6, "suppressed")]


def test_card_beats_phone_and_named_key_beats_entropy():
    assert [s.entity_type for s in Masker().detect_text("4111 1111 1111 1111")] == ["credit_card"]
    assert [s.entity_type for s in Masker().detect_text("token = " + "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e")] == ["api_key"]
    assert [s.entity_type for s in Masker().detect_text("commit 2321bac4d15ec8f90433955bf9d3cf61da5bdd1e")] == ["secret"]


def test_policies():
    text = "to joe@corp.io"
    assert Masker().redact_text(text) == "to [REDACTED]"
    assert Masker(policy=Policy(mode="mask")).redact_text(text) == "to *******p.io"
    assert Masker(policy=Policy(mode="mask", mask_keep_last=-1, mask_char="#")).redact_text(text) == "to " + "#" * 11
    assert Masker(policy=Policy(mode="mask", mask_keep_last=99)).redact_text(text) == text
    code = hmac.new(b"k", b"joe@corp.io", hashlib.sha256).hexdigest()[:10]
    assert Masker(policy=Policy(mode="pseudonymize", hmac_key=b"k")).redact_text(text) == f"to <EMAIL_{code}>"
    assert Masker(policy=Policy(mode="mask", replacements={"email": "<E>"})).redact_text(text) == "to <E>"
    with pytest.raises(ValueError):
        Policy(mode="pseudonymize")
    with pytest.raises(ValueError):
        Policy(mode="shout")


def test_settings_are_checked():
    assert entity_type(" Email ") == "email" and len(ENTITY_TYPES) == 23
    for bad in ({"types": ["mail"]}, {"overlap": -1}, {"chunk_size": 0}):
        with pytest.raises(ValueError):
            settings(**bad)


def test_custom_words_in_the_users_order():
    found = Masker(types=(), custom_words=("Pro", "Project", ""), custom_patterns=(r"x\d*", "q*")).detect_text("the project x12")
    assert [s.text for s in found] == ["pro", "x12"]


MIXED = [
    "mail bob@corp.io, ssn: 123456789, card 4111 1111 1111 1111, ip 10.1.2.3 fe80::1 ::",
    "é😀 call +1 (415) 555-2671 or 415-555-2671; key='abcdEFGH1234567890XYZ' " + KNOWN["aws_key"],
    "tel 020 7946 0958 test 123-45-6789 ssn 123-45-6789 ١٢٣", "", None,
    "٤١١١١١١١١١١١١١١١ éuser@corp.io ſecret: abcdefghijklmnop",
    *[f"a {v} b́ {v}" for v in KNOWN.values()],
]


def _same(rows, masker):
    engine = masker.local()
    for r in rows:
        if r["text"] is None:
            assert r["redacted"] is None and r["detections"] == []
            continue
        want = [(s.start, s.end, s.text, s.entity_type, round(s.confidence, 9), s.source, s.meta) for s in engine.detect(r["text"])]
        have = [(s["start"], s["end"], s["text"], s["entity_type"], round(s["confidence"], 9), s["source"], s["meta"]) for s in r["detections"]]
        assert have == want and r["redacted"] == engine.redact(r["text"])


def test_columns_equal_python(spark):
    rng = random.Random(3)
    noise = ["".join(rng.choice("0123456789-. :@abé😀=+()/\n") for _ in range(80)) for _ in range(60)]
    frame = spark.createDataFrame([(t, i) for i, t in enumerate(MIXED + noise)], "text string, candidates int")
    _same(Masker().redact(frame).collect(), Masker())
    masker = Masker(custom_words=("corp", "a.b"), custom_patterns=(r"\d{3}",), policy=Policy(mode="pseudonymize", hmac_key=b"x" * 70), min_confidence=0.4)
    _same(masker.redact(frame.drop("candidates")).collect(), masker)


def test_validators_equal_python(spark):
    rng = random.Random(5)
    cards = ["".join(rng.choice("0123456789 -") for _ in range(rng.randrange(10, 22))) for _ in range(300)]
    groups = [":".join("".join(rng.choice("0af") for _ in range(rng.choice((0, 0, 1, 4)))) for _ in range(rng.randrange(3, 10))) for _ in range(600)]
    frame = spark.createDataFrame([(t, "c") for t in cards] + [(t, "g") for t in groups], "t string, kind string")
    got = frame.select("t", "kind", validators.luhn_ok(F.col("t")).alias("luhn"), validators.ipv6_ok(F.col("t")).alias("v6"), validators.phone_ok(F.col("t")).alias("phone"), validators.shannon_entropy(F.col("t")).alias("h")).collect()
    for r in got:
        if r["kind"] == "c":
            assert r["luhn"] == validators.luhn_text(r["t"]) and r["phone"] == validators.phone_text(r["t"])
        else:
            assert r["v6"] == validators.ipv6_text(r["t"])
        assert abs(r["h"] - validators.entropy_text(r["t"])) < 1e-9


def _greedy(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (-s.confidence, s.start - s.end, s.start)):
        if not any(s.overlaps(k) for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s.start)


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9), st.sampled_from([0.5, 0.6, 0.9])), max_size=25))
@hypothesis_settings(max_examples=200, deadline=None)
def test_overlaps_python(items):
    spans = [Span(a, a + n, "", "email", c) for a, n, c in items]
    assert local.resolve(spans) == _greedy(spans)


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_overlaps_by_clusters(spark, block):
    """Ties, repeated spans, a null key, many blocks in a cluster and many clusters in a block."""
    rng = random.Random(7)
    rows = [(d or None, a := rng.randrange(60), a + rng.randrange(0, 9), rng.choice([0.5, 0.7, 0.9]), i) for d in range(40) for i in range(rng.randrange(30))]
    frame = spark.createDataFrame(rows, "doc_id int, start int, end int, confidence double, ord int").repartition(3)
    got = resolved_rows(frame, ["doc_id"], block).collect()
    assert [f.name for f in frame.schema] == list(got[0].asDict())
    for d in {r[0] for r in rows}:
        want = [(s.start, s.end, s.confidence) for s in _greedy([Span(a, b, "", "email", c) for k, a, b, c, _ in rows if k == d])]
        assert sorted((r["start"], r["end"], r["confidence"]) for r in got if r["doc_id"] == d) == sorted(want)


@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 6)), max_size=120), st.sampled_from([2, 1024]))
@hypothesis_settings(max_examples=150, deadline=None)
def test_disjoint_spans(items, most):
    kept, want = clusters.Disjoint(), []
    kept.MOST = most
    for a, n in items:
        free = all(not (a < d and c < a + n) for c, d in want)
        assert kept.add(a, a + n) == free
        want += [(a, a + n)] * free


def test_resolved_in_one_document_of_many_spans(spark):
    """200,000 spans of one document in chains: tasks share the blocks, and the result is the local one's."""
    rows = spark.range(200_000).selectExpr("7 doc_id", "cast(id * 5 as int) start", "cast(id * 5 + 4 + id % 3 as int) end", "double((id * 37 % 10) / 10) confidence", "cast(id % 5 as int) ord")
    got = sorted((r["start"], r["end"]) for r in resolved_rows(rows, ["doc_id"], 1 << 12).collect())
    spans = [Span(i * 5, i * 5 + 4 + i % 3, "", "email", i * 37 % 10 / 10) for i in range(200_000)]
    assert got == [(s.start, s.end) for s in local.resolve(spans)]



@pytest.mark.parametrize("block", [1 << 16, 64])
def test_partitions_of_spans_grow_with_their_number(spark, monkeypatch, block):
    """Short documents beside long ones, null keys too, in partitions of about 100 spans; one shuffle where all are short."""
    monkeypatch.setattr(clusters, "ROWS", 100)
    draw = random.Random(3)
    rows = [(d or None, a := draw.randrange(40 if d % 3 else 400), a + draw.randint(1, 9), draw.choice((0.5, 0.9)), k) for d in range(40) for k in range(60)]
    found = resolved_rows(spark.createDataFrame(rows, "doc_id long, start int, end int, confidence double, ord int"), ["doc_id"], block)
    want = [(d or None, s.start, s.end, s.confidence) for d in range(40) for s in local.resolve([Span(a, b, "", "custom", c) for e, a, b, c, _ in rows if e == (d or None)])]
    assert Counter((r["doc_id"], r["start"], r["end"], r["confidence"]) for r in found.collect()) == Counter(want)
    assert found.rdd.getNumPartitions() >= 2400 // 100
    assert block == 64 or found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_no_task_of_overlaps_holds_more_with_more_spans(spark, monkeypatch, block):
    """20,000 spans apart in one source partition: neither the tasks that deal them out nor those that
    resolve them, of 400 short documents or of one long, get a share of the whole."""
    staged = []
    monkeypatch.setattr(clusters, "ROWS", 200)
    monkeypatch.setattr(clusters, "FILE", 100, raising=False)
    monkeypatch.setattr(clusters, "stage", lambda *given: staged.append(stage(*given)) or staged[-1])
    rows = spark.range(0, 20_000, 1, 1).selectExpr(f"if({block} = 64, 7, id % 400) doc_id", "cast(id * 10 as int) start", "cast(id * 10 + 5 as int) end", "0.5D confidence", "0 ord")
    found = resolved_rows(rows, ["doc_id"], block)
    most = lambda frame: frame.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert found.count() == 20_000
    assert most(staged[0]) <= 3_200
    assert most(found) <= 1_000


@pytest.mark.parametrize("words", [3, 40, 500])
def test_dense_texts(spark, words):
    """Overlaps in chains and clusters, places beyond many pages, characters outside the basic plane."""
    rng = random.Random(words)
    parts = ["joe@corp.io", "4111 1111 1111 1111", "+1 415 555 2671", "10.2.3.4", "ssn 123456789", "card 4111-1111-1111-1111x", "token = abcdEFGH12345678", "\U0001f600" * 3, "é" * 9, "fake", "call 415-555-2671"]
    text = " ".join(rng.choice(parts) for _ in range(words))
    row = Masker().redact(spark.createDataFrame([(text,)], "text string")).first()
    assert row["redacted"] == Masker().redact_text(text)
    assert [(d["start"], d["end"], d["entity_type"], d["meta"]) for d in row["detections"]] == [(s.start, s.end, s.entity_type, s.meta) for s in Masker().detect_text(text)]


def test_time_of_dense_texts(spark):
    """Four times the matches in one text take about four times as long, not sixteen."""
    took = []
    for n in (2000, 2000, 8000):
        frame = spark.createDataFrame([(" ".join(f"mail user{i}@ex{i}.org and text" for i in range(n)),)], "text string")
        began = time.perf_counter()
        assert len(Masker(types=("email",)).redact(frame).first()["detections"]) == n
        took.append(time.perf_counter() - began)
    assert took[2] < 5 * took[1] + 1


def test_nested_text_and_outputs_of_any_name(spark):
    masker = Masker()
    frame = spark.createDataFrame([("to joe@corp.io", ("see a@b.io",), "id 10.2.3.4")], "text string, s struct<text: string>, detections string")
    assert masker.redact(frame, "s.text").first()["redacted"] == "see [REDACTED]"
    assert masker.redact(frame, "detections").first()["redacted"] == "id [REDACTED]"
    assert masker.redact(frame, "text", out="text").first()["text"] == "to [REDACTED]"
    assert masker.spans(frame.select("text", F.col("s.text").alias("other")), ["text"], "other").first()["span_text"] == "a@b.io"


def _prf_by_hand(predicted, gold):
    """Each prediction in order takes the free gold span of its type nearest its end."""
    pairs, free = [], list(gold)
    for d, t, a, b in sorted(predicted, key=lambda p: p[2:]):
        fit = [g for g in free if g[:2] == (d, t) and min(b, g[3]) > max(a, g[2]) and 2 * (min(b, g[3]) - max(a, g[2])) >= g[3] - g[2]]
        if fit:
            best = max(fit, key=lambda g: g[2:])
            free.remove(best)
            pairs.append((d, t, a, b, *best[2:]))
    return pairs


def test_scorer(spark):
    """A thousand documents of a few spans, overlapping each other; one prediction can fit several gold spans."""
    rng = random.Random(17)

    def spans(most):
        return [(d or None, rng.choice(["email", "ssn"]), a := rng.randrange(30), a + rng.randrange(0, most)) for d in range(1000) for _ in range(rng.randrange(6))]

    predicted, gold = [(1, "email", 0, 10), (1, "email", 1, 22), *spans(20)], [(1, "email", 1, 11), (1, "email", 12, 22), *spans(9)]
    schema = "doc_id int, entity_type string, start int, end int"
    frames = [spark.createDataFrame(rows, schema).repartition(3) for rows in (predicted, gold)]
    want = _prf_by_hand(predicted, gold)
    assert sorted(map(repr, map(tuple, evaluate.matched(*frames, ["doc_id"]).collect()))) == sorted(map(repr, want))
    rated = {r["entity_type"]: (r["tp"], r["fp"], r["fn"]) for r in evaluate.scores(*frames, ["doc_id"]).collect()}
    assert rated["all"] == (len(want), len(predicted) - len(want), len(gold) - len(want))
    assert evaluate.scores(frames[0].limit(0), frames[1].limit(0), ["doc_id"]).collect() == [("all", 0, 0, 0, 0.0, 0.0, 0.0)]


def test_equal_letters_are_those_of_re():
    folds = wordlist.folds()
    chars = "".join(sorted({chr(c) for c in folds} | set(folds.values())))
    for c in chars:
        assert set(re.findall(re.escape(c), chars, re.IGNORECASE)) == {d for d in chars if folds.get(ord(d), d) == folds.get(ord(c), c)}


@given(st.data())
@hypothesis_settings(max_examples=300, deadline=None)
def test_word_lists(data):
    """Shared beginnings, repeated and empty words, letters with odd cases: as one alternation."""
    letters = data.draw(st.sampled_from(["ab", "abAB.", "asſSßẞ", "iİıI", "kKK", "aé\U0001f600É"]))
    words = data.draw(st.lists(st.text(letters, max_size=5), min_size=wordlist.FEW + 1, max_size=60))
    text = data.draw(st.text(letters + " ", max_size=80))
    cased = data.draw(st.booleans())
    plain = re.compile("|".join(re.escape(w) for w in words if w) or "(?!)", 0 if cased else re.IGNORECASE)
    assert pickle.loads(pickle.dumps(wordlist.WordList(words, cased))).places(text) == [m.span() for m in plain.finditer(text)]


def test_many_custom_words(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6):06d}" for _ in range(5000)]
    texts = [" ".join(rng.choice([*words[:50], "plain", "joe@corp.io", "W000001"]).upper() for _ in range(30)) for _ in range(300)] + [None, ""]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4).cache()
    masker = Masker(custom_words=words)
    assert sorted((r["redacted"] or "-") for r in masker.redact(frame).collect()) == sorted("-" if t is None else masker.redact_text(t) or "-" for t in texts)

    def seconds(some):
        began = time.perf_counter()
        Masker(types=(), custom_words=some).redact(frame).collect()
        return time.perf_counter() - began

    few, many, most = wordlist.FEW + 1, 5000, 100_000
    seconds(words[:few])
    base = seconds(words[:few])
    assert seconds(words[:many]) < 2 * base + 1 and seconds([f"x{i}" for i in range(most)]) < 2 * base + 4
    monkeypatch.setattr(wordlist, "MOST_BYTES", 1000)
    with pytest.raises(ValueError, match="fewer words"):
        masker.redact(frame)


def test_redacting_twice_changes_nothing(spark):
    once = Masker().redact(spark.createDataFrame([(t,) for t in MIXED], "text string")).select(F.col("redacted").alias("text"))
    assert all(r["text"] == r["redacted"] for r in Masker().redact(once).collect())


def test_spans_with_clashing_names_and_empty_table(spark):
    frame = spark.createDataFrame([("a@b.io", 7, "web")], "text string, start int, source string")
    (row,) = Masker().spans(frame, ["start", "source"]).collect()
    assert (row["start"], row["source"], row["span_start"], row["span_source"], row["end"]) == (7, "web", 0, "deterministic", 6)
    assert Masker().redact(frame.limit(0)).collect() == [] and Masker().summary(frame.limit(0), ["source"]).collect() == []


def test_sql_functions(spark):
    register_sql(spark, Masker())
    assert spark.sql("SELECT quill_redact('to a@b.io') AS r, quill_count(null) AS n").first() == ("to [REDACTED]", 0)


def test_columns_of_the_caller_stay(spark):
    masker = Masker(custom_words=["Falcon"])
    names = ["_digits", "_shape0", "_words", "_entropy", "_bare", "_python", "_d", "_s", "_quill_digits", "candidates"]
    frame = spark.createDataFrame([("to joe@corp.io, Falcon", *names)], ", ".join(["text string", *[f"{n} string" for n in names]]))
    row = masker.redact(frame).first()
    assert [row[n] for n in names] == names and row["redacted"] == masker.redact_text("to joe@corp.io, Falcon")
    assert masker.spans(frame, ["_d", "_s"]).count() == 2 and {r["n"] for r in masker.summary(frame, ["_d"]).collect()} == {1}


def test_names_of_the_top_level():
    import quillmask

    assert all(getattr(quillmask, name) for name in quillmask.__all__) and quillmask.Masker is Masker
    assert quillmask.LocalEngine(quillmask.Settings()).redact("to joe@corp.io") == "to [REDACTED]"


def test_python_detectors_hold_a_slice_of_a_batch(spark):
    """Texts come to the detectors, and spans leave them, in slices of a batch; nothing is lost or moved."""
    import pyarrow as pa

    from quillmask.operators import arrow_tiers

    texts = [None if i % 7 == 0 else "x" * (i % 900) * 30 + "joe" for i in range(3000)]
    parts = list(arrow_tiers.slices(pa.array(texts)))
    assert [t for p in parts for t in p.to_pylist()] == texts and len(parts) > 12
    assert all(len(p) <= arrow_tiers.SLICE_TEXTS and (len(p) == 1 or sum(len(t or "") for t in p.to_pylist()) <= arrow_tiers.SLICE_BYTES) for p in parts)

    class Sizes:
        name = "sizes"

        def detect_all(self, given):
            return [[Span(len(t) - 3, len(t), str(len(given)), "custom", 1.0, self.name)] for t in given]

    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = Masker(types=(), load_plugins=False, extra_detectors=(Sizes(),)).spans(frame, ["doc_id"]).collect()
    assert sorted((r["doc_id"], r["end"]) for r in got) == [(i, len(t)) for i, t in enumerate(texts) if t is not None]
    assert max(int(r["text"]) for r in got) <= arrow_tiers.SLICE_TEXTS


def test_hint_of_secrets_loses_none(spark):
    """texts without a hint of a long run are not searched for one; each run that may be a secret has it."""
    rng = random.Random(9)
    letters, others = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789+/=_-"
    texts = ["plain words, 12 - 7 of them / or=less, internationalization"]
    for size in (20, 21, 24, 31, 32, 64):
        for place in range(size):
            run = [rng.choice(letters) for _ in range(size)]
            run[place] = rng.choice(others)
            texts.append("key " + "".join(run) + rng.choice([" ", ".", ""]))
        texts += ["".join(rng.choice(letters + others) for _ in range(size)), "".join(rng.choice("0123456789abcdef") for _ in range(size))]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    hint = {r["text"]: r["h"] for r in frame.select("text", F.col("text").rlike(patterns.SECRET_HINT).alias("h")).collect()}
    assert not hint[texts[0]] and all(hint[t] for t in texts[1:] if re.search("[0-9+/=_-]", t))
    chosen = settings(types=("secret",), entropy_min_length=20, entropy_base64=3.0, entropy_hex=2.0)
    found = {r["text"]: [(s["start"], s["end"]) for s in r["detections"]] for r in Masker(chosen).detect(frame).collect()}
    engine = local.LocalEngine(chosen)
    assert found == {t: [(s.start, s.end) for s in engine.detect(t)] for t in texts}
    assert sum(map(bool, found.values())) > 150
