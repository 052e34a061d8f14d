"""The pipeline against a brute-force chain, and what the classifiers' queries get right on held-out rows."""

import random
import zlib
from collections import Counter
from pathlib import Path

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from quillmask.llm import language, lines, toxicity  # noqa: E402
from quillmask.llm.staging import stage  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from test_spark import WORD, _components, _targets  # noqa: E402

DATA = Path("/root/testdata/sf0.01")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "kept_text string, n_lines int, n_removed int, bad_doc string, bad_lines string, _copy int, comp int, set string, size int, unit double"
WORDS = {
    "en": "the river was cold and they walked along its banks until night came over houses".split(),
    "de": "der fluss war kalt und sie gingen durch das tal bis die nacht über häuser kam".split(),
}


def _documents():
    rng, out = random.Random(5), []
    for k in range(60):
        lang = ("en", "de")[k % 2]
        out.append([" ".join(rng.choice(WORDS[lang]) + rng.choice(("", "", str(k))) for _ in range(60)), lang])
    out += [[t + " end", lang] for t, lang in out[:12]]  # near copies
    out += [list(out[3]), list(out[3])]
    for row in out[20:36]:
        row[0] = "A footer of all sites\n" + row[0]
    out += [["A footer of all sites", "en"], [None, "en"], ["", None], ["12 34 --", "de"], [" \n\t", "en"], [" ".join([WORDS["en"][i % 14] + str(i) for i in range(9000)]), "en"]]
    rows = [(i, t, lang, None if i % 17 == 0 else f"s{i % 12}", len(t or "")) for i, (t, lang) in enumerate(out)]
    return [*rows, rows[7]]


def _boilerplate(rows):
    sites = {}
    for i, t, _, s, _ in rows:
        for line in t.split("\n"):
            if WORD.search(line):
                sites.setdefault(line, set()).add((s, i))
    return {line: min(i for _, i in where) for line, where in sites.items() if len({s for s, _ in where}) >= lines.SITES}


def _without_lines(rows):
    bad, out = _boilerplate(rows), []
    assert bad
    for i, t, lang, s, n in rows:
        kept = "\n".join(x for x in t.split("\n") if bad.get(x, i) >= i)
        if kept == t or WORD.search(kept):
            out.append((i, kept, lang, s, n if kept == t else len(kept)))
    return out


def test_stages_against_brute_force(spark):
    """Each stage on what its predecessor kept: all columns stay, and its rows are those of brute force."""
    rows = _documents()
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "line_dedup", "near_dedup", "mix", "pack"]

    def through(name, docs):
        out = stage(stages[name](spark, docs, ""), f"test-{name}")
        assert out.columns == docs.columns
        return out, sorted(map(tuple, out.collect()))

    docs, got = through("language", docs)
    assert got == sorted(r for r in rows if r[1] and any(map(str.isalpha, r[1])))

    want = sorted(_without_lines(got))
    docs, got = through("line_dedup", docs)
    assert got == want and len({r[0] for r in got}) < len({r[0] for r in rows})

    comp = _components(got, corpus_pipeline.SHINGLE)
    want = [r for r in got if comp[r[0]][1] == r[0]]
    docs, got = through("near_dedup", docs)
    assert got == want and len({r[0] for r in got}) < len(comp) - 8

    before, sizes = got, {}
    for r in before:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1]))
    docs, got = through("mix", docs)
    taken = {}
    for r in got:
        taken[r[3]] = taken.get(r[3], 0) + len(WORD.findall(r[1]))
    for s, target in _targets(sizes).items():
        assert abs(taken.get(s, 0) - target) <= max(len(WORD.findall(r[1])) for r in before if r[3] == s)
    times, most = Counter(got), Counter(before)
    assert set(times) <= set(most) and all(n <= 3 * most[r] for r, n in times.items())

    packed = stages["pack"](spark, docs, "").collect()
    tokenizer, want = Tokenizer.from_file(corpus_pipeline.TOKENIZER), Counter()
    for r in got:
        want[r[0]] += len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1
    total, bins = Counter(), {}
    for p in packed:
        total[p["doc_id"]] += p["length"]
        bins.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert total == want
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048


def test_run_equals_its_stages(spark, tmp_path):
    rows = _documents()
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, function in corpus_pipeline.STAGES[:-1]:
        docs = stage(function(spark, docs, str(tmp_path)), "test-chain")
    want = Counter(docs.select("doc_id").collect())
    got = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).filter("piece = 0").collect())
    assert got == Counter({r["doc_id"]: n for r, n in want.items()})


def test_stages_keep_clashing_columns_and_empty_tables(spark):
    """Columns named like the operators' own are the caller's; a null in any column is a row like others."""
    rows = [(*r, "a", 1, 2, "b", "c", 3, 4, "d", 5, 0.5) for r in _documents()]
    rows += [(None, rows[1][1], None, None, None, *[None] * 10), (900, "A footer of all sites\n" + rows[2][1], None, None, None, *[None] * 10)]
    docs = spark.createDataFrame(rows, f"{COLUMNS}, {EXTRA}")
    none = docs.limit(0)
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = stage(function(spark, docs, ""), f"test-{name}")
        assert docs.columns == none.columns and function(spark, none, "").collect() == []
        kept = docs.collect()
        assert {tuple(r)[5:] for r in kept} == {rows[0][5:], rows[-1][5:]} or name == "mix"
        assert kept and {tuple(r)[5:] for r in kept} <= {rows[0][5:], rows[-1][5:]}
    name, function = corpus_pipeline.STAGES[-1]
    assert function(spark, docs, "").count() >= docs.count() and function(spark, none, "").collect() == []


def _held(doc_id, folds, held):
    return zlib.crc32(str(doc_id).encode()) % folds == held


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
def test_languages_of_held_out_documents(spark):
    """Fold, accuracy and reruns of the query; labels of held-out rows and all sources change nothing."""
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    known = {r["doc_id"]: r for r in docs.collect()}
    got = {r["doc_id"]: r for r in language.op6_language_id(spark, str(DATA)).collect()}
    assert got.keys() == known.keys()
    assert all(r["held_out"] == _held(i, 4, 2) for i, r in got.items())
    told = [(known[i]["lang"], r["lang_pred"]) for i, r in got.items() if r["held_out"] and known[i]["lang"] and any(map(str.isalpha, known[i]["text"] or ""))]
    assert len(told) > 100 and sum(a == b for a, b in told) >= 0.97 * len(told)
    assert all(r["lang_pred"] == "und" for i, r in got.items() if not any(map(str.isalpha, known[i]["text"] or "")))

    from pyspark.sql import functions as F

    masked = docs.withColumn("lang", F.when(language.fold(F.col("doc_id")) != 2, F.col("lang"))).withColumn("source", F.lit("x"))
    again = {r["doc_id"]: (r["lang_pred"], round(r["score"], 4)) for r in language.predict(masked, language.fit(masked.repartition(7))).collect()}
    assert again == {i: (r["lang_pred"], round(r["score"], 4)) for i, r in got.items()}


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
def test_toxicity_of_held_out_documents(spark):
    """Fold, precision and recall of the query; labels of held-out rows change nothing."""
    docs, labels = spark.read.parquet(str(DATA / "documents.parquet")), spark.read.parquet(str(DATA / "labels.parquet"))
    got = {r["doc_id"]: r for r in toxicity.op10_toxicity(spark, str(DATA)).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == _held(i, 5, 0) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for i, r in got.items())
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    told = [(toxic[i], r["predicted"], r["score"]) for i, r in got.items() if r["held_out"] and toxic.get(i) is not None]
    bad, good = [s for y, _, s in told if y], [s for y, _, s in told if not y]
    assert bad and good
    area = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert area >= 0.85 and sum(p for y, p, _ in told if not y) <= 0.05 * len(good)

    from pyspark.sql import functions as F

    hidden = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id"), 5) != 0, F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, toxicity.fit(docs, hidden)).collect()}
    assert all(abs(again[i] - r["score"]) < 1e-9 for i, r in got.items())
