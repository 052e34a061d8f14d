"""Every registered query of the engine against its SQL twin, and the registry without optional parts."""

import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from quillmask.operators.engine import Masker
from quillmask.plans import catalogue

from test_engine import AZ, KNOWN

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def _value(v):
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "conversations", "customer", "lineitem", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    found = con.sql(catalogue.ORACLE[name])
    frame = catalogue.QUERIES[name](spark, str(DATA))
    assert sorted(frame.columns) == sorted(found.columns)
    want = sorted(repr([_value(v) for _, v in sorted(zip(found.columns, r, strict=True))]) for r in found.fetchall())
    assert sorted(repr([_value(r[c]) for c in sorted(frame.columns)]) for r in frame.collect()) == want

#: Pieces of texts in which neighbours touch, spans overlap, and placeholder words and digits of other scripts stand.
PIECES = (
    "4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", " 4000 0000 0000 0002", " ", "-", ".", "\n", "+1 415 555 2671", "(415) 555-2671", "415-555-2671", "2024-01-02",
    "123-45-6789", "10.0.0.1", "1.2.3.4", "é", "x", "_", ", ", "(", "+", "@", "12", "7", "٣", "20٢٤-٠١-٠٢", "joe@corp.io", ".com", "test ", "example", "card ", "mail ", "host ", "License",
)


@pytest.fixture(scope="module")
def odd_texts(spark, tmp_path_factory):
    folder, draw = tmp_path_factory.mktemp("odd"), random.Random(5)
    texts = [None, "", "4111 1111 1111 1111 10.0.0.1", "test License, License", "+1 415 555 2671 +1 415 555 2671", "415-555-2671 415-555-2671"]
    texts += ["".join(draw.choices(PIECES, k=draw.randint(0, 14))) for _ in range(2000)]
    rows = [(i, t, ("en", None)[i % 2], f"s{i % 3}", i % 2) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, toxic int")
    frame.drop("toxic").write.parquet(str(folder / "documents.parquet"))
    frame.select("doc_id", "toxic").write.parquet(str(folder / "labels.parquet"))
    return folder


@pytest.mark.parametrize("name", ("scan_cards_luhn", "scan_phone_bare", "scan_phone_structured", "ner_stub", "email_ipv4_card_by_label", "email_ipv4_card_by_lang_source", "email_ipv4_card_by_type"))
def test_query_equals_sql_on_odd_texts(spark, odd_texts, name):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{odd_texts}/{table}.parquet/*.parquet'")
    found = con.sql(catalogue.ORACLE[name])
    want = Counter(repr([v for _, v in sorted(zip(found.columns, r, strict=True))]) for r in found.fetchall())
    assert want and Counter(repr([r[c] for c in sorted(found.columns)]) for r in catalogue.QUERIES[name](spark, str(odd_texts)).collect()) == want


SUMMARIES = {"summary_by_type": (), "summary_by_lang_source": ("lang", "source"), "summary_by_label": ("toxic",)}


@pytest.mark.parametrize("name", SUMMARIES)
def test_summary_counts_all_types(spark, name, tmp_path):
    """One text of each type, a key by its name, an unnamed secret, and spans that overlap."""
    texts = [*[f"see {v} now" for v in KNOWN.values()], "API_KEY = 'abcdEFGH12345678'", f"commit {AZ[::-1]}", None, ""]
    texts += [f"{KNOWN['email']} {KNOWN['credit_card']} {KNOWN['phone']} token = {AZ}", "call 415-555-2671, ssn 123456789"]
    rows = [(i, t, ("en", None)[i % 2], f"s{i % 3}", i % 2) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, toxic int")
    frame.drop("toxic").write.parquet(str(tmp_path / "documents.parquet"))
    frame.select("doc_id", "toxic").write.parquet(str(tmp_path / "labels.parquet"))
    local, by, want = Masker().local(), SUMMARIES[name], Counter()
    for row in rows:
        named = dict(zip(("doc_id", "text", "lang", "source", "toxic"), row, strict=True))
        want.update((*[named[c] for c in by], s.entity_type) for s in local.detect(named["text"] or ""))
    got = catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    assert {(*[r[c] for c in by], r["entity_type"]): r["n"] for r in got} == want and len(got) == len(want)
    assert {k[-1] for k in want} == {*KNOWN, "api_key", "secret"}


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
def test_entry_counts_all_types(spark):
    import __spark_entry__

    want, local = Counter(), Masker().local()
    for (text,) in duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet' WHERE text IS NOT NULL").fetchall():
        want.update(s.entity_type for s in local.detect(text))
    assert {r["entity_type"]: r["n"] for r in __spark_entry__.entry(spark).collect()} == want and len(want) > 3


def test_registry_imports_without_optional_parts(tmp_path):
    """As after the optional subpackage and the pipeline are deleted."""
    import shutil

    shutil.copytree(ROOT / "quillmask", tmp_path / "quillmask", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and 'pipeline' not in e.queries() and e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
