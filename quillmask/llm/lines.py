"""Operator 5: line dedup by the spread of a line over sites.

Lines are told apart by 128 bits of hash. For each line a HyperLogLog sketch of the sites (sources)
that have it is built, merged by aggregation, so a line on any number of rows costs one sketch a task.
Lines whose estimate is near the threshold get an exact distinct count; the others go by the sketch.
A line on ``SITES`` sites or more is boilerplate: it stays in the document with the least doc_id that
has it, and goes from every other. ``SITES`` is a fixed number, as in the SQL twin: in a table of fewer
sites every line stays, even one that is in every document, unless a caller gives a lower number.

Blank lines are neither counted nor removed. A null source is a site of its own, a null text has no
lines, rows without a doc_id stay as they are, repeated rows are treated alike, other columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.llm.staging import free_name, stage, table

SITES = 10
#: 2^12 registers: a standard error of 1.6 %.
REGISTERS = 12
#: Estimates this close to the threshold (a share of it, and a number) are counted exactly.
NEAR_SHARE, NEAR = 0.06, 1.0
INK = r"[^\x20\x09-\x0D]"


def line_key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2"))


def lines_of(documents: DataFrame) -> DataFrame:
    """doc_id, site, h1 and h2 of every line that is not blank."""
    site = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))
    cut = documents.select("doc_id", site.alias("site"), F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").rlike(INK))
    return cut.select("doc_id", "site", line_key(F.col("line")).alias("k")).select("doc_id", "site", "k.h1", "k.h2")


def boilerplate(documents: DataFrame, sites: int = SITES) -> DataFrame:
    """h1, h2 and first_doc of the lines on ``sites`` sites or more."""
    lines = lines_of(documents)
    sketched = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", REGISTERS)).alias("spread"), F.min("doc_id").alias("first_doc"), F.count("*").alias("n")
    )
    margin = NEAR_SHARE * sites + NEAR
    found = stage(sketched.filter((F.col("spread") >= sites - margin) & (F.col("n") >= sites)), "line-spread")
    near = found.filter(F.col("spread") <= sites + margin).select("h1", "h2")
    exact = lines.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.countDistinct("site").alias("exact"))
    return found.join(exact, ["h1", "h2"], "left").filter(F.coalesce("exact", "spread") >= sites).select("h1", "h2", "first_doc")


ADDED = ("kept_text", "n_lines", "n_removed")


def deduped(documents: DataFrame, sites: int = SITES, added: tuple[str, str, str] = ADDED) -> DataFrame:
    """The documents with the text that is kept, the number of lines (not blank) and of those removed,
    as columns of the names ``added``; columns that have these names already are replaced."""
    text, total, gone = added
    key, lost = (free_name([*documents.columns, *added], c) for c in ("bad_doc", "bad_lines"))
    known = stage(boilerplate(documents, sites), "line-boilerplate")
    hits = lines_of(documents).join(known, ["h1", "h2"]).filter(F.col("doc_id") > F.col("first_doc"))
    bad = hits.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set(F.struct("h1", "h2")).alias(lost))
    marked = documents.join(bad, documents["doc_id"] == bad[key], "left")
    rows = F.split("text", "\n")
    kept = F.filter(rows, lambda line: ~F.array_contains(lost, line_key(line)) | ~line.rlike(INK))
    ink = lambda column: F.size(F.filter(F.split(column, "\n"), lambda line: line.rlike(INK)))
    result = marked.withColumn(text, F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    result = result.withColumn(total, F.coalesce(F.when(F.col("text").isNotNull(), ink("text")), F.lit(0)).cast("long"))
    removed = F.when(F.col(lost).isNull(), F.lit(0)).otherwise(F.col(total) - ink(text)).cast("long")
    return result.withColumn(gone, removed).drop(key, lost)


def without_boilerplate(documents: DataFrame, sites: int = SITES) -> DataFrame:
    """The documents without boilerplate lines; one that consisted of nothing else goes. Other columns pass."""
    text, total, gone = added = tuple(free_name(documents.columns, c) for c in ADDED)
    result = deduped(documents, sites, added).filter((F.col(gone) == 0) | (F.col(gone) < F.col(total)))
    changed = {"text": F.col(text), "n_chars": F.when(F.col(gone) > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))}
    return result.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in documents.columns])


def op5_line_dedup(spark, sf_dir) -> DataFrame:
    result = deduped(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return result.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, coalesce('=' || source, '-') AS site, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
b AS (SELECT line, min(doc_id) AS first_doc FROM k GROUP BY line HAVING count(DISTINCT site) >= 10),
a AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS rows FROM documents),
r AS (SELECT a.doc_id, pos, a.rows[pos] AS line FROM a, unnest(range(1, len(a.rows) + 1)) AS u(pos)),
f AS (SELECT r.doc_id, r.pos, r.line, regexp_matches(r.line, '[^\x20\x09-\x0D]') AS ink, (b.line IS NOT NULL AND r.doc_id > b.first_doc) AS bad
      FROM r LEFT JOIN b ON r.line = b.line)
SELECT doc_id, CAST(count(*) FILTER (ink) AS BIGINT) AS n_lines, CAST(count(*) FILTER (ink AND bad) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT (ink AND bad)), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
