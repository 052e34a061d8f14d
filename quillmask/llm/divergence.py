"""Operator 13: how the sources of a language diverge, by inclusion and exclusion over supports.

The divergence of two groups is a sum over all kept terms of f(p, q), but few terms occur in both and
many in none. Written by supports (terms with a count above 0), with p0 and q0 the prices of a term
that does not occur:

    sum f(p, q) = V f(p0, q0) + sum over g's support of f(p, q0) - f(p0, q0)
                              + sum over h's support of f(p0, q) - f(p0, q0)
                              + sum over both supports of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

The first line's constant covers terms in neither; one-sided sums depend on counts alone, so a
histogram of a group's counts prices them; only the last needs a term's posting list, whose sources
meet inside the task that holds it and leave one partial sum a pair of sources and task.

A price is 1 + floor(10^9 (count + 2) / (N + 2 V)); all arithmetic is in integers (decimals where a
product can leave 64 bits). Null text, lang and source are ''. Terms are runs of A-Z, a-z and anything
beyond ASCII, of which A-Z are lower-cased; a term is kept where 10 documents (rows) of its language
have it. Groups without kept terms have all counts 0; a language without kept terms gives pairs of value
0 and no terms. An empty table gives an empty result; other columns are not read. A text is worked on
in pieces, but its different terms are held together.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmask.llm.staging import stage, table
from quillmask.llm.words import blocks

LEAST_DOCUMENTS = 10
TOP = 10
SCALE = 1_000_000_000
#: Sources of a block in the meeting of groups and of a posting list.
BLOCK = 256
#: Terms and bytes of text counted together before they leave a task; blocks of sums held at once.
TERMS, BYTES, SUMS = 300_000, 64 << 20, 64
#: Bytes of a text that are split at once.
PIECE = 1 << 20

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, about ``PIECE`` bytes of them at a time."""
    text, at = text.translate(_TABLE), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


COUNTED = "lang string, source string, term string, n long, docs long"


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that have the term; counted in each
    task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                terms = list(n)
                for at in range(0, len(terms), 50_000):
                    some = terms[at : at + 50_000]
                    columns = [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

        for part, texts in blocks(batches):
            for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                distinct: set[bytes] = set()
                for words in pieces(text):
                    n.update(words)
                    distinct.update(words)
                docs.update(distinct)
                size += len(text)
            if size > BYTES or sum(len(n) for n, _ in held.values()) > TERMS:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    found = documents.select("lang", "source", "text").mapInArrow(run, COUNTED)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def postings(documents: DataFrame) -> DataFrame:
    """(lang, term, total, entries): the kept terms, each with the sources that have it and how often.
    A list is as long as its language has sources."""
    lists = term_counts(documents).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("entries"))
    return stage(lists.filter(F.col("docs") >= LEAST_DOCUMENTS).drop("docs"), "postings")


def _price(count: str, n: str, v: str) -> str:
    return f"(1 + (cast({SCALE} as decimal(10,0)) * cast({count} + 2 as decimal(20,0))) div cast({n} + 2 * {v} as decimal(20,0)))"


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def groups(documents: DataFrame, lists: DataFrame) -> DataFrame:
    """One row a (lang, source): idx (from 0 in its language), of (groups of the language), n, v, the
    language's n, the price of a count of 0, and the histogram of its counts with their prices."""
    every = documents.select("lang", "source").distinct()
    entries = lists.select("lang", F.explode("entries").alias("e")).groupBy("lang", F.col("e.source").alias("source"), F.col("e.n").alias("c")).agg(F.count("*").alias("k"))
    stats = entries.groupBy("lang", "source").agg(F.sum(F.col("c") * F.col("k")).alias("n"), F.collect_list(F.struct("c", "k")).alias("hist"))
    langs = lists.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    joined = every.join(stats, ["lang", "source"], "left").join(langs, "lang", "left")
    whole = joined.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "v", "lang_n")], F.coalesce("hist", F.array().cast("array<struct<c:bigint,k:bigint>>")).alias("hist"))
    order = Window.partitionBy("lang").orderBy("source")
    whole = whole.withColumn("idx", F.row_number().over(order) - 1).withColumn("of", F.count("*").over(Window.partitionBy("lang")))
    zero = F.expr(f"CASE WHEN v > 0 THEN {_price('0', 'n', 'v')} ELSE 0L END")
    return stage(whole.withColumn("p0", zero).withColumn("hist", F.expr(f"transform(hist, h -> named_struct('p', {_price('h.c', 'n', 'v')}, 'k', h.k))")), "groups")


def one_sided(grouped: DataFrame) -> DataFrame:
    """(lang, a, b, value), a and b numbers of groups, a < b: what the histograms and the constant give.

    Groups of a language meet in blocks of 256 by 256, as many as the result has rows.
    """
    last = F.floor((F.col("of") - 1) / BLOCK).cast("int")
    dealt = grouped.withColumn("own", F.floor(F.col("idx") / BLOCK).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    g = dealt.select("lang", F.col("own").alias("i"), F.col("other").alias("j"), F.col("idx").alias("g"), "v", F.col("p0").alias("gp0"), "hist")
    h = dealt.select("lang", F.col("other").alias("i"), F.col("own").alias("j"), F.col("idx").alias("h"), F.col("p0").alias("hp0"))
    met = g.join(h, ["lang", "i", "j"]).filter("g <> h")
    none = _f("gp0", "hp0")
    side = f"aggregate(hist, 0L, (s, e) -> s + e.k * ({_f('e.p', 'hp0')} - {none}))"
    value = F.expr(f"CASE WHEN v = 0 THEN 0L ELSE {side} + CASE WHEN g < h THEN v * {none} ELSE 0L END END")
    return met.select("lang", F.least("g", "h").alias("a"), F.greatest("g", "h").alias("b"), value.alias("value"))


SUMMED = "lang string, a int, b int, value long"


def _np_f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = p - q
    return gap * gap // (p + q)


def overlaps(priced: DataFrame) -> DataFrame:
    """(lang, a, b, value): the corrections of terms that both groups have, from (lang, term, idx, p, p0).
    Partial sums of a task, by blocks of 256 by 256 groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, i, j), block in sums.items():
                a, b = np.nonzero(block)
                columns = [pa.array([lang] * len(a), pa.string()), pa.array((a + i * BLOCK).astype(np.int32)), pa.array((b + j * BLOCK).astype(np.int32)), pa.array(block[a, b])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "a", "b", "value"])

        for batch in batches:
            langs, lists = batch.column(0).to_pylist(), batch.column(1)
            flat = lists.flatten()
            idx, p, p0 = (flat.field(k).to_numpy() for k in range(3))
            edges = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            for lang, first, end in zip(langs, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                at = idx[first:end]
                cut = np.searchsorted(at, np.arange(0, int(at[-1]) + BLOCK, BLOCK)).tolist() + [len(at)]
                parts = [(k, first + x, first + y) for k, (x, y) in enumerate(zip(cut, cut[1:], strict=False)) if x < y]
                for i, x, y in parts:
                    for j, u, w in parts:
                        if i > j:
                            continue
                        pa_, za, pb, zb = p[x:y, None], p0[x:y, None], p[None, u:w], p0[None, u:w]
                        value = _np_f(pa_, pb) - _np_f(pa_, zb) - _np_f(za, pb) + _np_f(za, zb)
                        if i == j:
                            value = np.triu(value, 1)
                        block = sums.get((lang, i, j))
                        if block is None:
                            if len(sums) >= SUMS:
                                yield from flush()
                                sums.clear()
                            block = sums[lang, i, j] = np.zeros((BLOCK, BLOCK), np.int64)
                        block[np.ix_(idx[x:y] - i * BLOCK, idx[u:w] - j * BLOCK)] += value
        yield from flush()

    lists = priced.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("idx", "p", "p0"))).alias("entries")).filter("size(entries) > 1")
    return lists.select("lang", "entries").mapInArrow(run, SUMMED)


def source_divergence(documents: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: every pair of sources of a language, and the ten terms
    in which each source stands out most from its language."""
    known = documents.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    lists = postings(known)
    grouped = groups(known, lists)
    entries = lists.select("lang", "term", "total", F.explode("entries").alias("e")).select("lang", "term", "total", "e.source", F.col("e.n").alias("c"))
    priced = entries.join(grouped.select("lang", "source", "idx", "n", "v", "lang_n", "p0"), ["lang", "source"])
    priced = priced.select("lang", "source", "term", "idx", F.expr(_price("c", "n", "v")).alias("p"), "p0", F.expr(_price("total", "lang_n", "v")).alias("q"))

    summed = one_sided(grouped).unionByName(overlaps(priced)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    pairs = summed.select("lang", "value", both.alias("p")).select("lang", F.col("p.x").alias("x"), F.col("p.y").alias("y"), "value")
    name = lambda at, as_: grouped.select("lang", F.col("idx").alias(at), F.col("source").alias(as_))
    pairs = pairs.join(name("x", "source"), ["lang", "x"]).join(name("y", "item"), ["lang", "y"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = priced.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    top = terms.withColumn("rank", rank).filter(F.col("rank") <= TOP)
    return pairs.withColumn("rank", rank).unionByName(top)


def op13_source_divergence(spark, sf_dir) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT row_id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row_id) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
a AS (SELECT k.lang, s.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.n + 2 * v.v) AS HUGEINT) AS p
      FROM k JOIN v ON k.lang = v.lang JOIN s ON k.lang = s.lang LEFT JOIN c ON c.lang = k.lang AND c.source = s.source AND c.term = k.term),
l AS (SELECT a.lang, a.term, CAST(1 + (1000000000::HUGEINT * (sum(a.n) + 2)) // ((SELECT sum(s.n) FROM s WHERE s.lang = a.lang) + 2 * any_value(v.v)) AS HUGEINT) AS q FROM a JOIN v ON a.lang = v.lang GROUP BY a.lang, a.term),
x AS (SELECT g.lang, g.source, h.source AS item FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source),
y AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM a JOIN a b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
p AS (SELECT x.lang, x.source, 'pair' AS part, x.item, CAST(coalesce(y.value, 0) AS BIGINT) AS value FROM x LEFT JOIN y ON x.lang = y.lang AND x.source = y.source AND x.item = y.item),
t AS (SELECT a.lang, a.source, 'term' AS part, a.term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM a JOIN l ON a.lang = l.lang AND a.term = l.term WHERE a.n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM p UNION ALL SELECT * FROM t))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
