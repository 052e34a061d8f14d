"""Operator 11: how five filters interact, by the Walsh-Hadamard transform.

Each document has a mask of the filters that it fails. Per part (source) and label the aggregation
keeps 32 signed parity sums, one a subset of the filters: plus one for a document that fails an even
number of the subset, minus one otherwise. The inverse transform turns them into the exact number of
documents of each mask, and from those cells come the counts of all 120 orders. A filter removes a
document in 120 / k of the orders, k the number of filters that it fails: its Shapley share.

A: fewer than 200 words. B: under half of the words are different. C: more than 2 % of the characters
are A-Z. D: holds one of ``# $ % & * |``. E: a row with a smaller doc_id has the same text.

Null texts are empty (and so equal to each other); a null source is the part ''. A row without a
doc_id fails E never and makes no other fail it, and has no labels. Rows that share id and text do not
make each other fail E. Labels that name a document twice count once: quality or toxic is 1 if any
row says so. An empty table has no parts and gives no rows; other columns are not read. A text is
worked on whole, with an array of its words.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.llm.staging import stage, table

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SPACE = r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2


def own_failures(text: Column, words: Column) -> Column:
    """The bits of A to D, which a text has by itself."""
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    failing = [
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
        100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]
    mask = F.lit(0)
    for bit, fails in enumerate(failing):
        mask = mask + F.when(fails, 1 << bit).otherwise(0)
    return mask


def masks(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic of every document.

    Texts are read once: what goes on is a digest of 32 bytes. The join that finds the first of equal
    texts has the doc_id in its key, so a text of many copies is no hot key.
    """
    text = F.coalesce("text", F.lit(""))
    cut = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    cut = cut.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    own = stage(cut.select("doc_id", "part", own_failures(F.col("text"), F.col("words")).alias("own"), F.unhex(F.sha2("text", 256)).alias("digest")), "audit-own")
    first = own.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    rated = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    rated = rated.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    joined = own.join(first, ["doc_id", "digest"], "left").join(rated, "doc_id", "left")
    again = F.col("doc_id").isNotNull() & F.col("first").isNull()
    mask = F.col("own") + F.when(again, 1 << FILTERS.index("E")).otherwise(0)
    return joined.select("part", mask.alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def _sign(mask: str, subset: str) -> str:
    return f"CASE WHEN bit_count({mask} & {subset}) % 2 = 0 THEN 1L ELSE -1L END"


def parity_sums(masked: DataFrame) -> DataFrame:
    """part, good, toxic, and the array of 32 signed sums over the documents of each."""
    sums = masked.groupBy("part", "good", "toxic").agg(*[F.sum(F.expr(_sign("mask", str(s)))).alias(f"s{s}") for s in range(CELLS)])
    return sums.select("part", "good", "toxic", F.array(*[f"s{s}" for s in range(CELLS)]).alias("sums"))


def cells(sums: DataFrame) -> DataFrame:
    """part, and arrays of 32: documents of each mask, those of good quality, toxic ones."""
    every = f"sequence(0, {CELLS - 1})"
    inverse = F.expr(f"transform({every}, m -> aggregate({every}, 0L, (a, s) -> a + sums[s] * ({_sign('m', 's')})) div {CELLS})")
    rows = sums.groupBy("part").agg(F.collect_list(F.struct("good", "toxic", inverse.alias("n"))).alias("rows"))  # four at most
    of = lambda which: F.expr(f"transform({every}, m -> aggregate(rows, 0L, (a, r) -> a + CASE WHEN {which} THEN r.n[m] ELSE 0L END))")
    return rows.select("part", of("true").alias("n"), of("r.good").alias("good"), of("r.toxic").alias("toxic"))


def orders_of(counted: DataFrame) -> DataFrame:
    """A row for each part, order and step."""
    steps = counted.select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = f"shiftleft(1, ascii({{}}) - {ord('A')})"
    before = f"aggregate(filter(split(substring(filter_order, 1, step - 1), ''), x -> x <> ''), 0, (a, x) -> a | {bit.format('x')})"
    steps = steps.withColumn("own", F.expr(bit.format("substring(filter_order, step, 1)"))).withColumn("before", F.expr(before))

    def total(where: str, of: str = "n", value: str = "{}[m]") -> Column:
        return F.expr(f"aggregate(sequence(0, {CELLS - 1}), 0L, (a, m) -> a + CASE WHEN {where} THEN {value.format(of)} ELSE 0L END)")

    here = "m & own <> 0 AND m & before = 0"
    return steps.select(
        "part", "filter_order", "step",
        total("m & (own | before) = 0").alias("kept"),
        total(here).alias("removed"),
        total("m & own <> 0 AND m & before <> 0").alias("redundant"),
        F.expr("n[own]").alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
        total("m & own <> 0", value=f"{{}}[m] * ({len(ORDERS)} div bit_count(m))").alias("shapley"),
    )


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return orders_of(cells(parity_sums(masks(documents, labels))))


def op11_filter_audit(spark, sf_dir) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit(documents, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
        100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
        coalesce(w.doc_id > first_id, false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails,
        count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(step AS INT) AS step, filter_order[step] AS own, filter_order[1 : step - 1] AS before FROM o, unnest(range(1, 6)) AS u(step)),
t AS (SELECT m.*, s.*, contains(fails, own) AS bad, regexp_matches(fails, '[' || before || '-]') AS gone FROM m, s),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT bad AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN bad AND NOT gone THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN bad AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN bad AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN bad AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
      FROM t GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""
