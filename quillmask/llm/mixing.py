"""Operator 4: mixing sources to target weights by hash-threshold histograms.

A document's place in its source is a hash of its id, a string of hex digits. Tokens are summed by
source and the first digits; the running sums of these few buckets show in which bucket a source's
budget ends, and only that bucket is summed again by the next digits. The nested thresholds end in
one prefix per source; documents pass or fail it one by one, without a sort of documents.

Null texts have size 0, a null source is a source of its own (the last in order), empty tables give
empty results, repeated rows stand or fall together, and other columns pass through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmask.llm.staging import free_name, stage, table

#: Hex digits per level: 4,096 buckets a source and level.
DIGITS = 3
#: 16^12 places: with 100 billion documents in a source, less than one shares a place on average.
LEVELS = 4
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
WORD = r"[^\x20\x09-\x0D]+"


def place(doc_id: Column) -> Column:
    return F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, DIGITS * LEVELS)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    A source's level is the amount per unit of weight at which it reaches its most. In order of that
    level, sources stop at their most until one would not; it and all after it share what remains.
    One row per source: the table is sorted whole, in one task.
    """
    order = F.expr("struct(source is null, source)")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy(order)) - 1) % len(weights) + 1)
    level = Window.orderBy(F.col("cap") / F.col("weight"), order)
    below, rest = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    shared = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(below), F.lit(0))) / F.sum("weight").over(rest)
    return (
        sources.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("share", shared)
        .withColumn("rank", F.row_number().over(level))
        .withColumn("shares", F.min(F.when(F.col("cap") > F.col("weight") * F.col("share"), F.struct("rank", "share"))).over(whole))
        .select("source", "source_size", F.when(F.col("rank") >= F.col("shares.rank"), F.col("weight") * F.col("shares.share")).otherwise(F.col("cap")).cast("double").alias("target"))
    )


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, size, place) and (source, budget) to (source, edge, closes): places below ``edge`` hold
    at most the budget, and those at ``edge`` would pass it; ``closes``: with them it comes nearer.
    Null edge: the whole source."""
    found = budgets.select("source", F.col("budget").alias("left"), F.lit("").alias("edge"), F.lit(False).alias("whole"), F.lit(False).alias("closes"))
    for level in range(1, LEVELS + 1):
        width = DIGITS * level
        inner = sized.alias("d").join(
            found.alias("f"),
            F.col("d.source").eqNullSafe(F.col("f.source")) & ~F.col("f.whole") & (F.substring("d.place", 1, width - DIGITS) == F.col("f.edge")),
        )
        sums = inner.groupBy(F.col("f.source").alias("source"), F.substring("d.place", 1, width).alias("bucket")).agg(F.sum("d.size").alias("sum"), F.first("f.left").alias("left"))
        run = sums.withColumn("upto", F.sum("sum").over(Window.partitionBy("source").orderBy("bucket")))
        past = run.groupBy("source").agg(
            F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", "sum"))).alias("past"),
            F.max(F.when(F.col("upto") <= F.col("left"), F.col("upto"))).alias("under"),
        )
        joined = found.alias("f").join(past.alias("p"), F.col("f.source").eqNullSafe(F.col("p.source")), "left")
        found = stage(
            joined.select(
                F.col("f.source"),
                (F.col("left") - F.coalesce("under", F.lit(0))).alias("left"),
                F.coalesce("past.bucket", "edge").alias("edge"),
                (F.col("whole") | F.col("past").isNull()).alias("whole"),
                F.coalesce(F.col("past.sum") < 2 * (F.col("left") - F.coalesce("under", F.lit(0))), F.lit(False)).alias("closes"),
            ),
            f"mix-edges{level}",
        )
    return found.select("source", F.when(~F.col("whole"), F.col("edge")).alias("edge"), "closes")


def limits(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Per source: source_size, target, ``each`` (copies that every document gets) and ``edge``
    (documents placed below it, and at it where ``closes``, get one more; null: all do)."""
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    goal = stage(
        goal.withColumn("each", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0))
        .withColumn("budget", F.floor(F.col("target") - F.col("each") * F.col("source_size"))),
        "mix-targets",
    )
    edges = thresholds(sized, goal)
    return goal.alias("g").join(edges.alias("e"), F.col("g.source").eqNullSafe(F.col("e.source"))).select("g.*", "edge", "closes")


def sizes(documents: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return stage(documents.select("doc_id", "source", size.alias("size"), place(F.col("doc_id")).alias("place")), "mix-sizes")


def copies(row_place: Column, most: int = MOST_COPIES) -> Column:
    """How often the mix takes a document at this place, beside its source's limits ``l``."""
    extra = (F.col("l.each") < most) & (F.col("l.edge").isNull() | (row_place < F.col("l.edge")) | (F.col("l.closes") & (row_place == F.col("l.edge"))))
    return (F.col("l.each") + extra.cast("int")).cast("int")


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: how often the mix takes each document."""
    sized = sizes(documents)
    bounds = limits(sized, weights, most).alias("l")
    rows = sized.alias("d").join(bounds, F.col("d.source").eqNullSafe(F.col("l.source")))
    return rows.select("d.doc_id", "d.source", "d.size", "l.source_size", "l.target", copies(F.col("d.place"), most).alias("copies"))


def mixed_documents(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The documents, with their own columns, as often as the mix takes them.

    Copies follow from a row's source and id alone, so texts stay where they are.
    """
    bounds = limits(sizes(documents), weights, most).alias("l")
    rows = documents.alias("d").join(bounds, F.col("d.source").eqNullSafe(F.col("l.source")))
    times = F.explode(F.array_repeat(F.lit(0), copies(place(F.col("d.doc_id")), most)))
    spare = free_name(documents.columns, "copy")
    return rows.select("d.*", times.alias(spare)).drop(spare)


def op4_mix_sources(spark, sf_dir) -> DataFrame:
    """``taken`` counts a document's words as often as the mix repeats it."""
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS place
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
      3 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS share,
      row_number() OVER (ORDER BY cap / weight, source IS NULL, source) AS rank FROM w),
f AS (SELECT rank AS from_rank, share AS common FROM l WHERE cap > weight * share ORDER BY rank LIMIT 1),
t AS (SELECT source, source_size, CAST(CASE WHEN rank >= from_rank THEN weight * common ELSE cap END AS DOUBLE) AS target FROM l LEFT JOIN f ON true),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS each FROM t),
r AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.each,
      sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
      sum(d.size) OVER (PARTITION BY d.source, d.place) AS here, floor(g.target - g.each * g.source_size) AS budget
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (each + CASE WHEN each < 3 AND (upto <= budget OR (upto - here <= budget AND here < 2 * (budget - (upto - here)))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
