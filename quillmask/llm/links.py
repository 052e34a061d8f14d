"""Connected components of a table of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm.staging import stage, unstage


def components(links: DataFrame) -> DataFrame:
    """(a, b) to (node, comp): the least node reachable, for every node that has a link.

    Each round takes the least label among a node's neighbours and then that label's own label, so
    the number of rounds grows with the logarithm of a component's width. Labels are staged each round.
    """
    both = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("comp"), F.lit(True).alias("moved")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("lower"))
        jump = labels.select(F.col("node").alias("lower"), F.col("comp").alias("jumped"))
        moved = lower.join(jump, "lower", "left").select("node", F.least("lower", "jumped").alias("comp"), (F.least("lower", "jumped") < F.col("comp")).alias("moved"))
        before, labels = labels, stage(moved, "labels")
        unstage(before)
        if not labels.filter("moved").limit(1).count():
            unstage(both)
            out = labels.select("node", "comp")
            out._staged_at = labels._staged_at
            return out
