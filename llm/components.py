"""Connected components of a link table by alternating large and small stars.

Each round is two aggregations over the links; between rounds the links are
written to the shared folder. Hot nodes are safe: a round only takes the
smallest neighbour of each node (a partial aggregate) and joins it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm._batches import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step: each node's neighbours (the larger ones, or the smaller ones
    and itself) are linked to its smallest neighbour or itself."""
    pairs = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    both = links.select(F.inline(pairs)) if large else links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.inline(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")),
                                             F.struct(F.col("u").alias("a"), F.col("m").alias("b")))))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in ``links`` (a, b): the root is the smallest
    node of its component (as signed longs)."""
    links = links.where("a <> b")
    seen = None
    while True:
        links = stored(_star(_star(links, True), False), "stars")
        state = links.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h")).first()
        if state == seen:
            break
        seen = state
    rows = links.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")),
                                         F.struct(F.col("b").alias("node"), F.col("b").alias("root")))))
    return rows.distinct()
