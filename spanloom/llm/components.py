"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Steps, few_tasks

LINKS = 65_536  # of a task


def components(links: DataFrame, steps: Steps) -> DataFrame:
    """node and root, the smallest node of its component, for all nodes that have a link.

    `links` has a and b. Large-star and small-star steps in turn: each links a node's neighbours to
    the smallest of them, until all links go from a node to its root. Each round is a written
    table; the smallest neighbour is found with map-side combine and joined back as one row per
    node, so a node with very many links can be split.
    """
    ordered = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    edges = steps.write(links.filter("a <> b").select(*ordered).distinct(), "links")
    state = None
    while True:
        found = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)")).alias("h")).first()
        if not found.n or (found.n, found.h) == state:
            break
        state = found.n, found.h

        def few(df: DataFrame) -> DataFrame:
            # No step makes more rows of this than there are ends of links.
            return few_tasks(df, 2 * found.n, LINKS)

        both = edges.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(
            edges.select(F.col("high").alias("u"), F.col("low").alias("v"))
        )
        least = few(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("m").alias("low"), F.col("v").alias("high"))
        edges = steps.write(few(large.distinct()), "large-star")
        down = few(edges.groupBy(F.col("high").alias("u")).agg(F.min("low").alias("m")))
        pairs = edges.select(F.col("high").alias("u"), F.col("low").alias("v")).join(down, "u")
        small = pairs.filter("v <> m").select(F.col("m").alias("low"), F.col("v").alias("high")).unionByName(
            down.select(F.col("m").alias("low"), F.col("u").alias("high"))
        )
        edges = steps.write(few(small.distinct()), "small-star")
    rooted = edges.select(F.col("high").alias("node"), F.col("low").alias("root"))
    return rooted.unionByName(rooted.select(F.col("root").alias("node"), "root").distinct())
