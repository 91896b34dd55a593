"""Connected components of a table of links, by large and small stars.

Every round is two aggregations and two joins over the links, and ends in a
written table, so lineage stays short and nothing is gathered on the driver but
one row of sums a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour or itself."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them (a > b in links)."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    rest = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return least.select("a", F.col("m").alias("b")).union(rest).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with a link to another; root is the component's smallest node.

    Links may repeat and go either way; nulls and links to oneself don't count.
    """
    spark, seen, before = links.sparkSession, None, []
    now = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct()
    with common.recorded() as made:
        now = common.written(now, "links")
        while True:
            state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
            if state[0] == 0 or state == seen:
                break
            seen, before = state, [*made]
            now = common.written(_small(_large(now)), "links")
            # a round needs the one before it alone
            common.remove(spark, before)
            del made[: len(before)]
    for path in made:
        common.noted(path)
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
