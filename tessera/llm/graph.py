"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is a grouped minimum (combined before the shuffle) and a join (whose hot keys Spark
splits); a node's neighbours are never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize


def _stored(edges: DataFrame, rows: int | None) -> tuple[DataFrame, tuple]:
    """The edges, written; their number and a sum of hashes, observed while they are written."""
    seen = Observation()
    out = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "edges", rows)
    return out, tuple(seen.get.values())


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) of every node on an edge (a, b); root is the component's smallest node.

    ``rows``: about how many edges there are, if known.
    """
    edges, last = _stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), rows)
    while last[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new, now = _stored(near.unionByName(down.withColumnRenamed("m", "b")).where("a != b").distinct(), last[0])
        discard(edges)
        edges = new
        if now == last:
            break
        last = now
    roots = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
