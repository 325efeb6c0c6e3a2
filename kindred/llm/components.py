"""Connected components of a table of links by alternating large-star and small-star steps.

Each step links a vertex's neighbours to the smallest of them with one aggregate and one join, so no neighbourhood is ever
gathered; the steps' results are written to the shared folder, which ends their lineage. The links shrink towards stars around
each component's smallest vertex, in a number of rounds that grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import discard, materialize


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(id, root) for every vertex of links (a, b): root is the smallest vertex that it reaches. No links: an empty table.

    Null ends and links of a vertex to itself are left out; repeated links count once.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a > b").distinct()
    links = materialize(links, "links")
    state = None
    for _ in range(most_rounds):
        both = _both(links)
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a > b").distinct()
        large = materialize(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        before, links = links, materialize(small.where("a > b").distinct(), "small")
        discard(before, large)
        now = links.agg(F.count("a"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"no rest after {most_rounds} rounds")
    roots = links.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
