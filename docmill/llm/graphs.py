"""Connected components of a link table, as rounds of DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.shared import discard, save


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of the links (a, b).

    Large-star and small-star steps in turn: each node passes the smallest neighbour on to its larger, then
    to its smaller neighbours, until nothing changes. Stars settle in one round, chains in a logarithm of
    their length. Neighbours are never gathered, only their minimum is; every round is written to the shared
    folder, so that no lineage grows.
    """
    edges = save(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("u") != F.col("v")).distinct(), "links"
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (
            both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter(F.col("u") != F.col("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .filter(F.col("u") != F.col("v")).distinct()
        )
        after = save(small, "links")
        digest = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        done = digest(after) == digest(edges)
        discard(edges)
        edges = after
        if done:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
