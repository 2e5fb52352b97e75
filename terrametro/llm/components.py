"""Connected components of a table of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.staging import staged


def components(links: DataFrame) -> DataFrame:
    """links(a, b), both bigint -> (node, root) for every node that has a link; root is its smallest node.

    Alternates large-star and small-star steps until the links no longer change. Each round is
    written to the shared folder, which cuts the lineage; a node's links are only ever folded
    to their minimum, never gathered.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = _mark(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = staged(both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(stars.union(down).distinct(), "links")
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]
